"""Oracle text for feed parsing: the columns the feeds were written from."""

from oracles.prelude import CTES as BASE

W = "WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY ball_seq)"
CTES = {
    "n9": "SELECT *, (match_id % 17 = 4) AS forced FROM con",
}
assert "con" in BASE

SQL = {
    "n1_clean_text": "SELECT match_id, team1 || ' ' || team2 AS pair, CASE WHEN match_id % 2 <> 0 THEN venue END AS venue FROM hdr",
    "n2_scalars": "SELECT match_id, CAST(match_id AS INTEGER) AS as_int, -1 AS bad_int, match_id + 0.5::DOUBLE AS as_float, match_id % 4 < 2 AS as_bool FROM hdr",
    "n3_dates": "SELECT match_id, match_date, start_datetime, NULL::DATE AS no_date FROM hdr",
    "n4_overs": "SELECT match_id, innings_no, balls, CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 AS overs, round_even(CAST(runs * 6 AS DOUBLE) / balls, 1) AS rate_1 FROM per0",
    "n5_canonical_side": "SELECT match_id, CASE match_id % 4 WHEN 2 THEN 'T.B.D.' ELSE team1 END AS side, NULL::VARCHAR AS nobody FROM hdr",
    "n6_canonical_place": """
SELECT match_id, CASE match_id % 4 WHEN 2 THEN 'Field ' || place_key ELSE venue END AS place,
  CASE WHEN match_id % 7 = 0 THEN 'Given' WHEN match_id % 4 = 2 THEN city WHEN place_key % 2 = 0 THEN 'CITY_' || place_key
       WHEN match_id % 4 = 0 THEN NULL WHEN match_id % 4 = 1 THEN 'North Block' ELSE city END AS city FROM hdr""",
    "n7_canonical_actor": "SELECT match_id, 'A Player ' || match_id || CASE WHEN match_id % 6 = 4 THEN ' (Other)' ELSE '' END AS player FROM hdr",
    "n8_toss": "SELECT match_id, toss_winner, toss_decision FROM con",
    "n9_result": """
SELECT match_id, CASE WHEN forced THEN team2 WHEN is_tie THEN NULL ELSE winner END AS winner, CASE WHEN forced THEN 'tie' ELSE result_type END AS result_type,
  CASE WHEN NOT forced THEN win_margin_runs END AS win_margin_runs, CASE WHEN NOT forced THEN win_margin_wickets END AS win_margin_wickets,
  forced OR is_tie AS is_tie, NOT forced AND coalesce(result_type = 'no result', false) AS is_no_result, forced AS is_super_over FROM n9""",
    "n10_innings_summary": """
SELECT match_id, innings_no, CASE WHEN match_id % 9 <> 0 THEN CAST(runs AS INTEGER) END AS runs, CASE WHEN match_id % 9 <> 0 THEN CAST(wickets AS INTEGER) END AS wickets,
  CASE WHEN match_id % 9 <> 0 THEN CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 END AS overs, CASE WHEN match_id % 9 <> 0 THEN balls END AS balls FROM per0""",
    "n11_dismissal": """
SELECT match_id, innings_no, player, dismissal_kind IN ('caught', 'bowled', 'lbw', 'run out') AS is_out,
  CASE WHEN dismissal_kind = 'not out' AND match_id % 2 <> 0 THEN NULL ELSE dismissal_kind END AS dismissal_kind,
  CASE dismissal_kind WHEN 'caught' THEN 'Safe Hands (sub)' WHEN 'run out' THEN 'Quick Arm' END AS fielder,
  CASE WHEN dismissal_kind IN ('caught', 'bowled', 'lbw') THEN coalesce(bowler, 'Nobody') END AS bowler FROM bat0""".replace("'Safe Hands (sub)'", "'Safe Hands'"),
    "n12_stage": """
SELECT match_id, CASE match_id % 8 WHEN 0 THEN 'Qualifier 1' WHEN 1 THEN 'Eliminator' WHEN 2 THEN 'Semi Final' WHEN 3 THEN '3rd Place' WHEN 4 THEN NULL
  WHEN 5 THEN 'Final' WHEN 6 THEN 'Qualifier 2' ELSE 'League' END AS stage, match_id % 8 NOT IN (4, 7) AS is_playoff FROM hdr""",
    "n13_season_and_key": "SELECT match_id, CASE WHEN season >= 2000 THEN season END AS season, 'feed:' || season || ':' || CASE WHEN match_id % 10 = 0 THEN 'na' ELSE CAST(match_id AS VARCHAR) END AS match_key FROM hdr",
    "n14_neutral": "SELECT match_id, team1_key < 9 AND team1 <> venue AS is_neutral_venue FROM hdr",
    "n15_outcome": """
SELECT match_id, CASE WHEN nr THEN NULL WHEN tie THEN CASE WHEN match_id % 2 = 0 THEN team1 END ELSE winner END AS winner,
  CASE WHEN nr THEN 'no result' WHEN tie THEN 'tie' WHEN winner IS NOT NULL THEN result_type END AS result_type,
  CASE WHEN NOT nr AND NOT tie THEN win_margin_runs END AS win_margin_runs, CASE WHEN NOT nr AND NOT tie THEN win_margin_wickets END AS win_margin_wickets,
  NOT nr AND tie AS is_tie, nr AS is_no_result, NOT nr AND tie AND match_id % 2 = 0 AS is_super_over, is_dls_applied,
  CASE WHEN nr THEN 'Match abandoned (No Result)' WHEN tie THEN CASE WHEN match_id % 2 = 0 THEN 'Match tied (' || team1 || ' won the Super Over)' ELSE 'Match tied' END
    WHEN winner IS NOT NULL THEN winner || ' won by ' || coalesce(win_margin_runs || ' runs', win_margin_wickets || ' wickets') END AS result_summary,
  nr OR tie OR winner IS NOT NULL AS is_completed
FROM (SELECT *, coalesce(result_type = 'no result', false) AS nr, is_tie OR match_id % 17 = 4 AS tie FROM con)""",
    "n16_codes": "SELECT match_id, CASE WHEN team1_key < 8 THEN 'N' || team1_key ELSE team1 END AS code, CASE WHEN team1_key < 5 THEN '#00000' || team1_key ELSE '#6B7280' END AS colour FROM hdr",
    "s12_schedule_headers": """
SELECT 'official:' || s || ':' || match_id AS match_key, s AS season, CAST(match_id AS VARCHAR) AS source_match_id, CAST(season0 * 10 AS BIGINT) AS competition_id, match_date, start_datetime,
  stage, is_playoff, match_id % 2 = 0 AS is_day_night, overs_per_innings, venue, city, team1, team2, CASE WHEN match_id % 6 <> 0 THEN team1 END AS home_team, toss_winner, toss_decision,
  first_batting_team, second_batting_team, is_completed AND result_type IS NOT NULL AS is_completed, winner, result_type, win_margin_runs, win_margin_wickets,
  coalesce(result_type = 'no result', false) AS is_no_result, match_id % 6 <> 0 AND team1 <> 'NATION_9' AND team1 <> venue AS is_neutral_venue
FROM (SELECT *, season AS season0, CASE WHEN season >= 2000 THEN season ELSE 1900 END AS s FROM con)""",
    "s12_schedule_innings": """
SELECT 'official:' || CASE WHEN season >= 2000 THEN season ELSE 1900 END || ':' || match_id AS match_key, innings_no,
  CASE innings_no WHEN 1 THEN first_batting_team ELSE second_batting_team END AS batting_team, CASE innings_no WHEN 1 THEN second_batting_team ELSE first_batting_team END AS bowling_team,
  CAST(p.runs AS INTEGER) AS runs, CAST(p.wickets AS INTEGER) AS wickets, CAST(120 AS BIGINT) AS balls FROM per0 p JOIN con USING (match_id) WHERE first_batting_team IS NOT NULL""",
    "s13_summary_feed": """
SELECT match_key, player_of_match, CASE WHEN match_id % 2 = 0 THEN target_runs END AS target_runs, 'A Referee' AS match_referee, match_id % 4 = 0 AS is_super_over,
  is_dls_applied OR match_id % 5 = 0 AS is_dls_applied, CASE WHEN late THEN team1 ELSE winner END AS winner, CASE WHEN late THEN 'wickets' ELSE result_type END AS result_type,
  CASE WHEN late THEN 3 ELSE win_margin_wickets END AS win_margin_wickets, is_completed OR late AS is_completed
FROM (SELECT *, NOT is_completed AND match_id % 3 = 0 AS late FROM cona)""",
    "s14_feed_attack_cards": """
SELECT CAST(match_id AS VARCHAR) AS match_key, innings_no, team, player, batting_position, CAST(runs AS INTEGER) AS runs, CAST(balls AS INTEGER) AS balls, CAST(fours AS INTEGER) AS fours,
  CAST(sixes AS INTEGER) AS sixes, CAST(dot_balls AS INTEGER) AS dot_balls, dismissal_kind IN ('caught', 'bowled', 'lbw', 'run out') AS is_out,
  CASE WHEN dismissal_kind IN ('caught', 'bowled', 'lbw') THEN coalesce(bowler, 'Nobody') END AS bowler, wicket_number FROM bat0""",
    "s14_feed_defence_cards": """
SELECT CAST(match_id AS VARCHAR) AS match_key, innings_no, team, player, bowling_order, overs, balls, CAST(maidens AS INTEGER) AS maidens, CAST(runs_conceded AS INTEGER) AS runs_conceded,
  CAST(wickets AS INTEGER) AS wickets, CAST(wides AS INTEGER) AS wides, CAST(no_balls AS INTEGER) AS no_balls, CAST(dot_balls AS INTEGER) AS dot_balls FROM bowl0""",
    "s14_feed_dismissals": "SELECT CAST(match_id AS VARCHAR) AS match_key, innings_no, wicket_no, player, team, CAST(fall_score AS INTEGER) AS fall_score, fall_overs FROM dis",
    "s14_feed_stands": """
SELECT CAST(match_id AS VARCHAR) AS match_key, innings_no, wicket_no, team, striker, non_striker, CAST(runs AS INTEGER) AS runs, CAST(striker_balls + non_striker_balls AS INTEGER) AS balls,
  CAST(striker_runs AS INTEGER) AS striker_runs, CAST(striker_balls AS INTEGER) AS striker_balls, CAST(non_striker_runs AS INTEGER) AS non_striker_runs,
  CAST(non_striker_balls AS INTEGER) AS non_striker_balls, CAST(extras AS INTEGER) AS extras, start_over, end_over, is_unbroken FROM std""",
    "s15_event_history": f"""
SELECT CAST(match_id AS VARCHAR) AS match_key, innings_no, over_no, ball_no, ball_seq, batting_team, bowling_team, batter, bowler, batter_runs, extra_runs, total_runs, is_wide, is_no_ball, is_legal,
  is_four, is_six, is_wicket, wicket_type, CAST(sum(total_runs) OVER w AS BIGINT) AS cumulative_runs, CAST(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cumulative_wickets FROM ev {W}""",
    "s16_roster_feed": "SELECT CAST(match_id AS VARCHAR) AS match_key, team, player, playing_order <= 8 AS is_playing_xi, playing_order = 9 AS is_impact_sub, is_captain, is_wicketkeeper, is_overseas, playing_order + 3 AS playing_order, role FROM ros",
    "s18_unwrap_jsonp": "SELECT match_id, team1 FROM hdr WHERE match_id % 6 > 2",
    "s18_quarantine": "SELECT match_id, CASE match_id % 6 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'malformed JSON' ELSE 'not an object' END AS reason FROM hdr WHERE match_id % 6 <= 2",
    "s19_discover_competitions": "SELECT season, max(match_id) AS competition_id FROM hdr WHERE season > 2000 GROUP BY season",
    "s11_document_contests": """
SELECT 'official:' || season || ':' || match_id AS match_key, season, match_date, venue, city, team1, team2, toss_winner, toss_decision,
  CASE WHEN NOT is_completed OR nr THEN NULL WHEN tie THEN CASE WHEN match_id % 2 = 0 THEN team1 END ELSE winner END AS winner,
  CASE WHEN NOT nr AND NOT tie THEN win_margin_runs END AS win_margin_runs, CASE WHEN NOT nr AND NOT tie THEN win_margin_wickets END AS win_margin_wickets,
  is_completed AND (nr OR tie OR winner IS NOT NULL) AS is_completed, is_playoff
FROM (SELECT *, coalesce(result_type = 'no result', false) AS nr, is_tie OR match_id % 17 = 4 AS tie FROM con)""",
    "s17_document_rosters": """
SELECT CAST(match_id AS VARCHAR) AS source_match_id, season, team, player, true AS is_playing_xi,
  CAST(row_number() OVER (PARTITION BY match_id, team ORDER BY playing_order, player) AS INTEGER) AS playing_order, md5(player) AS source_player_id FROM ros""",
    "d1_flatten_events": f"""
SELECT match_id, innings_no, over_no, ball_no, ball_seq, batting_team, batter, non_striker, bowler, batter_runs, extra_runs, total_runs, is_wide, is_no_ball, is_legal, is_four, is_six, is_wicket,
  wicket_type, dismissed, CAST(sum(total_runs) OVER w AS BIGINT) AS cumulative_runs, CAST(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cumulative_wickets, total_runs AS charged_runs FROM ev {W}""",
}
