"""Oracle text for side, actor, place and report analytics."""

PCT = "CASE WHEN {d} > 0 THEN CAST(({n}) * 100 AS DOUBLE) / ({d}) END"


def pct(n: str, d: str) -> str:
    return PCT.format(n=n, d=d)


def rate(n: str, d: str, scale: int = 1) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST(({n}) * {scale} AS DOUBLE) / ({d}) END"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def mean(e: str) -> str:
    return f"CASE WHEN count({e}) > 0 THEN CAST(sum({e}) AS DOUBLE) / count({e}) END"


def bat_table(keys: str, source: str = "bat", where: str = "TRUE", fifty: int = 50, hundred: int = 100) -> str:
    return f"""(SELECT {keys}, count(*) AS innings, {big('sum(runs)')} AS runs, {big('sum(balls)')} AS balls,
  {big('sum(fours)')} AS fours, {big('sum(sixes)')} AS sixes, {big('sum(outs)')} AS dismissals, max(best) AS highest_score,
  {rate('sum(runs)', 'sum(outs)')} AS average, {rate('sum(runs)', 'sum(balls)', 100)} AS strike_rate,
  {big('sum(fours) * 4 + sum(sixes) * 6')} AS boundary_runs, {rate('sum(fours) * 4 + sum(sixes) * 6', 'sum(runs)', 100)} AS boundary_pct,
  count(*) FILTER (WHERE runs >= {fifty} AND runs < {hundred}) AS fifties, count(*) FILTER (WHERE runs >= {hundred}) AS hundreds,
  count(*) FILTER (WHERE runs = 0) AS ducks
FROM (SELECT {keys}, match_id, sum(runs) AS runs, sum(balls) AS balls, sum(fours) AS fours, sum(sixes) AS sixes,
        sum(CASE WHEN is_out THEN 1 ELSE 0 END) AS outs, max(runs) AS best FROM {source} WHERE {where} GROUP BY {keys}, match_id)
GROUP BY {keys})"""


def bowl_table(keys: str, where: str = "TRUE") -> str:
    return f"""(SELECT {keys}, count(*) AS innings, {big('sum(balls)')} AS balls, {big('sum(runs_conceded)')} AS runs_conceded,
  {big('sum(wickets)')} AS wickets, {big('sum(maidens)')} AS maidens, {big('sum(wides)')} AS wides, {big('sum(no_balls)')} AS no_balls,
  max(best) AS best_wickets, CAST(sum(balls) AS DOUBLE) / 6 AS overs, {rate('sum(runs_conceded)', 'sum(wickets)')} AS average,
  {rate('sum(runs_conceded)', 'sum(balls)', 6)} AS economy, {rate('sum(balls)', 'sum(wickets)')} AS strike_rate,
  count(*) FILTER (WHERE wickets = 4) AS four_wicket_hauls, count(*) FILTER (WHERE wickets >= 5) AS five_wicket_hauls
FROM (SELECT {keys}, match_id, sum(balls) AS balls, sum(runs_conceded) AS runs_conceded, sum(wickets) AS wickets,
        sum(maidens) AS maidens, sum(wides) AS wides, sum(no_balls) AS no_balls, max(wickets) AS best
      FROM bowl WHERE {where} GROUP BY {keys}, match_id) GROUP BY {keys})"""


CTES = {
    "titles": "SELECT winner AS team, count(*) AS titles FROM con WHERE is_completed AND winner IS NOT NULL AND lower(stage) = 'final' GROUP BY winner",
    "ts": f"""
SELECT lf.team, count(*) AS matches, {big('sum(won)')} AS wins, {big('sum(is_home)')} AS home_matches, {big('count(*) - sum(won)')} AS losses,
  {pct('sum(won)', 'count(*)')} AS win_pct,
  {pct('sum(won) FILTER (WHERE is_home = 1)', 'count(*) FILTER (WHERE is_home = 1)')} AS home_win_pct,
  {pct('sum(won) FILTER (WHERE is_home = 0)', 'count(*) FILTER (WHERE is_home = 0)')} AS away_win_pct,
  {pct('sum(won) FILTER (WHERE batted_first = 1)', 'count(*) FILTER (WHERE batted_first = 1)')} AS bat_first_win_pct,
  {pct('sum(won) FILTER (WHERE batted_first = 0)', 'count(*) FILTER (WHERE batted_first = 0)')} AS chasing_win_pct,
  coalesce(any_value(t.titles), 0) AS titles, count(DISTINCT season) AS seasons
FROM lf LEFT JOIN titles t ON t.team = lf.team GROUP BY lf.team""",
    "tl": f"""
SELECT team, row_number() OVER w AS match_number, match_id, match_date, season, opponent, venue, won,
  CAST(sum(won) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 100 AS DOUBLE) / count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_win_pct,
  CAST(sum(won) OVER w * 100 AS DOUBLE) / count(*) OVER w AS cumulative_win_pct
FROM lf WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id)""",
    "met": """
SELECT *, least(team1, team2) AS side_a, greatest(team1, team2) AS side_b,
  CASE WHEN winner = least(team1, team2) THEN 1 ELSE 0 END AS a_won, CASE WHEN winner = greatest(team1, team2) THEN 1 ELSE 0 END AS b_won
FROM con WHERE is_completed AND winner IS NOT NULL""",
    "stk": """
SELECT side_a, side_b, any_value(latest) AS streak_team, count(*) FILTER (WHERE brk = 0) AS streak FROM (
  SELECT *, sum(CASE WHEN winner <> latest THEN 1 ELSE 0 END) OVER (PARTITION BY side_a, side_b ORDER BY match_date DESC, match_id DESC) AS brk
  FROM (SELECT *, first_value(winner) OVER (PARTITION BY side_a, side_b ORDER BY match_date DESC, match_id DESC) AS latest FROM met))
GROUP BY side_a, side_b""",
    "lastres": """
SELECT side_a, side_b, arg_max(result_summary, (match_date, match_id)) AS last_result FROM met WHERE result_summary IS NOT NULL GROUP BY side_a, side_b""",
    "tossed": "SELECT *, CASE WHEN toss_winner = winner THEN 1 ELSE 0 END AS tw FROM con WHERE is_completed AND winner IS NOT NULL AND toss_winner IS NOT NULL",
    "vsum": f"""
SELECT venue, count(*) AS matches, count(DISTINCT season) AS seasons, arg_min(city, (match_date, match_id)) AS city,
  nullif(count(first_batting_team), 0) AS decided,
  CASE WHEN count(first_batting_team) > 0 THEN count(*) FILTER (WHERE winner <> first_batting_team) END AS chase_wins,
  {pct('count(*) FILTER (WHERE winner <> first_batting_team)', 'count(first_batting_team)')} AS chase_win_pct,
  100.0::DOUBLE - {pct('count(*) FILTER (WHERE winner <> first_batting_team)', 'count(first_batting_team)')} AS bat_first_win_pct,
  {mean('win_margin_runs')} AS avg_win_margin_runs, {mean('win_margin_wickets')} AS avg_win_margin_wickets
FROM con WHERE is_completed AND winner IS NOT NULL GROUP BY venue""",
    "vper": f"""
SELECT venue, {mean('CASE WHEN innings_no = 1 THEN runs END')} AS avg_first_innings, max(CASE WHEN innings_no = 1 THEN runs END) AS highest_first_innings,
  min(CASE WHEN innings_no = 1 THEN runs END) AS lowest_first_innings, avg(CASE WHEN innings_no = 1 THEN run_rate END) AS avg_run_rate,
  {mean('CASE WHEN innings_no = 2 THEN runs END')} AS avg_second_innings FROM per GROUP BY venue""",
    "phase": """
SELECT match_id, innings_no, season, CASE WHEN over_no <= 6 THEN 'powerplay' WHEN over_no < 16 THEN 'middle' ELSE 'death' END AS phase,
  sum(total_runs) AS runs, count(*) FILTER (WHERE is_wicket) AS wickets, count(*) FILTER (WHERE is_legal) AS balls
FROM ev GROUP BY ALL""",
    "seen": "SELECT player, match_id, team, season FROM bat UNION ALL SELECT player, match_id, team, season FROM bowl",
    "career": f"""
SELECT s.player, s.matches, t.teams, q.seasons, coalesce(a.n, 0) AS player_of_match_awards,
  b.innings AS batting_innings, b.runs AS batting_runs, b.balls AS batting_balls, b.fours AS batting_fours, b.sixes AS batting_sixes,
  b.dismissals AS batting_dismissals, b.highest_score AS batting_highest_score, b.average AS batting_average, b.strike_rate AS batting_strike_rate,
  b.boundary_runs AS batting_boundary_runs, b.boundary_pct AS batting_boundary_pct, b.fifties AS batting_fifties, b.hundreds AS batting_hundreds, b.ducks AS batting_ducks,
  w.innings AS bowling_innings, w.balls AS bowling_balls, w.runs_conceded AS bowling_runs_conceded, w.wickets AS bowling_wickets, w.maidens AS bowling_maidens,
  w.wides AS bowling_wides, w.no_balls AS bowling_no_balls, w.best_wickets AS bowling_best_wickets, w.overs AS bowling_overs, w.average AS bowling_average,
  w.economy AS bowling_economy, w.strike_rate AS bowling_strike_rate, w.four_wicket_hauls AS bowling_four_wicket_hauls, w.five_wicket_hauls AS bowling_five_wicket_hauls
FROM (SELECT player, count(DISTINCT match_id) AS matches FROM seen GROUP BY player) s
JOIN (SELECT player, array_to_string(list_sort(list(DISTINCT team)), '|') AS teams FROM seen GROUP BY player) t USING (player)
JOIN (SELECT player, array_to_string(list_sort(list(DISTINCT season)), '|') AS seasons FROM seen GROUP BY player) q USING (player)
LEFT JOIN (SELECT player_of_match AS player, count(*) AS n FROM cona GROUP BY 1) a USING (player)
LEFT JOIN {bat_table('player', fifty=20, hundred=40)} b USING (player) LEFT JOIN {bowl_table('player')} w USING (player)""",
    "slots": "SELECT match_id, season, is_completed, winner, team1 AS team FROM con UNION ALL SELECT match_id, season, is_completed, winner, team2 FROM con",
}

MET_LIST = "match_id, match_date, season, venue, team1, team2, winner, result_summary"

SQL = {
    "t1_long_form": "SELECT * FROM lf",
    "t2_team_summary": "SELECT * FROM ts",
    "t3_title_counts": "SELECT * FROM titles",
    "t4_team_season_summary": f"SELECT team, season, count(*) AS matches, {big('sum(won)')} AS wins, {big('count(*) - sum(won)')} AS losses, {pct('sum(won)', 'count(*)')} AS win_pct FROM lf GROUP BY team, season",
    "t5_form_timeline": "SELECT * FROM tl",
    "t6_head_to_head": f"""
SELECT m.side_a, m.side_b, count(*) AS matches, {big('sum(a_won)')} AS a_wins, {big('sum(b_won)')} AS b_wins,
  count(*) FILTER (WHERE is_no_result) AS no_result, {pct('sum(a_won)', 'count(*)')} AS a_win_pct, {pct('sum(b_won)', 'count(*)')} AS b_win_pct,
  any_value(last_result) AS last_result, any_value(streak_team) AS streak_team, any_value(streak) AS streak
FROM met m JOIN stk USING (side_a, side_b) LEFT JOIN lastres USING (side_a, side_b) GROUP BY m.side_a, m.side_b""",
    "t7_head_to_head_by_venue": f"SELECT side_a, side_b, venue, count(*) AS matches, {big('sum(a_won)')} AS a_wins, {big('count(*) - sum(a_won)')} AS b_wins FROM met GROUP BY ALL",
    "t7_head_to_head_by_season": f"SELECT side_a, side_b, season, count(*) AS matches, {big('sum(a_won)')} AS a_wins, {big('count(*) - sum(a_won)')} AS b_wins FROM met GROUP BY ALL",
    "t7_meeting_list": f"SELECT {MET_LIST} FROM met WHERE side_a = 'NATION_1' AND side_b = 'NATION_2'",
    "t8_current_streak": "SELECT * FROM stk",
    "t9_last_result": "SELECT * FROM lastres",
    "t10_toss_impact": f"""
SELECT 'all' AS grouping, 'All matches' AS "group", count(*) AS matches, {big('sum(tw)')} AS toss_winner_wins, {pct('sum(tw)', 'count(*)')} AS toss_winner_advantage_pct FROM tossed
UNION ALL SELECT 'season', CAST(season AS VARCHAR), count(*), {big('sum(tw)')}, {pct('sum(tw)', 'count(*)')} FROM tossed GROUP BY season
UNION ALL SELECT 'venue', venue, count(*), {big('sum(tw)')}, {pct('sum(tw)', 'count(*)')} FROM tossed GROUP BY venue
UNION ALL SELECT 'toss_decision', toss_decision, count(*), {big('sum(tw)')}, {pct('sum(tw)', 'count(*)')} FROM tossed GROUP BY toss_decision""",
    "t11_batting_first_advantage": f"""
SELECT c.season, count(*) AS matches, {big('sum(f)')} AS bat_first_wins, {big('count(*) - sum(f)')} AS chase_wins,
  {pct('sum(f)', 'count(*)')} AS bat_first_win_pct, 100.0::DOUBLE - {pct('sum(f)', 'count(*)')} AS chase_win_pct, any_value(s.a) AS avg_first_innings_score
FROM (SELECT *, CASE WHEN winner = first_batting_team THEN 1 ELSE 0 END AS f FROM con WHERE is_completed AND winner IS NOT NULL AND first_batting_team IS NOT NULL) c
LEFT JOIN (SELECT season, {mean('runs')} AS a FROM per WHERE innings_no = 1 GROUP BY season) s ON s.season = c.season GROUP BY c.season""",
    "t12_compare_sides": "SELECT * FROM ts WHERE team IN ('NATION_1', 'NATION_2', 'NATION_3')",
    "t12_season_pivot": f"""
SELECT season, {pct("sum(won) FILTER (WHERE team = 'NATION_1')", "count(*) FILTER (WHERE team = 'NATION_1')")} AS "NATION_1",
  {pct("sum(won) FILTER (WHERE team = 'NATION_2')", "count(*) FILTER (WHERE team = 'NATION_2')")} AS "NATION_2",
  {pct("sum(won) FILTER (WHERE team = 'NATION_3')", "count(*) FILTER (WHERE team = 'NATION_3')")} AS "NATION_3"
FROM lf WHERE team IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY season""",
    "t13_recent_form": """
SELECT team, CAST(r AS INTEGER) AS recency, match_id, opponent, CASE WHEN won = 1 THEN 'Won' ELSE 'Lost' END AS result, rolling_win_pct
FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_number DESC) AS r FROM tl) WHERE r <= 10""",
    "t14_fixture_list": """
SELECT match_id, season, match_date, venue, team1, team2, winner, result_summary, is_completed FROM con
WHERE (team1 = 'NATION_2' OR team2 = 'NATION_2') AND is_completed ORDER BY match_date DESC, match_id DESC LIMIT 20 OFFSET 5""",
    "p1_batting_leaderboard": f"SELECT * FROM {bat_table('player')}",
    "p2_milestones": f"SELECT player, fifties, hundreds, ducks FROM {bat_table('player', fifty=20, hundred=40)}",
    "p3_bowling_leaderboard": f"SELECT * FROM {bowl_table('player')}",
    "p4_hauls": f"SELECT player, four_wicket_hauls, five_wicket_hauls FROM {bowl_table('player')}",
    "p5_career_summary": "SELECT * FROM career",
    "p6_season_trend": f"""
SELECT * FROM (SELECT player, season, innings, runs, average AS batting_average, strike_rate FROM {bat_table('player, season')})
FULL JOIN (SELECT player, season, wickets, economy FROM {bowl_table('player, season')}) USING (player, season)""",
    "p7_place_split": f"SELECT player, venue, innings, runs, balls, dismissals, highest_score, average, strike_rate FROM {bat_table('player, venue')} WHERE innings >= 2",
    "p8_opposition_split": f"SELECT player, opposition, innings, runs, balls, dismissals, average, strike_rate FROM {bat_table('player, opposition')}",
    "p9_compare_actors": """
SELECT CAST(l.pos AS INTEGER) AS list_position, l.player, coalesce(matches, 0) AS matches, coalesce(batting_runs, 0) AS runs, batting_average,
  batting_strike_rate AS strike_rate, coalesce(batting_fifties50, 0) AS fifties, coalesce(batting_hundreds100, 0) AS hundreds, coalesce(bowling_wickets, 0) AS wickets,
  bowling_average, bowling_economy AS economy, coalesce(player_of_match_awards, 0) AS player_of_match_awards
FROM (VALUES (1, 'NATION_3_P4'), (2, 'NATION_1_P0'), (3, 'NOBODY'), (4, 'NATION_7_P2')) l(pos, player)
LEFT JOIN career USING (player) LEFT JOIN (SELECT player, fifties AS batting_fifties50, hundreds AS batting_hundreds100 FROM """ + bat_table("player") + """) m USING (player)""",
    "p10_runs_by_season": """
SELECT season, CAST(sum(runs) FILTER (WHERE player = 'NATION_3_P4') AS BIGINT) AS "NATION_3_P4", CAST(sum(runs) FILTER (WHERE player = 'NATION_1_P0') AS BIGINT) AS "NATION_1_P0"
FROM bat WHERE player IN ('NATION_3_P4', 'NATION_1_P0') GROUP BY season""",
    "p11_active_actors": "SELECT player, count(DISTINCT match_id) AS matches FROM seen GROUP BY player HAVING count(DISTINCT match_id) >= 40",
    "p12_scorecard": """
SELECT innings_no, 1 AS block, CAST(batting_position AS BIGINT) AS line, player AS name, runs, balls, fours, sixes, NULL::BIGINT AS wickets, dismissal_kind AS note FROM bat0 WHERE match_id = 12
UNION ALL SELECT innings_no, 2, row_number() OVER (PARTITION BY innings_no ORDER BY balls DESC, player), player, runs_conceded, balls, NULL, NULL, wickets, NULL FROM bowl0 WHERE match_id = 12
UNION ALL SELECT innings_no, 3, row_number() OVER (PARTITION BY innings_no ORDER BY name), name, runs, NULL, NULL, NULL, NULL, NULL FROM (
  SELECT innings_no, 'wides' AS name, wides AS runs FROM per0 WHERE match_id = 12 UNION ALL SELECT innings_no, 'no_balls', no_balls FROM per0 WHERE match_id = 12) WHERE runs > 0""",
    "p13_squad_run_leaders": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY runs DESC, player) AS INTEGER) AS rank FROM {bat_table('team, player')}) WHERE rank <= 5",
    "p13_squad_wicket_leaders": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY wickets DESC, player) AS INTEGER) AS rank FROM {bowl_table('team, player')}) WHERE rank <= 5",
    "v1_place_summary": "SELECT * FROM vsum LEFT JOIN vper USING (venue)",
    "v2_side_record_by_place": f"SELECT venue, team, count(*) AS matches, {big('sum(won)')} AS wins, {big('count(*) - sum(won)')} AS losses, {pct('sum(won)', 'count(*)')} AS win_pct FROM lf GROUP BY venue, team HAVING count(*) >= 2",
    "v3_phase_profile": f"""
SELECT CASE phase WHEN 'powerplay' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END AS phase_order, phase, {mean('runs')} AS avg_runs, {mean('wickets')} AS avg_wickets,
  {mean('balls')} AS avg_balls, count(*) AS innings, ({mean('runs')}) * 6 / ({mean('balls')}) AS run_rate FROM phase GROUP BY phase""",
    "v4_scoring_trend": f"""
SELECT season, count(runs) AS innings, {mean('runs')} AS avg_score, max(runs) AS highest, avg(run_rate) AS avg_run_rate, {mean('sixes')} AS avg_sixes, {mean('fours')} AS avg_fours
FROM per WHERE innings_no = 1 GROUP BY season""",
    "v5_place_records": f"""
SELECT s.venue, matches, first_match, last_match, highest_total, lowest_total, average_total, br.t AS biggest_win_runs, bw.t AS biggest_win_wickets
FROM (SELECT venue, count(*) AS matches, min(match_date) AS first_match, max(match_date) AS last_match FROM con WHERE is_completed GROUP BY venue) s
LEFT JOIN (SELECT venue, runs || '/' || wickets || ' by ' || batting_team AS highest_total FROM (SELECT per.*, row_number() OVER (PARTITION BY per.venue ORDER BY runs DESC, per.match_date, per.match_id, innings_no) AS r FROM per JOIN con USING (match_id) WHERE is_completed) WHERE r = 1) h ON h.venue = s.venue
LEFT JOIN (SELECT venue, runs || '/' || wickets || ' by ' || batting_team AS lowest_total FROM (SELECT per.*, row_number() OVER (PARTITION BY per.venue ORDER BY runs, per.match_date, per.match_id, innings_no) AS r FROM per JOIN con USING (match_id) WHERE is_completed) WHERE r = 1) l ON l.venue = s.venue
LEFT JOIN (SELECT per.venue, {mean('runs')} AS average_total FROM per JOIN con USING (match_id) WHERE is_completed GROUP BY per.venue) a ON a.venue = s.venue
LEFT JOIN (SELECT venue, winner || ' by ' || win_margin_runs || ' runs' AS t FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY win_margin_runs DESC, match_date, match_id) AS r FROM con WHERE is_completed AND win_margin_runs IS NOT NULL) WHERE r = 1) br ON br.venue = s.venue
LEFT JOIN (SELECT venue, winner || ' by ' || win_margin_wickets || ' wickets' AS t FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY win_margin_wickets DESC, match_date, match_id) AS r FROM con WHERE is_completed AND win_margin_wickets IS NOT NULL) WHERE r = 1) bw ON bw.venue = s.venue""",
    "v6_score_history": f"SELECT venue, season, {mean('runs')} AS avg_score, max(runs) AS highest, min(runs) AS lowest, count(runs) AS innings FROM per WHERE innings_no = 1 GROUP BY venue, season",
    "v7_place_list": "SELECT venue, count(*) AS matches FROM con WHERE venue IS NOT NULL GROUP BY venue",
    "v7_side_list": "SELECT team, max(season) >= 2001 AS is_active, CASE WHEN max(season) >= 2001 THEN 0 ELSE 1 END AS sort_group FROM slots WHERE team IS NOT NULL GROUP BY team",
    "v7_season_list": "SELECT DISTINCT season FROM con",
    "v8_events_at": "SELECT * FROM ev WHERE match_id IN (SELECT match_id FROM con WHERE venue = 'NATION_4' AND is_completed)",
    "v9_latest_results": "SELECT match_id, match_date, venue, team1, team2, winner, result_summary FROM con WHERE is_completed AND venue = 'NATION_4' ORDER BY match_date DESC, match_id DESC LIMIT 8",
    "v9_next_fixtures": "SELECT match_id, match_date, venue, team1, team2 FROM con WHERE NOT is_completed ORDER BY match_date, match_id LIMIT 8",
    "e1_contests_per_season": "SELECT season, count(*) AS matches FROM con GROUP BY season",
    "e2_place_scoring": "SELECT venue, matches, avg_first_innings, chase_win_pct FROM (SELECT * FROM vsum LEFT JOIN vper USING (venue) WHERE matches >= 5 ORDER BY matches DESC, venue LIMIT 12)",
    "e3_score_histogram": """
SELECT CAST(b AS INTEGER) AS bin, lo + b * (hi - lo) / 30.0::DOUBLE AS from_runs, count(*) AS innings, mean_runs FROM (
  SELECT lo, hi, mean_runs, least((runs - lo) * 30 // nullif(hi - lo, 0), 29) AS b FROM per,
    (SELECT min(runs) AS lo, max(runs) AS hi, avg(runs) AS mean_runs FROM per WHERE innings_no = 1) WHERE innings_no = 1)
GROUP BY b, lo, hi, mean_runs""",
    "e4_phase_rates": f"""
SELECT season, {rate("sum(runs) FILTER (WHERE phase = 'powerplay')", "sum(balls) FILTER (WHERE phase = 'powerplay')", 6)} AS powerplay,
  {rate("sum(runs) FILTER (WHERE phase = 'middle')", "sum(balls) FILTER (WHERE phase = 'middle')", 6)} AS middle,
  {rate("sum(runs) FILTER (WHERE phase = 'death')", "sum(balls) FILTER (WHERE phase = 'death')", 6)} AS death FROM phase GROUP BY season""",
    "e5_overview": """
SELECT 'first_season' AS metric, CAST(min(season) AS BIGINT) AS value FROM con UNION ALL SELECT 'last_season', max(season) FROM con
UNION ALL SELECT 'contests', count(*) FROM con UNION ALL SELECT 'completed_contests', count(*) FILTER (WHERE is_completed) FROM con
UNION ALL SELECT 'places', count(DISTINCT venue) FROM con UNION ALL SELECT 'sides', count(DISTINCT team) FROM slots
UNION ALL SELECT 'periods', count(*) FROM per0 UNION ALL SELECT 'attack_cards', count(*) FROM bat0
UNION ALL SELECT 'defence_cards', count(*) FROM bowl0 UNION ALL SELECT 'events', count(*) FROM ev""",
    "e6_leading_batters": f"SELECT * FROM {bat_table('player')} WHERE innings >= 20 ORDER BY runs DESC, player LIMIT 12",
    "e6_leading_bowlers": f"SELECT * FROM {bowl_table('player')} WHERE innings >= 20 ORDER BY wickets DESC, player LIMIT 12",
    "e6_leading_sides": "SELECT * FROM ts WHERE matches >= 10 ORDER BY win_pct DESC, team LIMIT 5",
    "x1_highest_totals": "SELECT match_id, innings_no, batting_team AS team, runs, wickets, overs, season, venue FROM per ORDER BY runs DESC, match_id, innings_no LIMIT 10",
    "x2_leading_scorers": f"SELECT player, innings, runs, balls, strike_rate, average FROM {bat_table('player')} WHERE balls > 500 ORDER BY runs DESC, player LIMIT 20",
    "x3_death_economy": f"""
SELECT bowler AS player, count(*) AS balls, {big('sum(total_runs)')} AS runs, {rate('sum(total_runs)', 'count(*)', 6)} AS economy, count(*) FILTER (WHERE is_wicket) AS wickets
FROM ev WHERE over_no >= 16 AND is_legal GROUP BY bowler HAVING count(*) >= 100 ORDER BY economy, player LIMIT 20""",
    "x4_bat_first_by_season": f"""
SELECT season, count(*) AS matches, count(*) FILTER (WHERE winner = first_batting_team) AS bat_first_wins, {pct('count(*) FILTER (WHERE winner = first_batting_team)', 'count(*)')} AS bat_first_pct
FROM con WHERE is_completed AND winner IS NOT NULL GROUP BY season""",
    "x5_contests_view": """
SELECT match_id, match_key, season, match_date, stage, is_playoff, venue, city, team1, team2, toss_winner, toss_decision, first_batting_team, winner, result_type,
  win_margin_runs, win_margin_wickets, result_summary, player_of_match, is_completed FROM cona""",
    "x6_side_records_view": f"SELECT team, count(*) AS matches, count(*) FILTER (WHERE winner = team) AS wins, {pct('count(*) FILTER (WHERE winner = team)', 'count(*)')} AS win_pct FROM slots WHERE is_completed GROUP BY team",
}
