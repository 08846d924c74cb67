"""Oracle text for standings, history features and in-play features."""

import re

from oracles.analytics import big, rate

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SIDE = "OVER (PARTITION BY team ORDER BY match_date, match_id " + BEFORE + ")"
SIDE_PLACE = "OVER (PARTITION BY team, venue ORDER BY match_date, match_id " + BEFORE + ")"
SIDE_SEASON = "OVER (PARTITION BY team, season ORDER BY match_date, match_id " + BEFORE + ")"
PAIR = "OVER (PARTITION BY pair_a, pair_b ORDER BY match_date, match_id " + BEFORE + ")"
PLACE = "OVER (PARTITION BY venue ORDER BY match_date, match_id " + BEFORE + ")"
LEAGUE = "OVER (ORDER BY match_date, match_id " + BEFORE + ")"


def last_mean(value: str, n: int, over: str, prior: str) -> str:
    """Mean of the last n non-null values."""
    tail = f"(list({value}) FILTER (WHERE {value} IS NOT NULL) {over})[-{n}:]"
    return f"CASE WHEN coalesce(len({tail}), 0) > 0 THEN CAST(list_sum({tail}) AS DOUBLE) / len({tail}) ELSE {prior} END"


def total(value: str, over: str) -> str:
    return f"coalesce(sum({value}) {over}, 0)"


def shrink(s: str, n: str) -> str:
    return f"CAST(({s}) + 2.5::DOUBLE AS DOUBLE) / (({n}) + 5.0::DOUBLE)"


ALL_MEAN = "CASE WHEN coalesce(count({v}) {o}, 0) > 0 THEN CAST(sum({v}) {o} AS DOUBLE) / (count({v}) {o}) ELSE {p} END"

CTES = {
    # Standings
    "lg": "SELECT *, is_no_result OR winner IS NULL AS shared FROM con WHERE NOT is_playoff",
    "lgs": "SELECT season, team1 AS team, winner, shared FROM lg WHERE is_completed UNION ALL SELECT season, team2, winner, shared FROM lg WHERE is_completed",
    "st0": f"""
SELECT season, team, count(*) AS played, count(*) FILTER (WHERE NOT shared AND winner = team) AS won, count(*) FILTER (WHERE NOT shared AND winner <> team) AS lost,
  count(*) FILTER (WHERE shared) AS no_result, count(*) FILTER (WHERE NOT shared AND winner = team) * 2 + count(*) FILTER (WHERE shared) AS points
FROM lgs GROUP BY season, team""",
    "fcd": """
SELECT * REPLACE (CASE WHEN forced THEN team1 ELSE winner END AS winner, is_completed OR forced AS is_completed) FROM (
  SELECT *, (NOT is_completed OR winner IS NULL) AND match_id % 2 = 0 AS forced FROM con WHERE NOT is_playoff)""",
    "fcs": """
SELECT season, t AS team, winner, is_no_result OR winner IS NULL AS shared FROM (
  SELECT *, team1 AS t FROM fcd UNION ALL SELECT *, team2 FROM fcd) WHERE is_completed""",
    "fct": """
SELECT season, team, count(*) AS played, count(*) FILTER (WHERE NOT shared AND winner = team) AS won, count(*) FILTER (WHERE NOT shared AND winner <> team) AS lost,
  count(*) FILTER (WHERE shared) AS no_result, count(*) FILTER (WHERE NOT shared AND winner = team) * 2 + count(*) FILTER (WHERE shared) AS points
FROM fcs GROUP BY season, team""",
    "chg": """
SELECT l.season, batting_team, bowling_team, runs, CASE WHEN wickets >= 10 THEN 120 ELSE balls END AS cb
FROM per0 JOIN lg l USING (match_id) WHERE l.is_completed""",
    "nrr": f"""
SELECT s.*, CAST(rf AS BIGINT) AS runs_for, CAST(bf AS BIGINT) AS balls_for, CAST(ra AS BIGINT) AS runs_against, CAST(ba AS BIGINT) AS balls_against,
  {rate('rf', 'bf', 6)} - {rate('ra', 'ba', 6)} AS net_run_rate
FROM st0 s LEFT JOIN (SELECT season, batting_team AS team, sum(runs) AS rf, sum(cb) AS bf FROM chg GROUP BY ALL) f USING (season, team)
LEFT JOIN (SELECT season, bowling_team AS team, sum(runs) AS ra, sum(cb) AS ba FROM chg GROUP BY ALL) a USING (season, team)""",
    "lft": """
SELECT season, team, count(*) AS n FROM (SELECT season, team1 AS team FROM lg WHERE NOT is_completed OR winner IS NULL
  UNION ALL SELECT season, team2 FROM lg WHERE NOT is_completed OR winner IS NULL) GROUP BY ALL""",
    # History
    "hb": """
SELECT c.*, s.r1, s.r2, is_completed AND winner IS NOT NULL AS done, is_completed AND winner IS NOT NULL AND NOT is_no_result AS decided,
  least(team1, team2) AS pair_a, greatest(team1, team2) AS pair_b,
  CASE WHEN first_batting_team IS NOT NULL THEN CASE WHEN first_batting_team = team1 THEN team2 ELSE team1 END END AS chasing_team,
  CASE WHEN is_completed AND winner IS NOT NULL AND first_batting_team IS NOT NULL THEN s.r1 END AS first_score,
  CASE WHEN is_completed AND winner IS NOT NULL AND first_batting_team IS NOT NULL THEN s.r2 END AS chase_score
FROM con c LEFT JOIN (SELECT match_id, CAST(runs1 AS BIGINT) AS r1, CAST(runs2 AS BIGINT) AS r2 FROM tot) s USING (match_id)""",
    "hp": f"""
SELECT match_id,
  {shrink(f"CASE WHEN pair_a = team1 THEN {total('CASE WHEN decided AND winner = pair_a THEN 1 ELSE 0 END', PAIR)} ELSE {total('CASE WHEN decided THEN 1 ELSE 0 END', PAIR)} - {total('CASE WHEN decided AND winner = pair_a THEN 1 ELSE 0 END', PAIR)} END", total('CASE WHEN decided THEN 1 ELSE 0 END', PAIR))} AS team1_h2h_win_rate,
  CAST({total('CASE WHEN decided THEN 1 ELSE 0 END', PAIR)} AS DOUBLE) AS h2h_matches,
  {ALL_MEAN.format(v='first_score', o=PLACE, p='165.0')} AS venue_avg_first_innings,
  {shrink(total('CASE WHEN decided AND chase_score IS NOT NULL AND winner = chasing_team THEN 1 ELSE 0 END', PLACE), total('CASE WHEN decided AND chase_score IS NOT NULL THEN 1 ELSE 0 END', PLACE))} AS venue_chase_win_rate,
  {last_mean('first_score', 40, LEAGUE, '165.0')} AS league_recent_avg_score,
  {last_mean('first_score', 10, PLACE, 'NULL')} AS vr
FROM hb""",
    "hpp": "SELECT * EXCLUDE (vr), coalesce(vr, league_recent_avg_score) AS venue_recent_avg_score FROM hp",
    "hs0": """
SELECT match_id, season, match_date, venue, done, decided, 1 AS slot, team1 AS team, CASE WHEN decided THEN CASE WHEN winner = team1 THEN 1 ELSE 0 END END AS won,
  CASE WHEN first_batting_team = team1 THEN first_score ELSE chase_score END AS scored, CASE WHEN first_batting_team = team1 THEN chase_score ELSE first_score END AS conceded FROM hb
UNION ALL
SELECT match_id, season, match_date, venue, done, decided, 2, team2, CASE WHEN decided THEN CASE WHEN winner = team2 THEN 1 ELSE 0 END END,
  CASE WHEN first_batting_team = team2 THEN first_score ELSE chase_score END, CASE WHEN first_batting_team = team2 THEN chase_score ELSE first_score END FROM hb""",
    "hs1": """
SELECT h.*, l.match_id IS NOT NULL AS listed FROM hs0 h LEFT JOIN (SELECT DISTINCT match_id, team FROM rosgap WHERE is_playing_xi) l ON l.match_id = h.match_id AND l.team = h.team""",
    "hs2": f"""
SELECT *, {total('CASE WHEN decided THEN 1 ELSE 0 END', SIDE)} AS pb, {total('won', SIDE)} AS wb,
  max(CASE WHEN done THEN match_date END) {SIDE} AS ld,
  CASE WHEN listed THEN match_id ELSE arg_max(match_id, (match_date, match_id)) FILTER (WHERE done AND listed) {SIDE} END AS rmid,
  {last_mean('won', 5, SIDE, '0.5')} AS form_short, {last_mean('won', 10, SIDE, '0.5')} AS form_long,
  {last_mean('scored', 10, SIDE, '165.0')} AS avg_runs_scored, {last_mean('conceded', 10, SIDE, '165.0')} AS avg_runs_conceded,
  {shrink(total('won', SIDE_PLACE), total('CASE WHEN decided THEN 1 ELSE 0 END', SIDE_PLACE))} AS venue_win_rate,
  {ALL_MEAN.format(v='scored', o=SIDE_PLACE, p='NULL')} AS own_venue_score,
  CAST({total('won * 2', SIDE_SEASON)} AS DOUBLE) AS season_points, CAST({total('CASE WHEN done THEN 1 ELSE 0 END', SIDE_SEASON)} AS DOUBLE) AS season_matches
FROM hs1""",
    "hs": f"""
SELECT *, {shrink('wb', 'pb')} AS career_win_rate, avg_runs_scored - avg_runs_conceded AS net_run_strength,
  CASE WHEN ld IS NULL THEN 30.0::DOUBLE ELSE CAST(least(greatest(date_diff('day', ld, match_date), 0), 30) AS DOUBLE) END AS rest_days,
  CAST(pb - coalesce(max(CASE WHEN won = 0 THEN pb + 1 END) {SIDE}, 0) AS DOUBLE) AS win_streak FROM hs2""",
    "ce": """
SELECT match_id, match_date, player, sum(runs) AS runs, sum(balls) AS balls, sum(outs) AS outs, sum(conceded) AS conceded, sum(bowled) AS bowled, sum(wickets) AS wickets, 1 AS matches
FROM (SELECT match_id, player, runs, balls, CASE WHEN is_out THEN 1 ELSE 0 END AS outs, 0 AS conceded, 0 AS bowled, 0 AS wickets FROM bat0
  UNION ALL SELECT match_id, player, 0, 0, 0, runs_conceded, balls, wickets FROM bowl0) JOIN hb USING (match_id) WHERE done GROUP BY match_id, match_date, player""",
    "sq": "SELECT h.match_id, h.match_date, h.team, r.player FROM hs h JOIN rosgap r ON r.match_id = h.rmid AND r.team = h.team WHERE r.is_playing_xi",
    "sqc": """
SELECT s.match_id, s.team, s.player, sum(runs) AS runs, sum(balls) AS balls, sum(outs) AS outs, sum(conceded) AS conceded, sum(bowled) AS bowled, sum(matches) AS matches
FROM sq s JOIN ce e ON e.player = s.player AND (e.match_date < s.match_date OR (e.match_date = s.match_date AND e.match_id < s.match_id))
GROUP BY s.match_id, s.team, s.player""",
    "sqm": """
SELECT match_id, team, list_reverse_sort(list(CASE WHEN balls >= 60 THEN CAST(runs AS DOUBLE) / greatest(outs, 1) END) FILTER (WHERE balls >= 60))[1:7] AS a,
  list_reverse_sort(list(CAST(runs AS DOUBLE) * 100 / balls) FILTER (WHERE balls >= 60))[1:7] AS r,
  list_sort(list(CAST(conceded AS DOUBLE) * 6 / bowled) FILTER (WHERE bowled >= 60))[1:5] AS e,
  CAST(sum(matches) AS DOUBLE) / count(*) AS xi_experience FROM sqc GROUP BY match_id, team""",
    "sqs": """
SELECT match_id, team, coalesce(list_avg(a), 22.0) AS xi_batting_average, coalesce(list_avg(r), 128.0) AS xi_strike_rate, coalesce(list_avg(e), 8.2) AS xi_bowling_economy, xi_experience FROM sqm""",
    "hx": "SELECT h.*, xi_batting_average, xi_strike_rate, xi_bowling_economy, xi_experience FROM hs h LEFT JOIN sqs USING (match_id, team)",
    "feat": """
SELECT b.match_id, b.match_key, b.match_date, b.team1, b.team2, b.venue, b.toss_decision, b.season,
  CASE WHEN home_team = team1 THEN 1 ELSE 0 END AS team1_is_home, CAST(is_neutral_venue AS INTEGER) AS is_neutral_venue, CAST(is_playoff AS INTEGER) AS is_playoff,
  CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END AS toss_winner_is_team1, CASE WHEN toss_decision = 'bat' THEN 1 ELSE 0 END AS toss_decision_is_bat,
  """ + ", ".join(
        f"s{i}.{c} AS team{i}_{c}"
        for i in (1, 2)
        for c in (
            "career_win_rate", "form_short", "form_long", "venue_win_rate", "avg_runs_scored", "avg_runs_conceded", "net_run_strength", "rest_days",
            "season_points", "season_matches", "win_streak", "xi_batting_average", "xi_strike_rate", "xi_bowling_economy", "xi_experience",
        )
    ) + ", " + ", ".join(
        f"s1.{c} - s2.{c} AS {c}_diff"
        for c in (
            "form_short", "form_long", "career_win_rate", "venue_win_rate", "net_run_strength", "rest_days", "season_points",
            "xi_batting_average", "xi_strike_rate", "xi_bowling_economy", "xi_experience",
        )
    ) + """,
  CASE WHEN s1.xi_batting_average IS NOT NULL AND s2.xi_batting_average IS NOT NULL THEN 1 ELSE 0 END AS has_xi_data,
  lv.* EXCLUDE (match_id), coalesce(s1.own_venue_score, venue_avg_first_innings) AS team1_venue_avg_score, coalesce(s2.own_venue_score, venue_avg_first_innings) AS team2_venue_avg_score,
  b.done AS is_completed, winner, first_batting_team, CASE WHEN b.done THEN CASE WHEN winner = team1 THEN 1 ELSE 0 END END AS target_team1_wins,
  r1 AS first_innings_runs, r2 AS second_innings_runs
FROM hb b JOIN hpp lv USING (match_id) JOIN hx s1 ON s1.match_id = b.match_id AND s1.slot = 1 JOIN hx s2 ON s2.match_id = b.match_id AND s2.slot = 2""",
    # In play
    "ch0": """
SELECT e.*, row_number() OVER w - 1 AS idx, first_value(batting_team) OVER w AS bt, first_value(bowling_team) OVER w AS bw,
  sum(total_runs) OVER w AS cr, sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS cw, sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS cb
FROM ev e WHERE innings_no = 2 WINDOW w AS (PARTITION BY match_id ORDER BY ball_seq)""",
    "ch1": """
SELECT *, cr - coalesce(lag(cr, 30) OVER w, first_value(cr) OVER w) AS r5, cw - coalesce(lag(cw, 30) OVER w, first_value(cw) OVER w) AS w5
FROM ch0 WINDOW w AS (PARTITION BY match_id ORDER BY ball_seq)""",
    "ch2": """
SELECT c.match_id, c.ball_seq, m.season, m.match_date, bt AS batting_team, bw AS bowling_team, m.venue, CAST(runs1 + 1 AS BIGINT) AS target, CAST(cr AS BIGINT) AS current_runs,
  CAST(cw AS BIGINT) AS wickets_fallen, CAST(cb AS BIGINT) AS balls_bowled, CAST(over_no AS BIGINT) AS over_no, CAST(r5 AS BIGINT) AS runs_last_5_overs, CAST(w5 AS BIGINT) AS wickets_last_5_overs,
  CASE WHEN winner = bt THEN 1 ELSE 0 END AS target_chase_success
FROM ch1 c JOIN tot t ON t.match_id = c.match_id JOIN con m ON m.match_id = c.match_id
WHERE m.is_completed AND m.winner IS NOT NULL AND NOT m.is_no_result AND cw < 10 AND cr < runs1 + 1""",
    "aw2": """
SELECT match_id, player, team, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(fours) AS BIGINT) AS fours, CAST(sum(sixes) AS BIGINT) AS sixes,
  CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(rc) AS BIGINT) AS runs_conceded, CAST(sum(bb) AS BIGINT) AS balls_bowled, CAST(sum(maidens) AS BIGINT) AS maidens
FROM (SELECT match_id, player, team, runs, balls, fours, sixes, 0 AS wickets, 0 AS rc, 0 AS bb, 0 AS maidens FROM bat0
  UNION ALL SELECT match_id, player, team, 0, 0, 0, 0, wickets, runs_conceded, balls, maidens FROM bowl0) GROUP BY ALL""",
    "aw3": f"""
SELECT a.*, c.season, {'coalesce(' + rate('runs', 'balls', 100) + ', 0.0)'} AS strike_rate, {'coalesce(' + rate('runs_conceded', 'balls_bowled', 6) + ', 0.0)'} AS economy, fours * 4 + sixes * 6 AS boundary_runs,
  CASE WHEN winner = team THEN 1 ELSE 0 END AS team_won, CASE WHEN player_of_match IS NOT NULL THEN CASE WHEN player_of_match = player THEN 1 ELSE 0 END END AS target_is_award
FROM aw2 a JOIN cona c USING (match_id)""",
    "aw4": "SELECT *, runs + (strike_rate - 130) * balls / 100.0::DOUBLE AS batting_impact, wickets * 20 - (economy - 8) * (balls_bowled / 6.0::DOUBLE) AS bowling_impact FROM aw3",
    "aw5": "SELECT *, batting_impact + bowling_impact AS total_impact FROM aw4",
}


# The same chain with the requested fixtures appended after all contests.
CTES["req"] = """
SELECT match_id AS request_id, team2 AS team1, team1 AS team2, venue, season, CAST(match_date + INTERVAL 3 DAY AS DATE) AS match_date, toss_winner, toss_decision, is_playoff, is_neutral_venue FROM con"""
CTES["hbq"] = """
SELECT * FROM hb UNION ALL BY NAME SELECT -row_number() OVER (ORDER BY team1, team2, venue, season) AS match_id, team1, team2, venue, season, DATE '9001-01-01' AS match_date,
  false AS done, false AS decided, false AS is_completed, least(team1, team2) AS pair_a, greatest(team1, team2) AS pair_b FROM (SELECT DISTINCT team1, team2, venue, season FROM req)"""
for _name in ("hp", "hpp", "hs0", "hs1", "hs2", "hs", "sq", "sqc", "sqm", "sqs", "hx", "feat"):
    CTES[_name + "q"] = re.sub(
        r"\b(FROM|JOIN) (hb|hpp|hp|hs0|hs1|hs2|hs|sqc|sqm|sqs|sq|hx)\b", r"\1 \2q", CTES[_name]
    )


def state(prefix: str = "") -> str:
    need = "CASE WHEN 120 - balls_bowled > 0 THEN least(CAST(greatest(target - current_runs, 0) * 6 AS DOUBLE) / (120 - balls_bowled), 99.0::DOUBLE) ELSE 99.0::DOUBLE END"
    now = "CASE WHEN balls_bowled > 0 THEN CAST(current_runs * 6 AS DOUBLE) / balls_bowled ELSE 0.0::DOUBLE END"
    return f"""10 - wickets_fallen AS wickets_in_hand, greatest(120 - balls_bowled, 0) AS balls_remaining, greatest(target - current_runs, 0) AS runs_required,
  {now} AS current_run_rate, {need} AS required_run_rate, ({need}) - ({now}) AS run_rate_pressure, CAST(current_runs AS DOUBLE) / target AS chase_progress,
  CASE WHEN over_no <= 6 THEN 1 ELSE 0 END AS is_powerplay, CASE WHEN over_no >= 16 THEN 1 ELSE 0 END AS is_death"""


SIDE_PICK = "SELECT match_id, team, {c} FROM hs WHERE done"
LIVE = "(SELECT *, balls_bowled // 6 + 1 AS over_no FROM (SELECT match_id, ball_seq, batting_team, bowling_team, venue, target, current_runs, wickets_fallen, balls_bowled, runs_last_5_overs, wickets_last_5_overs FROM ch2))"

SQL = {
    "r1_standings": "SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, won DESC, team) AS INTEGER) AS position FROM st0",
    "r7_forced_standings": "SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, won DESC, team) AS INTEGER) AS position FROM fct",
    "r2_net_run_rate": "SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, net_run_rate DESC NULLS LAST, team) AS INTEGER) AS position FROM nrr",
    "r3_remaining_fixtures": "SELECT match_id, season, team1, team2, venue FROM lg WHERE NOT is_completed OR winner IS NULL",
    "r6_remaining_per_side": """
SELECT season, team, coalesce(points, 0) AS current_points, coalesce(played, 0) AS matches_played, coalesce(n, 0) AS matches_remaining, coalesce(points, 0) + 2 * coalesce(n, 0) AS max_possible_points
FROM st0 FULL JOIN lft USING (season, team)""",
    "f1_career_win_rate": SIDE_PICK.format(c="career_win_rate"),
    "f2_form": SIDE_PICK.format(c="form_short, form_long"),
    "f3_run_averages": SIDE_PICK.format(c="avg_runs_scored, avg_runs_conceded"),
    "f4_win_streak": SIDE_PICK.format(c="win_streak"),
    "f5_head_to_head_rate": "SELECT match_id, team1_h2h_win_rate, h2h_matches FROM hpp",
    "f6_side_rate_at_place": SIDE_PICK.format(c="venue_win_rate"),
    "f7_place_levels": "SELECT match_id, venue_avg_first_innings, venue_chase_win_rate FROM hpp",
    "f8_side_score_at_place": "SELECT match_id, team1_venue_avg_score, team2_venue_avg_score FROM feat",
    "f9_league_recent_level": "SELECT match_id, league_recent_avg_score FROM hpp",
    "f10_place_recent_level": "SELECT match_id, venue_recent_avg_score FROM hpp",
    "f11_rest_days": SIDE_PICK.format(c="rest_days"),
    "f12_season_points": SIDE_PICK.format(c="season_points, season_matches"),
    "f13_career_before": """
SELECT match_id, player, """ + ", ".join(
        f"CAST(coalesce(sum({c}) OVER (PARTITION BY player ORDER BY match_date, match_id {BEFORE}), 0) AS BIGINT) AS career_{c}"
        for c in ("runs", "balls", "outs", "conceded", "bowled", "wickets", "matches")
    ) + " FROM ce",
    "f14_squad_strength": "SELECT match_id, team, round(xi_batting_average, 6) AS xi_batting_average, round(xi_strike_rate, 6) AS xi_strike_rate, round(xi_bowling_economy, 6) AS xi_bowling_economy, xi_experience FROM sqs",
    "f15_contest_features": "SELECT * EXCLUDE (winner, first_batting_team, target_team1_wins, first_innings_runs, second_innings_runs) REPLACE ("
    + ", ".join(
        f"round({c}, 6) AS {c}"
        for c in [f"team{i}_xi_{m}" for i in (1, 2) for m in ("batting_average", "strike_rate", "bowling_economy")]
        + [f"xi_{m}_diff" for m in ("batting_average", "strike_rate", "bowling_economy")]
    ) + ") FROM feat",
    "f16_targets": "SELECT match_id, winner, first_batting_team, target_team1_wins, first_innings_runs, second_innings_runs FROM feat",
    "f17_score_features": """
SELECT match_id, match_date, season, venue, first_batting_team AS batting_team, CASE WHEN f THEN team2 ELSE team1 END AS bowling_team, is_neutral_venue, is_playoff,
  CASE WHEN f THEN team1_is_home ELSE 0 END AS batting_is_home, CASE WHEN f THEN toss_winner_is_team1 ELSE 1 - toss_winner_is_team1 END AS batting_won_toss,
  CASE WHEN f THEN team1_career_win_rate ELSE team2_career_win_rate END AS batting_career_win_rate, CASE WHEN f THEN team1_form_short ELSE team2_form_short END AS batting_form_short,
  CASE WHEN f THEN team2_form_short ELSE team1_form_short END AS bowling_form_short, CASE WHEN f THEN team1_avg_runs_scored ELSE team2_avg_runs_scored END AS batting_avg_runs_scored,
  CASE WHEN f THEN team2_avg_runs_conceded ELSE team1_avg_runs_conceded END AS bowling_avg_runs_conceded, venue_avg_first_innings,
  CASE WHEN f THEN team1_venue_avg_score ELSE team2_venue_avg_score END AS batting_venue_avg_score, CASE WHEN f THEN team1_rest_days ELSE team2_rest_days END AS batting_rest_days,
  league_recent_avg_score, venue_recent_avg_score, round(CASE WHEN f THEN team1_xi_batting_average ELSE team2_xi_batting_average END, 6) AS batting_xi_batting_average,
  round(CASE WHEN f THEN team1_xi_strike_rate ELSE team2_xi_strike_rate END, 6) AS batting_xi_strike_rate,
  round(CASE WHEN f THEN team2_xi_bowling_economy ELSE team1_xi_bowling_economy END, 6) AS bowling_xi_bowling_economy, first_innings_runs AS target_first_innings_runs
FROM (SELECT *, coalesce(first_batting_team = team1, false) AS f FROM feat WHERE is_completed AND first_innings_runs IS NOT NULL)""",
    "f18_mirror": """
SELECT match_id, team2 AS team1, team1 AS team2, team2_career_win_rate AS team1_career_win_rate, team1_rest_days AS team2_rest_days, -form_short_diff AS form_short_diff, -rest_days_diff AS rest_days_diff,
  0 AS team1_is_home, 1 - toss_winner_is_team1 AS toss_winner_is_team1, 1 - team1_h2h_win_rate AS team1_h2h_win_rate, 1 - target_team1_wins AS target_team1_wins, true AS is_mirrored
FROM feat WHERE is_completed""",
    "f19_featurise_requests": """
SELECT q.request_id, q.match_date, q.team1, q.team2, q.venue, q.toss_decision, q.season, 1 AS team1_is_home, CAST(q.is_neutral_venue AS INTEGER) AS is_neutral_venue,
  CAST(q.is_playoff AS INTEGER) AS is_playoff, CASE WHEN q.toss_winner = q.team1 THEN 1 ELSE 0 END AS toss_winner_is_team1, CASE WHEN q.toss_decision = 'bat' THEN 1 ELSE 0 END AS toss_decision_is_bat,
  """ + ", ".join(
        [f"f.team{i}_{c}" for i in (1, 2) for c in ("career_win_rate", "form_short", "form_long", "venue_win_rate", "avg_runs_scored", "avg_runs_conceded", "net_run_strength", "season_points", "season_matches", "win_streak", "venue_avg_score", "xi_experience")]
        + [f"round(f.team{i}_xi_{m}, 6) AS team{i}_xi_{m}" for i in (1, 2) for m in ("batting_average", "strike_rate", "bowling_economy")]
        + [f"round(f.xi_{m}_diff, 6) AS xi_{m}_diff" for m in ("batting_average", "strike_rate", "bowling_economy")]
        + [f"f.{c}" for c in ("form_short_diff", "form_long_diff", "career_win_rate_diff", "venue_win_rate_diff", "net_run_strength_diff", "season_points_diff", "xi_experience_diff", "team1_h2h_win_rate", "h2h_matches", "venue_avg_first_innings", "venue_chase_win_rate", "league_recent_avg_score", "venue_recent_avg_score", "has_xi_data")]
        + [f"coalesce(CAST(least(greatest(date_diff('day', s{i}.ld, q.match_date), 0), 30) AS DOUBLE), 30.0::DOUBLE) AS team{i}_rest_days" for i in (1, 2)]
    ) + """,
  coalesce(CAST(least(greatest(date_diff('day', s1.ld, q.match_date), 0), 30) AS DOUBLE), 30.0::DOUBLE) - coalesce(CAST(least(greatest(date_diff('day', s2.ld, q.match_date), 0), 30) AS DOUBLE), 30.0::DOUBLE) AS rest_days_diff
FROM req q JOIN featq f ON f.match_id < 0 AND f.team1 = q.team1 AND f.team2 = q.team2 AND f.venue = q.venue AND f.season = q.season
JOIN hsq s1 ON s1.match_id = f.match_id AND s1.slot = 1 JOIN hsq s2 ON s2.match_id = f.match_id AND s2.slot = 2""",
    "f20_drivers": """
SELECT match_id, label, team1_value, team2_value, unit FROM (
  SELECT match_id, 'Recent form (last 5)' AS label, team1_form_short * 100 AS team1_value, team2_form_short * 100 AS team2_value, '%' AS unit FROM feat WHERE is_completed
  UNION ALL SELECT match_id, 'Career win rate', team1_career_win_rate * 100, team2_career_win_rate * 100, '%' FROM feat WHERE is_completed
  UNION ALL SELECT match_id, 'Head-to-head', team1_h2h_win_rate * 100, NULL, '%' FROM feat WHERE is_completed
  UNION ALL SELECT match_id, 'Record at this venue', team1_venue_win_rate * 100, team2_venue_win_rate * 100, '%' FROM feat WHERE is_completed
  UNION ALL SELECT match_id, 'Avg runs scored', team1_avg_runs_scored, team2_avg_runs_scored, '' FROM feat WHERE is_completed
  UNION ALL SELECT match_id, 'Rest days', team1_rest_days, team2_rest_days, '' FROM feat WHERE is_completed)""",
    "c1_chase_features": f"SELECT *, {state()} FROM ch2",
    "c2_chase_rows": f"SELECT *, {state()} FROM {LIVE}",
    "c3_award_features": "SELECT match_id, player, team, season, runs, balls, fours, sixes, wickets, runs_conceded, balls_bowled, maidens, strike_rate, economy, boundary_runs, team_won, target_is_award, batting_impact, bowling_impact, total_impact FROM aw5",
    "c4_within_contest": """
SELECT match_id, player, team, """ + ", ".join(
        f"CAST(rank() OVER (PARTITION BY match_id ORDER BY {c} DESC) AS DOUBLE) AS {c}_rank, "
        f"round({c} / (CASE WHEN round(sum(abs({c})) OVER (PARTITION BY match_id), 9) = 0 THEN 1.0::DOUBLE ELSE sum(abs({c})) OVER (PARTITION BY match_id) END), 6) AS {c}_share"
        for c in ("total_impact", "runs", "wickets")
    ) + " FROM aw5",
    "c5_terminal_overrides": """
SELECT match_id, current_runs, target, wickets_fallen, balls_bowled, CASE WHEN current_runs >= target THEN 1.0::DOUBLE WHEN wickets_fallen >= 10 OR balls_bowled >= 120 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS probability
FROM (SELECT match_id, CAST(runs2 AS BIGINT) AS current_runs, CAST(runs1 + 1 AS BIGINT) AS target, wickets AS wickets_fallen, balls AS balls_bowled FROM tot JOIN per0 USING (match_id) WHERE innings_no = 2)""",
    "c6_sensitivity_rows": f"""
SELECT match_id, ball_seq, current_runs, target, {state().split(' AS wickets_in_hand, ')[1]} FROM (
  SELECT DISTINCT * EXCLUDE (x) REPLACE (least(current_runs + x, target - 1) AS current_runs) FROM {LIVE}, (SELECT unnest(range(0, 61, 5)) AS x))""",
}
