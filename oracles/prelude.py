"""The adapter tables of ``FIXTURES.md`` section 3 as DuckDB CTEs."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["raw"] = """
SELECT *, l_orderkey // 60 AS match_id, CAST(1 + l_orderkey % 2 AS INTEGER) AS innings_no,
  l_discount = 0.0 AS is_wide, l_discount = 0.01 AS is_no_ball,
  NOT (l_discount = 0.0 OR l_discount = 0.01) AS is_legal,
  CASE WHEN CAST(l_quantity AS INTEGER) % 10 <= 4 THEN 0 WHEN CAST(l_quantity AS INTEGER) % 10 <= 7 THEN 1
       WHEN CAST(l_quantity AS INTEGER) % 10 = 8 THEN 4 ELSE 6 END AS batter_runs,
  CASE WHEN l_discount = 0.0 OR l_discount = 0.01 THEN 1 ELSE 0 END AS extra_runs,
  (l_returnflag = 'R' AND CAST(l_quantity AS INTEGER) % 6 = 0) AS is_wicket
FROM lineitem"""

CTES["lines"] = "SELECT *, batter_runs + extra_runs AS total_runs FROM raw"

CTES["ordtop"] = """
SELECT *, o_orderkey // 60 AS match_id,
  row_number() OVER (PARTITION BY o_orderkey // 60 ORDER BY o_totalprice DESC, o_orderkey DESC) AS top,
  avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_orderkey // 60) AS pending
FROM orders"""

CTES["fix"] = """
SELECT match_id, o_custkey, o_orderdate AS start_datetime,
  CAST(o_orderdate AS DATE) AS match_date, CAST(year(o_orderdate) AS INTEGER) AS season,
  pending < 0.36 AS is_completed,
  CAST(c_nationkey % 10 AS BIGINT) AS team1_key,
  CAST((c_nationkey % 10 + 1 + o_custkey % 9) % 10 AS BIGINT) AS team2_key,
  match_id % 25 AS place_key
FROM ordtop JOIN customer ON o_custkey = c_custkey WHERE top = 1"""

CTES["hdr"] = """
SELECT f.*, a.n_name AS team1, b.n_name AS team2, p.n_name AS venue, r_name AS city,
  ((o_custkey % 2 = 0) = (o_custkey % 3 = 0)) AS first_is_team1,
  CASE WHEN (o_custkey % 2 = 0) = (o_custkey % 3 = 0) THEN a.n_name ELSE b.n_name END AS bat1,
  CASE WHEN (o_custkey % 2 = 0) = (o_custkey % 3 = 0) THEN b.n_name ELSE a.n_name END AS bat2
FROM fix f JOIN nation a ON a.n_nationkey = team1_key JOIN nation b ON b.n_nationkey = team2_key
JOIN nation p ON p.n_nationkey = place_key JOIN region ON r_regionkey = p.n_regionkey"""

CTES["ev0"] = """
SELECT l.*, bat1, bat2, season, match_date,
  CAST(row_number() OVER w AS INTEGER) AS ball_seq,
  CAST(coalesce(sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 6 + 1 AS INTEGER) AS over_no
FROM lines l JOIN hdr USING (match_id)
WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"""

CTES["ev"] = """
SELECT match_id, innings_no, over_no,
  CAST(row_number() OVER (PARTITION BY match_id, innings_no, over_no ORDER BY ball_seq) AS INTEGER) AS ball_no,
  ball_seq, batter_runs, extra_runs, total_runs, is_legal, is_wide, is_no_ball,
  batter_runs = 4 AS is_four, batter_runs = 6 AS is_six, is_wicket,
  CASE WHEN is_wicket THEN CASE l_suppkey % 5 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'lbw'
       WHEN 3 THEN 'run out' ELSE 'retired hurt' END END AS wicket_type,
  CASE innings_no WHEN 1 THEN bat1 ELSE bat2 END AS batting_team,
  CASE innings_no WHEN 1 THEN bat2 ELSE bat1 END AS bowling_team,
  (CASE innings_no WHEN 1 THEN bat1 ELSE bat2 END) || '_P' || (l_partkey % 11) AS batter,
  (CASE innings_no WHEN 1 THEN bat1 ELSE bat2 END) || '_P' || ((l_partkey + 1) % 11) AS non_striker,
  (CASE innings_no WHEN 1 THEN bat2 ELSE bat1 END) || '_P' || ((match_id + over_no) % 6) AS bowler,
  CASE WHEN is_wicket THEN (CASE innings_no WHEN 1 THEN bat1 ELSE bat2 END) || '_P' || (l_partkey % 11) END AS dismissed,
  season, match_date
FROM ev0"""

CTES["tot"] = """
SELECT match_id, sum(CASE WHEN innings_no = 1 THEN total_runs END) AS runs1,
  sum(CASE WHEN innings_no = 2 THEN total_runs END) AS runs2,
  sum(CASE WHEN innings_no = 2 AND is_wicket THEN 1 ELSE 0 END) AS wickets2
FROM lines GROUP BY match_id"""

CTES["con0"] = """
SELECT h.*, runs1, runs2, wickets2, match_id % 50 = 7 AS is_no_result,
  is_completed AND match_id % 50 <> 7 AND runs1 > runs2 AS first_won,
  is_completed AND match_id % 50 <> 7 AND runs2 > runs1 AS chase_won,
  is_completed AND match_id % 50 <> 7 AND runs1 = runs2 AS tied
FROM hdr h LEFT JOIN tot USING (match_id)"""

CTES["con1"] = """
SELECT *,
  CASE WHEN first_won THEN bat1 WHEN chase_won THEN bat2 END AS winner,
  CASE WHEN is_completed AND is_no_result THEN 'no result' WHEN tied THEN 'tie' WHEN first_won THEN 'runs'
       WHEN chase_won THEN 'wickets' END AS result_type,
  CAST(CASE WHEN first_won THEN runs1 - runs2 END AS INTEGER) AS win_margin_runs,
  CAST(CASE WHEN chase_won THEN greatest(10 - wickets2, 0) END AS INTEGER) AS win_margin_wickets
FROM con0"""

CTES["con"] = """
SELECT match_id, 'feed:' || season || ':' || match_id AS match_key, season, match_date, start_datetime,
  'Match ' || (match_id % 70 + 1) AS match_number,
  CASE WHEN match_id % 21 = 0 THEN 'Final' WHEN match_id % 7 = 0 THEN 'Qualifier' ELSE 'League' END AS stage,
  match_id % 7 = 0 AS is_playoff,
  CASE WHEN match_id % 5 = 0 THEN 'supplement' ELSE 'official' END AS source, city,
  match_id % 9 = 0 AS is_neutral_venue, is_completed,
  CASE WHEN o_custkey % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision, result_type,
  win_margin_runs, win_margin_wickets, coalesce(tied, false) AS is_tie, is_no_result,
  match_id % 40 = 3 AS is_super_over, match_id % 23 = 0 AS is_dls_applied,
  CAST(runs1 + 1 AS INTEGER) AS target_runs,
  CASE result_type WHEN 'no result' THEN 'Match abandoned without a result' WHEN 'tie' THEN 'Match Tied'
    WHEN 'runs' THEN winner || ' Won by ' || win_margin_runs || ' Runs'
    WHEN 'wickets' THEN winner || ' Won by ' || win_margin_wickets || ' Wickets' END AS result_summary,
  20 AS overs_per_innings, venue, team1, team2, team1 AS home_team, team2 AS away_team,
  CASE WHEN o_custkey % 2 = 0 THEN team1 ELSE team2 END AS toss_winner,
  CASE WHEN match_id % 11 <> 0 THEN bat1 END AS first_batting_team,
  CASE WHEN match_id % 11 <> 0 THEN bat2 END AS second_batting_team, winner
FROM con1"""

CTES["aw0"] = """
SELECT match_id, innings_no, l_partkey % 11 AS number, sum(batter_runs) AS scored
FROM lines GROUP BY match_id, innings_no, l_partkey % 11"""

CTES["aw1"] = """
SELECT match_id, (CASE innings_no WHEN 1 THEN bat1 ELSE bat2 END) || '_P' || number AS name, scored
FROM aw0 JOIN hdr USING (match_id)"""

CTES["aw"] = """
SELECT match_id, name AS player_of_match FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY scored DESC, name) AS rn FROM aw1) WHERE rn = 1"""

CTES["cona"] = """
SELECT con.*, CASE WHEN is_completed AND NOT is_no_result THEN player_of_match END AS player_of_match
FROM con LEFT JOIN aw USING (match_id)"""

CTES["ros"] = """
SELECT match_id, CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) <> 10 AS is_playing_xi,
  CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) = 0 AS is_captain,
  CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) = 1 AS is_wicketkeeper,
  CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) % 4 = 3 AS is_overseas,
  CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) + 1 AS playing_order,
  CASE WHEN CAST(regexp_extract(player, '_P([0-9]+)$', 1) AS INTEGER) < 6 THEN 'batter' ELSE 'bowler' END AS role,
  player, team, season, match_date
FROM (SELECT DISTINCT match_id, batter AS player, batting_team AS team, season, match_date FROM ev
      UNION SELECT DISTINCT match_id, bowler, bowling_team, season, match_date FROM ev)"""

# Rosters with gaps, for the last-known-roster rule.
CTES["rosgap"] = "SELECT * FROM ros WHERE match_id % 13 <> 5"

# Scorecards derived from the event stream.
CTES["app"] = """
SELECT match_id, innings_no, batting_team, player, min(rk) AS first_seen FROM (
  SELECT match_id, innings_no, batting_team, batter AS player, ball_seq * 3 AS rk FROM ev WHERE batter IS NOT NULL
  UNION ALL SELECT match_id, innings_no, batting_team, non_striker, ball_seq * 3 + 1 FROM ev WHERE non_striker IS NOT NULL
  UNION ALL SELECT match_id, innings_no, batting_team, coalesce(dismissed, batter), ball_seq * 3 + 2 FROM ev WHERE is_wicket)
WHERE player IS NOT NULL GROUP BY ALL"""

CTES["batsum"] = """
SELECT match_id, innings_no, batter AS player, sum(batter_runs) AS runs,
  sum(CASE WHEN NOT is_wide THEN 1 ELSE 0 END) AS balls,
  sum(CASE WHEN NOT is_wide AND total_runs = 0 THEN 1 ELSE 0 END) AS dots,
  sum(CASE WHEN is_four THEN 1 ELSE 0 END) AS fours, sum(CASE WHEN is_six THEN 1 ELSE 0 END) AS sixes
FROM ev GROUP BY match_id, innings_no, batter"""

CTES["wk"] = """
SELECT *, row_number() OVER (PARTITION BY match_id, innings_no ORDER BY ball_seq) AS wicket_no
FROM ev WHERE is_wicket"""

CTES["lastout"] = """
SELECT match_id, innings_no, coalesce(dismissed, batter) AS player, wicket_type AS kind, wicket_no, bowler
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, innings_no, coalesce(dismissed, batter) ORDER BY ball_seq DESC) AS rn FROM wk)
WHERE rn = 1"""

CTES["lastcred"] = """
SELECT match_id, innings_no, coalesce(dismissed, batter) AS player, arg_max(bowler, ball_seq) AS credited
FROM wk WHERE lower(wicket_type) IN ('bowled', 'caught', 'lbw', 'stumped', 'caught and bowled', 'hit wicket')
GROUP BY ALL"""

CTES["bat0"] = """
SELECT a.match_id, a.innings_no,
  CAST(row_number() OVER (PARTITION BY a.match_id, a.innings_no ORDER BY first_seen) AS INTEGER) AS batting_position,
  CAST(coalesce(runs, 0) AS BIGINT) AS runs, CAST(coalesce(balls, 0) AS BIGINT) AS balls,
  CAST(coalesce(dots, 0) AS BIGINT) AS dot_balls, CAST(coalesce(fours, 0) AS BIGINT) AS fours,
  CAST(coalesce(sixes, 0) AS BIGINT) AS sixes,
  CASE WHEN balls > 0 THEN CAST(runs * 100 AS DOUBLE) / balls END AS strike_rate,
  coalesce(lower(kind) NOT IN ('retired hurt', 'retired not out'), false) AS is_out,
  coalesce(kind, 'not out') AS dismissal_kind, credited AS bowler, CAST(wicket_no AS INTEGER) AS wicket_number,
  a.player, a.batting_team AS team
FROM app a LEFT JOIN batsum b ON a.match_id = b.match_id AND a.innings_no = b.innings_no AND a.player = b.player
LEFT JOIN lastout o ON a.match_id = o.match_id AND a.innings_no = o.innings_no AND a.player = o.player
LEFT JOIN lastcred c ON a.match_id = c.match_id AND a.innings_no = c.innings_no AND a.player = c.player"""

CTES["bat"] = """
SELECT b.*, season, match_date, venue, CASE WHEN b.team = team1 THEN team2 ELSE team1 END AS opposition
FROM bat0 b JOIN con c USING (match_id)"""

CTES["bowlover"] = """
SELECT match_id, innings_no, bowling_team, bowler, over_no, min(ball_seq) AS first_seen,
  sum(CASE WHEN is_legal THEN 1 ELSE 0 END) AS balls, sum(total_runs) AS runs,
  sum(CASE WHEN lower(wicket_type) IN ('bowled', 'caught', 'lbw', 'stumped', 'caught and bowled', 'hit wicket') THEN 1 ELSE 0 END) AS wickets,
  sum(CASE WHEN is_wide THEN extra_runs ELSE 0 END) AS wides,
  sum(CASE WHEN is_no_ball THEN extra_runs ELSE 0 END) AS no_balls,
  sum(CASE WHEN is_legal AND total_runs = 0 THEN 1 ELSE 0 END) AS dots
FROM ev GROUP BY ALL"""

CTES["bowl0"] = """
SELECT match_id, innings_no, bowling_team AS team, bowler AS player,
  CAST(row_number() OVER (PARTITION BY match_id, innings_no ORDER BY min(first_seen)) AS INTEGER) AS bowling_order,
  CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(CASE WHEN runs = 0 AND balls >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS maidens,
  CAST(sum(runs) AS BIGINT) AS runs_conceded, CAST(sum(wickets) AS BIGINT) AS wickets,
  CAST(sum(wides) AS BIGINT) AS wides, CAST(sum(no_balls) AS BIGINT) AS no_balls, CAST(sum(dots) AS BIGINT) AS dot_balls,
  CASE WHEN sum(balls) > 0 THEN CAST(sum(runs) * 6 AS DOUBLE) / sum(balls) END AS economy,
  CAST(sum(balls) // 6 * 10 + sum(balls) % 6 AS DOUBLE) / 10.0 AS overs
FROM bowlover GROUP BY match_id, innings_no, bowling_team, bowler"""

CTES["bowl"] = """
SELECT b.*, season, match_date, venue, CASE WHEN b.team = team1 THEN team2 ELSE team1 END AS opposition
FROM bowl0 b JOIN con c USING (match_id)"""

CTES["per0"] = """
SELECT match_id, innings_no, batting_team, bowling_team,
  CAST(sum(total_runs) AS BIGINT) AS runs, count(*) FILTER (WHERE is_wicket) AS wickets,
  count(*) FILTER (WHERE is_legal) AS balls,
  CAST(sum(extra_runs) AS BIGINT) AS extras,
  CAST(sum(CASE WHEN is_wide THEN extra_runs ELSE 0 END) AS BIGINT) AS wides,
  CAST(sum(CASE WHEN is_no_ball THEN extra_runs ELSE 0 END) AS BIGINT) AS no_balls,
  CAST(sum(CASE WHEN over_no <= 6 THEN total_runs ELSE 0 END) AS BIGINT) AS powerplay_runs,
  count(*) FILTER (WHERE over_no <= 6 AND is_wicket) AS powerplay_wickets,
  CAST(sum(CASE WHEN over_no > 6 AND over_no < 16 THEN total_runs ELSE 0 END) AS BIGINT) AS middle_runs,
  count(*) FILTER (WHERE over_no > 6 AND over_no < 16 AND is_wicket) AS middle_wickets,
  CAST(sum(CASE WHEN over_no >= 16 THEN total_runs ELSE 0 END) AS BIGINT) AS death_runs,
  count(*) FILTER (WHERE over_no >= 16 AND is_wicket) AS death_wickets,
  count(*) FILTER (WHERE is_four) AS fours, count(*) FILTER (WHERE is_six) AS sixes,
  count(*) FILTER (WHERE is_legal AND total_runs = 0) AS dot_balls
FROM ev GROUP BY match_id, innings_no, batting_team, bowling_team"""

CTES["per"] = """
SELECT p.*, CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 AS overs,
  CASE WHEN balls > 0 THEN CAST(runs * 6 AS DOUBLE) / balls END AS run_rate,
  season, match_date, venue FROM per0 p JOIN con c USING (match_id)"""

CTES["dis"] = """
SELECT e.match_id, e.innings_no, CAST(wn AS INTEGER) AS wicket_no, coalesce(dismissed, batter) AS player, batting_team AS team,
  CAST(score AS BIGINT) AS fall_score, CAST(lg // 6 * 10 + lg % 6 AS DOUBLE) / 10.0 AS fall_overs, season
FROM (SELECT *, sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS wn, sum(total_runs) OVER w AS score,
        sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS lg FROM ev
      WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY ball_seq)) e WHERE is_wicket"""

CTES["isl"] = """
SELECT *, 1 + coalesce(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wicket_no,
  sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS lg
FROM ev WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY ball_seq)"""

CTES["isl2"] = """
SELECT match_id, innings_no, wicket_no, batting_team, season, match_date, sum(total_runs) AS runs,
  sum(CASE WHEN is_wide THEN 0 ELSE 1 END) AS balls, sum(extra_runs) AS extras, bool_or(is_wicket) AS broken,
  arg_max(batter, ball_seq) AS striker, arg_max(non_striker, ball_seq) AS non_striker, max(lg) AS lg
FROM isl GROUP BY match_id, innings_no, wicket_no, batting_team, season, match_date"""

CTES["mem"] = """
SELECT match_id, innings_no, wicket_no, batter, sum(batter_runs) AS mr, sum(CASE WHEN is_wide THEN 0 ELSE 1 END) AS mb
FROM isl GROUP BY match_id, innings_no, wicket_no, batter"""

CTES["std"] = """
SELECT i.match_id, i.innings_no, CAST(i.wicket_no AS INTEGER) AS wicket_no, CAST(runs AS BIGINT) AS runs, CAST(balls AS BIGINT) AS balls,
  CAST(coalesce(s.mr, 0) AS BIGINT) AS striker_runs, CAST(coalesce(s.mb, 0) AS BIGINT) AS striker_balls,
  CAST(coalesce(n.mr, 0) AS BIGINT) AS non_striker_runs, CAST(coalesce(n.mb, 0) AS BIGINT) AS non_striker_balls,
  CAST(extras AS BIGINT) AS extras,
  CASE WHEN i.wicket_no = 1 THEN 0.1 ELSE CAST(prev // 6 * 10 + prev % 6 AS DOUBLE) / 10.0 END AS start_over,
  CAST(lg // 6 * 10 + lg % 6 AS DOUBLE) / 10.0 AS end_over, NOT broken AS is_unbroken, striker, non_striker, batting_team AS team, season, match_date
FROM (SELECT *, lag(lg) OVER (PARTITION BY match_id, innings_no ORDER BY wicket_no) AS prev FROM isl2) i
LEFT JOIN mem s ON i.match_id = s.match_id AND i.innings_no = s.innings_no AND i.wicket_no = s.wicket_no AND s.batter = striker
LEFT JOIN mem n ON i.match_id = n.match_id AND i.innings_no = n.innings_no AND i.wicket_no = n.wicket_no AND n.batter = i.non_striker
WHERE broken OR balls > 0"""

CTES["lf"] = """
SELECT * FROM (
SELECT match_id, season, match_date, venue, team1 AS team, team2 AS opponent, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS won,
  CASE WHEN home_team = team1 THEN 1 ELSE 0 END AS is_home, is_playoff, CASE WHEN first_batting_team = team1 THEN 1 ELSE 0 END AS batted_first,
  CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END AS won_toss, toss_decision, is_no_result FROM con WHERE is_completed AND winner IS NOT NULL
UNION ALL
SELECT match_id, season, match_date, venue, team2, team1, CASE WHEN winner = team2 THEN 1 ELSE 0 END,
  CASE WHEN home_team = team2 THEN 1 ELSE 0 END, is_playoff, CASE WHEN first_batting_team = team2 THEN 1 ELSE 0 END,
  CASE WHEN toss_winner = team2 THEN 1 ELSE 0 END, toss_decision, is_no_result FROM con WHERE is_completed AND winner IS NOT NULL)
WHERE team IS NOT NULL"""


def with_prelude(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    body = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    own = sql.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {body},\n{own[5:]}"
    return f"WITH {body}\n{own}"
