"""Oracle text for joined reads, maintenance and quality checks."""

CTES = {
    "dirty": """
SELECT * REPLACE (
  CASE WHEN match_id % 41 = 7 THEN NULL ELSE match_key END AS match_key,
  CASE WHEN match_id % 43 = 8 THEN NULL ELSE season END AS season,
  CASE WHEN match_id % 47 = 9 THEN NULL ELSE match_date END AS match_date,
  CASE WHEN match_id % 29 = 4 THEN team1 WHEN match_id % 53 = 10 THEN NULL ELSE team2 END AS team2,
  CASE WHEN match_id % 31 = 5 THEN 'GHOST' WHEN match_id % 19 = 2 THEN NULL ELSE winner END AS winner,
  CASE WHEN match_id % 17 = 3 THEN 'GHOST' ELSE toss_winner END AS toss_winner,
  CASE WHEN match_id % 37 = 6 THEN 'maybe' ELSE toss_decision END AS toss_decision,
  CASE WHEN match_id % 13 = 4 THEN 5 ELSE win_margin_runs END AS win_margin_runs,
  CASE WHEN match_id % 59 = 1 THEN 12 WHEN match_id % 13 = 4 THEN 3 ELSE win_margin_wickets END AS win_margin_wickets)
FROM con""",
    "dper0": """
SELECT * REPLACE (
  CASE WHEN match_id % 61 = 2 THEN 400 WHEN match_id % 4 = 1 THEN runs + 1 ELSE runs END AS runs,
  CASE WHEN match_id % 67 = 3 THEN 'GHOST' ELSE batting_team END AS batting_team),
  CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 AS overs FROM per0""",
    "dper": "SELECT * FROM dper0 UNION ALL SELECT * FROM dper0 WHERE match_id % 71 = 4",
    "dbat": "SELECT * FROM bat0 UNION ALL SELECT * FROM bat0 WHERE match_id % 73 = 5",
    "dbowl": "SELECT * FROM bowl0 UNION ALL SELECT * FROM bowl0 WHERE match_id % 79 = 6",
    "dev": "SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE match_id % 83 = 7",
    "ish": """
SELECT match_key, 'error' AS severity, 'missing_key' AS code FROM dirty WHERE match_key IS NULL OR match_key = ''
UNION ALL SELECT match_key, 'error', 'missing_season' FROM dirty WHERE coalesce(season, 0) = 0
UNION ALL SELECT match_key, 'warning', 'missing_date' FROM dirty WHERE match_date IS NULL
UNION ALL SELECT match_key, 'error', 'missing_teams' FROM dirty WHERE team1 IS NULL OR team2 IS NULL OR team1 = team2
UNION ALL SELECT match_key, 'error', 'same_team' FROM dirty WHERE team1 = team2
UNION ALL SELECT match_key, 'warning', 'toss_winner_not_playing' FROM dirty WHERE toss_winner IS NOT NULL AND NOT (coalesce(toss_winner = team1, false) OR coalesce(toss_winner = team2, false))
UNION ALL SELECT match_key, 'warning', 'bad_toss_decision' FROM dirty WHERE toss_decision NOT IN ('bat', 'field')
UNION ALL SELECT match_key, 'warning', 'completed_no_result' FROM dirty WHERE is_completed AND winner IS NULL AND NOT is_tie AND NOT is_no_result
UNION ALL SELECT match_key, 'error', 'winner_not_playing' FROM dirty WHERE winner IS NOT NULL AND NOT (coalesce(winner = team1, false) OR coalesce(winner = team2, false))
UNION ALL SELECT match_key, 'warning', 'double_margin' FROM dirty WHERE win_margin_runs IS NOT NULL AND win_margin_wickets IS NOT NULL
UNION ALL SELECT match_key, 'warning', 'implausible_margin' FROM dirty WHERE win_margin_wickets NOT BETWEEN 0 AND 10""",
    "isp": """
SELECT match_key, 'error' AS severity, 'implausible_score' AS code FROM dper JOIN dirty USING (match_id) WHERE runs NOT BETWEEN 0 AND 350
UNION ALL SELECT match_key, 'error', 'implausible_wickets' FROM dper JOIN dirty USING (match_id) WHERE wickets NOT BETWEEN 0 AND 10
UNION ALL SELECT match_key, 'warning', 'overs_exceed_limit' FROM dper JOIN dirty USING (match_id) WHERE overs > 20.5
UNION ALL SELECT match_key, 'warning', 'innings_team_mismatch' FROM dper JOIN dirty USING (match_id)
  WHERE NOT (coalesce(batting_team = team1, false) OR coalesce(batting_team = team2, false))""",
    "isd": """
SELECT match_key, 'error' AS severity, 'duplicate_innings' AS code FROM (SELECT match_id, innings_no FROM dper GROUP BY ALL HAVING count(*) > 1) JOIN dirty USING (match_id)""",
    "ism": """
SELECT match_key, 'warning' AS severity, 'ballbyball_mismatch' AS code
FROM dper JOIN (SELECT match_id, innings_no, sum(total_runs) AS s FROM ev GROUP BY ALL) USING (match_id, innings_no) JOIN dirty USING (match_id) WHERE runs <> s""",
    "isc": """
SELECT match_key, 'warning' AS severity, 'duplicate_batting' AS code FROM (SELECT match_id, innings_no, player FROM dbat GROUP BY ALL HAVING count(*) > 1) JOIN dirty USING (match_id)
UNION ALL SELECT match_key, 'warning', 'duplicate_bowling' FROM (SELECT match_id, innings_no, player FROM dbowl GROUP BY ALL HAVING count(*) > 1) JOIN dirty USING (match_id)
UNION ALL SELECT match_key, 'warning', 'duplicate_delivery' FROM (SELECT match_id, innings_no, ball_seq FROM dev GROUP BY ALL HAVING count(*) > 1) JOIN dirty USING (match_id)""",
    "iss": "SELECT * FROM ish UNION ALL SELECT * FROM isp UNION ALL SELECT * FROM isd UNION ALL SELECT * FROM ism",
    "bad": """
SELECT match_id FROM dirty WHERE match_key IS NULL OR match_key = '' OR coalesce(season, 0) = 0 OR team1 IS NULL OR team2 IS NULL OR team1 = team2
  OR (winner IS NOT NULL AND NOT (coalesce(winner = team1, false) OR coalesce(winner = team2, false)))
UNION SELECT match_id FROM dper WHERE runs NOT BETWEEN 0 AND 350 OR wickets NOT BETWEEN 0 AND 10
UNION SELECT match_id FROM dper GROUP BY match_id, innings_no HAVING count(*) > 1""",
    "enr": """
SELECT player AS name, arg_min(role, match_id) AS role FROM (SELECT player, match_id, CASE WHEN match_id % 3 = 0 THEN '' ELSE role END AS role FROM ros) WHERE role <> '' GROUP BY player""",
    "runs": """
SELECT CAST(season AS BIGINT) AS id, count(*) AS matches_seen, count(*) FILTER (WHERE is_completed) AS matches_inserted FROM con GROUP BY season""",
}


def _codes(table: str, *codes: str) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return f"SELECT match_key, severity, code FROM {table} WHERE code IN ({listed})"


SQL = {
    "s1_load_contests": "SELECT * FROM cona",
    "s1_load_contests_season": "SELECT match_id, team1, team2, winner, is_playoff FROM con WHERE is_completed AND season = 1998",
    "s2_load_periods": "SELECT * FROM per",
    "s3_load_attack_cards": "SELECT match_id, innings_no, batting_position, runs, balls, fours, sixes, strike_rate, is_out, dismissal_kind, player, team, season, match_date, venue, opposition FROM bat",
    "s4_load_defence_cards": "SELECT match_id, innings_no, overs, balls, maidens, runs_conceded, wickets, wides, no_balls, economy, dot_balls, player, team, season, match_date, venue, opposition FROM bowl",
    "s5_load_events": """
SELECT match_id, innings_no, over_no, ball_no, ball_seq, batter_runs, extra_runs, total_runs, is_legal, is_wide, is_no_ball, is_four, is_six, is_wicket, wicket_type,
  CAST(sum(total_runs) OVER w AS BIGINT) AS cumulative_runs, CAST(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cumulative_wickets,
  batting_team, bowling_team, batter, bowler, season, match_date FROM ev WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY ball_seq)""",
    "s5_load_events_season": """
SELECT match_id, innings_no, ball_seq, total_runs, batter FROM ev WHERE season = 1998 AND match_id IN (SELECT match_id FROM con WHERE is_playoff)""",
    "s6_load_rosters": "SELECT * FROM ros",
    "s7_load_stands": "SELECT * EXCLUDE (is_unbroken) FROM std",
    "s8_load_dismissals": "SELECT * FROM dis",
    "s9_table_counts": """
SELECT 'sides' AS table_name, count(*) AS rows FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'places', count(*) FROM nation
UNION ALL SELECT 'actors', count(*) * 11 FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'contests', count(*) FROM con
UNION ALL SELECT 'periods', count(*) FROM per0 UNION ALL SELECT 'attack_cards', count(*) FROM bat0 UNION ALL SELECT 'defence_cards', count(*) FROM bowl0
UNION ALL SELECT 'dismissals', count(*) FROM dis UNION ALL SELECT 'stands', count(*) FROM std UNION ALL SELECT 'events', count(*) FROM ev
UNION ALL SELECT 'rosters', count(*) FROM ros UNION ALL SELECT 'completed_contests', count(*) FROM con WHERE is_completed""",
    "s10_season_range": "SELECT min(season) AS first_season, max(season) AS last_season FROM con",
    "k1_upsert_contests": """
SELECT match_id, match_key, winner, result_summary FROM con WHERE match_id % 3 <> 0 AND match_id % 4 <> 0
UNION ALL SELECT match_id, match_key, winner, upper(result_summary) FROM con WHERE match_id % 3 = 0 OR match_id % 4 = 0""",
    "k1_upsert_counts": "SELECT count(*) FILTER (WHERE match_id % 3 = 0) AS inserted, count(*) FILTER (WHERE match_id % 3 <> 0) AS updated FROM con WHERE match_id % 3 = 0 OR match_id % 4 = 0",
    "k2_replace_children": """
SELECT match_id, innings_no, runs FROM per0 WHERE match_id % 2 <> 0
UNION ALL SELECT match_id, innings_no, runs + 1000 FROM per0 WHERE match_id % 2 = 0 AND match_id % 10 <> 0""",
    "k3_resolve_dimension": """
SELECT n AS name, min(id) AS known_id FROM (SELECT n_name AS n, CAST(n_nationkey + 1 AS BIGINT) AS id FROM nation WHERE n_nationkey < 10
  UNION ALL SELECT venue, NULL FROM con UNION ALL SELECT city, NULL FROM con) GROUP BY n""",
    "k3_new_keys": """
SELECT 10 + row_number() OVER (ORDER BY n) AS id FROM (SELECT venue AS n FROM con UNION SELECT city FROM con)
WHERE n NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 10)""",
    "k3_attach_keys": """
SELECT match_id, CASE WHEN regexp_matches(venue, '^NATION_[0-9]$') THEN CAST(regexp_extract(venue, '^NATION_([0-9]+)$', 1) AS BIGINT) + 1 END AS venue_id FROM con""",
    "k4_enrich_actors": """
SELECT a.name, CASE WHEN n % 2 = 0 THEN 'known' ELSE coalesce(e.role, CASE WHEN n % 4 = 1 THEN '' END) END AS role
FROM (SELECT n_name || '_P' || n AS name, n FROM nation, range(11) t(n) WHERE n_nationkey < 10) a LEFT JOIN enr e ON e.name = a.name""",
    "k5_filter_incremental": "SELECT match_id, match_key FROM con WHERE NOT (match_id % 2 = 0 AND is_completed)",
    "k6_plan_sources": "SELECT season, min(source) AS source FROM con WHERE season <= 2000 AND season % 2 = 0 GROUP BY season",
    "k6_uncovered_seasons": "SELECT DISTINCT season + 3 AS season FROM con WHERE season + 3 NOT IN (SELECT season FROM con)",
    "k7_drop_placeholders": "SELECT match_id, team1, team2 FROM dirty WHERE team1 IS NOT NULL AND team2 IS NOT NULL",
    "k7_skipped": "SELECT count(*) FILTER (WHERE team1 IS NULL OR team2 IS NULL) AS skipped FROM dirty",
    "k8_latest_run": "SELECT id, 'success' AS status, matches_seen, matches_inserted FROM runs ORDER BY id DESC LIMIT 1",
    "q1_missing_identity": _codes("ish", "missing_key", "missing_season"),
    "q2_missing_date": _codes("ish", "missing_date"),
    "q3_missing_sides": _codes("ish", "missing_teams", "same_team"),
    "q4_toss": _codes("ish", "toss_winner_not_playing", "bad_toss_decision"),
    "q5_completed_no_result": _codes("ish", "completed_no_result"),
    "q6_winner_not_playing": _codes("ish", "winner_not_playing"),
    "q7_margins": _codes("ish", "double_margin", "implausible_margin"),
    "q8_duplicate_innings": "SELECT * FROM isd",
    "q9_implausible_score": _codes("isp", "implausible_score"),
    "q10_implausible_wickets": _codes("isp", "implausible_wickets"),
    "q11_overs_exceed_limit": _codes("isp", "overs_exceed_limit"),
    "q12_innings_team_mismatch": _codes("isp", "innings_team_mismatch"),
    "q13_event_mismatch": "SELECT * FROM ism",
    "q14_duplicate_children": "SELECT * FROM isc",
    "q15_dedupe": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1""",
    "q15_dedupe_children": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) + count(*) FILTER (WHERE match_id % 3 = 0) AS rows_before, count(*) AS rows_after, CAST(0 AS BIGINT) AS copies_kept FROM {cte}"
        for name, cte in (
            ("periods", "per0"), ("attack_cards", "bat0"), ("defence_cards", "bowl0"), ("dismissals", "dis"),
            ("stands", "std"), ("events", "ev"), ("rosters", "ros"),
        )
    ),
    "q16_issue_counts": "SELECT code, count(*) AS issues FROM iss GROUP BY code",
    "q16_issue_summary": """
SELECT (SELECT count(*) FROM dirty) AS checked, (SELECT count(*) FROM dirty WHERE match_id IN (SELECT match_id FROM bad)) AS rejected,
  count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM iss""",
    "q17_accepted": "SELECT match_id, match_key FROM dirty WHERE match_id NOT IN (SELECT match_id FROM bad)",
    "q17_rejected": "SELECT match_id, match_key FROM dirty WHERE match_id IN (SELECT match_id FROM bad)",
}
