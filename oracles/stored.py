"""Oracle text for the load jobs: what was delivered."""

# A contest with an implausible innings (an error of Q10) is rejected.
CTES = {
    "good": "SELECT * FROM con WHERE match_id NOT IN (SELECT match_id FROM per0 WHERE wickets > 10 OR runs > 350 OR runs < 0)",
    "gfeed": "SELECT match_id, 'official:' || CASE WHEN season >= 2000 THEN season ELSE 1900 END || ':' || match_id AS feed_key FROM con WHERE match_id NOT IN (SELECT match_id FROM per0 WHERE wickets > 10 OR runs + CASE WHEN match_id % 4 = 1 THEN 1 ELSE 0 END NOT BETWEEN 0 AND 350)",
    "gev": "SELECT ev.* FROM ev JOIN (SELECT match_id FROM good) USING (match_id)",
}
_KEY = "'official:' || c.season || ':' || c.match_id"
_NR = "coalesce(result_type = 'no result', false)"


def _child(name: str, cte: str, value: str) -> str:
    return (
        f"SELECT {_KEY} AS match_key, '{name}' AS child, count(*) AS rows, CAST(sum(x.{value}) AS BIGINT) AS total "
        f"FROM {cte} x JOIN good c ON c.match_id = x.match_id GROUP BY c.season, c.match_id"
    )


_ROSTER = (
    "(SELECT match_id, row_number() OVER (PARTITION BY match_id, team ORDER BY playing_order, player) AS playing_order FROM ros)"
)
_COUNTS = {
    "periods": "per0", "attack_cards": "bat0", "defence_cards": "bowl0", "dismissals": "dis", "stands": "std",
    "events": "ev", "rosters": "ros",
}

SQL = {
    "load_round_trip_contests": f"""
SELECT {_KEY} AS match_key, season, match_date, venue, team1, team2, toss_winner,
  CASE WHEN NOT is_completed OR nr THEN NULL WHEN tie THEN CASE WHEN match_id % 2 = 0 THEN team1 END ELSE winner END AS winner,
  is_completed AND (nr OR tie OR winner IS NOT NULL) AS is_completed, is_playoff
FROM (SELECT *, {_NR} AS nr, is_tie OR match_id % 17 = 4 AS tie FROM good) c""",
    "load_round_trip_children": " UNION ALL ".join(
        _child(n, cte, v) for n, cte, v in (
            ("periods", "per0", "runs"), ("attack_cards", "bat0", "runs"), ("defence_cards", "bowl0", "runs_conceded"),
            ("dismissals", "dis", "fall_score"), ("stands", "std", "runs"), ("events", "ev", "total_runs"),
            ("rosters", _ROSTER, "playing_order"),
        )
    ),
    "load_season_events": """
SELECT 'official:' || season || ':' || match_id AS match_key, innings_no, ball_seq, total_runs, batter, bowler, season FROM ev JOIN (SELECT match_id FROM good) USING (match_id) WHERE season = 1998""",
    "load_feed_round_trip": " UNION ALL ".join(
        f"SELECT feed_key AS match_key, '{name}' AS child, count(*) AS rows, "
        f"CAST(sum({value}) AS BIGINT) AS total FROM {cte} x JOIN gfeed USING (match_id) {where} GROUP BY feed_key"
        for name, cte, value, where in (
            ("periods", "per0", "runs + CASE WHEN match_id % 4 = 1 THEN 1 ELSE 0 END", ""), ("attack_cards", "bat0", "runs", ""),
            ("defence_cards", "bowl0", "runs_conceded", ""), ("events", "ev", "total_runs", "WHERE match_id % 3 <> 0"),
        )
    ),
    "s5_load_events_ids": """
SELECT 'official:' || season || ':' || match_id AS match_key, innings_no, ball_seq, total_runs, batter, bowler, season FROM ev
WHERE match_id IN (SELECT arg_min(match_id, 'official:' || season || ':' || match_id) FROM good WHERE season % 3 = 0 GROUP BY season)""",
    "load_twice": " UNION ALL ".join(
        [
            "SELECT 'sides' AS table_name, count(*) AS rows FROM (SELECT team1 FROM good UNION SELECT team2 FROM good)",
            "SELECT 'places', count(DISTINCT venue) FROM good",
            "SELECT 'actors', count(*) FROM (SELECT batter FROM gev UNION SELECT non_striker FROM gev UNION SELECT bowler FROM gev)",
            "SELECT 'contests', count(*) FROM good",
            *[f"SELECT '{n}', count(*) FROM {cte} JOIN (SELECT match_id FROM good) USING (match_id)" for n, cte in _COUNTS.items()],
            f"SELECT 'completed_contests', count(*) FILTER (WHERE is_completed AND ({_NR} OR is_tie OR match_id % 17 = 4 OR winner IS NOT NULL)) FROM good",
            "SELECT 'run 0 inserted', count(*) FROM good", "SELECT 'run 1 inserted', 0",
            "SELECT 'run 0 updated', 0", "SELECT 'run 1 updated', count(*) FROM good",
            *[f"SELECT 'run {k} events', count(*) FROM {_COUNTS['events']} JOIN (SELECT match_id FROM good) USING (match_id)" for k in (0, 1)],
            *[f"SELECT 'run {k} seen', count(*) FROM con" for k in (0, 1)],
            "SELECT 'second load updated', count(*) FROM good",
            "SELECT 'second load rejected', (SELECT count(*) FROM con) - (SELECT count(*) FROM good)",
            *[f"SELECT 'second load {n}_inserted', count(*) FROM {cte} JOIN (SELECT match_id FROM good) USING (match_id)" for n, cte in _COUNTS.items()],
        ]
    ),
    "k9_export_slim": """
SELECT 'sides' AS table_name, count(*) AS rows FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'places', count(*) FROM nation
UNION ALL SELECT 'actors', count(*) * 11 FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'contests', count(*) FROM con UNION ALL SELECT 'periods', count(*) FROM per0""",
    "k12_saved_models": """
SELECT unnest(['winner', 'first_innings_score', 'chase', 'award']) AS task, unnest([true, false, false, false]) AS is_available""",
}
