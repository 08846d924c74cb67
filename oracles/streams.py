"""Oracle text for the streaming jobs: their batch meaning."""

from oracles.features import state

SQL = {
    "z1_incremental_load": """
SELECT o_orderkey AS match_id, CAST(o_orderkey AS VARCHAR) AS match_key, o_orderstatus <> 'P' AS is_completed,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'stored' ELSE 'stream' END AS origin FROM orders""",
    "z2_live_scoreboard": """
SELECT match_id, innings_no, CAST(sum(total_runs) AS BIGINT) AS runs, count(*) FILTER (WHERE is_wicket) AS wickets,
  count(*) FILTER (WHERE is_legal) AS balls, CAST(sum(extra_runs) AS BIGINT) AS extras FROM lines GROUP BY match_id, innings_no""",
    "z2_live_chase": f"""
SELECT * EXCLUDE (target_chase_success, last_seq), {state()} FROM (SELECT *, max(ball_seq) OVER (PARTITION BY match_id) AS last_seq FROM ch2)
WHERE ball_seq = last_seq""",
}
