"""Oracle text for the scorecard derivations."""

SQL = {
    "d2_attack_cards": "SELECT * FROM bat0",
    "d3_defence_cards": "SELECT * FROM bowl0",
    "d4_maidens": "SELECT match_id, innings_no, bowling_team, bowler, over_no FROM bowlover WHERE runs = 0 AND balls >= 6",
    "d5_dismissals": "SELECT * FROM dis",
    "d6_stands": "SELECT * FROM std",
    "d7_period_totals": """SELECT p.*, CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 AS overs,
  CASE WHEN balls > 0 THEN CAST(runs * 6 AS DOUBLE) / balls END AS run_rate FROM per0 p""",
    "d8_merge_period_totals": """
SELECT match_id, innings_no, batting_team, bowling_team,
  CASE WHEN match_id % 4 = 1 THEN runs + 1 ELSE runs END AS runs, wickets, extras, balls,
  CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10.0 AS overs,
  CASE WHEN balls > 0 THEN CAST((CASE WHEN match_id % 4 = 1 THEN runs + 1 ELSE runs END) * 6 AS DOUBLE) / balls END AS run_rate,
  powerplay_runs, powerplay_wickets, middle_runs, middle_wickets, death_runs, death_wickets, fours, sixes, dot_balls
FROM per0""",
    "d9_reconcile_periods": """
SELECT match_id, innings_no, CASE WHEN match_id % 4 = 1 THEN runs + 1 ELSE runs END AS card_runs, runs AS event_runs
FROM per0 WHERE match_id % 4 = 1""",
    "d10_opponent_of": """
SELECT match_id, innings_no, batting_team, CASE WHEN batting_team = team1 THEN team2 WHEN batting_team = team2 THEN team1 END AS opponent
FROM per0 JOIN hdr USING (match_id)""",
}
