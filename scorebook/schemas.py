"""Explicit table schemas: nothing is inferred from data.

Dimensions ``sides``, ``places`` and ``actors`` carry surrogate keys; facts refer
to them. Wide reads with names are in :mod:`scorebook.sources.warehouse`.
"""

from __future__ import annotations

TABLES: dict[str, str] = {
    "sides": "id long, name string, short_code string, is_active boolean, primary_color string, logo_url string, created_at timestamp",
    "places": "id long, name string, city string, country string, created_at timestamp",
    "actors": (
        "id long, name string, source_player_id string, short_name string, batting_style string, "
        "bowling_style string, role string, is_overseas boolean, image_url string"
    ),
    "contests": (
        "id long, match_key string, source string, source_match_id string, competition_id long, "
        "season int, match_date date, start_datetime timestamp_ntz, match_number string, stage string, "
        "is_playoff boolean, is_day_night boolean, overs_per_innings int, venue_id long, city string, "
        "is_neutral_venue boolean, team1_id long, team2_id long, home_team_id long, away_team_id long, "
        "toss_winner_id long, toss_decision string, first_batting_team_id long, "
        "second_batting_team_id long, is_completed boolean, winner_id long, result_type string, "
        "win_margin_runs int, win_margin_wickets int, is_tie boolean, is_no_result boolean, "
        "is_super_over boolean, is_dls_applied boolean, target_runs int, result_summary string, "
        "player_of_match_id long, umpire1 string, umpire2 string, third_umpire string, "
        "match_referee string, created_at timestamp, updated_at timestamp"
    ),
    "periods": (
        "match_id long, innings_no int, batting_team_id long, bowling_team_id long, runs long, "
        "wickets long, overs double, balls long, run_rate double, extras long, byes long, "
        "leg_byes long, wides long, no_balls long, penalty long, powerplay_runs long, "
        "powerplay_wickets long, middle_runs long, middle_wickets long, death_runs long, "
        "death_wickets long, fours long, sixes long, dot_balls long, target int"
    ),
    "attack_cards": (
        "match_id long, innings_no int, team_id long, player_id long, batting_position int, "
        "runs long, balls long, fours long, sixes long, dot_balls long, strike_rate double, "
        "is_out boolean, dismissal_kind string, dismissal_text string, bowler_id long, "
        "fielder_id long, wicket_number int"
    ),
    "defence_cards": (
        "match_id long, innings_no int, team_id long, player_id long, bowling_order int, overs double, "
        "balls long, maidens long, runs_conceded long, wickets long, wides long, no_balls long, "
        "dot_balls long, economy double"
    ),
    "dismissals": (
        "match_id long, innings_no int, wicket_no int, player_id long, team_id long, fall_score long, "
        "fall_overs double"
    ),
    "stands": (
        "match_id long, innings_no int, wicket_no int, team_id long, striker_id long, "
        "non_striker_id long, runs long, balls long, striker_runs long, striker_balls long, "
        "non_striker_runs long, non_striker_balls long, extras long, start_over double, "
        "end_over double, is_unbroken boolean"
    ),
    "events": (
        "match_id long, innings_no int, over_no int, ball_no int, ball_seq int, batting_team_id long, "
        "bowling_team_id long, batter_id long, bowler_id long, batter_runs int, extra_runs int, "
        "total_runs int, is_legal boolean, is_wide boolean, is_no_ball boolean, is_bye boolean, "
        "is_leg_bye boolean, is_four boolean, is_six boolean, is_wicket boolean, wicket_type string, "
        "cumulative_runs long, cumulative_wickets long"
    ),
    "rosters": (
        "match_id long, team_id long, player_id long, is_playing_xi boolean, is_captain boolean, "
        "is_wicketkeeper boolean, is_overseas boolean, is_impact_sub boolean, playing_order int, "
        "role string"
    ),
    "load_runs": (
        "id long, started_at timestamp, finished_at timestamp, status string, trigger string, "
        "sources string, seasons string, matches_seen long, matches_inserted long, "
        "matches_updated long, matches_skipped long, events_inserted long, duration_seconds double, "
        "message string"
    ),
}

# Child tables, with the key that must be unique inside a contest.
CHILD_KEYS: dict[str, list[str]] = {
    "periods": ["match_id", "innings_no"],
    "attack_cards": ["match_id", "innings_no", "player"],
    "defence_cards": ["match_id", "innings_no", "player"],
    "dismissals": ["match_id", "innings_no", "wicket_no"],
    "stands": ["match_id", "innings_no", "wicket_no"],
    "events": ["match_id", "innings_no", "ball_seq"],
    "rosters": ["match_id", "team", "player"],
}

DOCUMENT = """
info struct<
  dates: array<string>, teams: array<string>, venue: string, city: string, overs: int,
  season: string,
  event: struct<name: string, match_number: string, stage: string>,
  toss: struct<winner: string, decision: string>,
  outcome: struct<winner: string, result: string, method: string, eliminator: string,
                  `by`: struct<runs: int, wickets: int>>,
  officials: struct<umpires: array<string>, tv_umpires: array<string>, match_referees: array<string>>,
  player_of_match: array<string>,
  players: map<string, array<string>>,
  registry: struct<people: map<string, string>>>,
innings array<struct<
  team: string,
  target: struct<runs: int, overs: double>,
  overs: array<struct<over: int, deliveries: array<struct<
    batter: string, bowler: string, non_striker: string,
    runs: struct<batter: int, extras: int, total: int>,
    extras: struct<wides: int, noballs: int, byes: int, legbyes: int, penalty: int>,
    wickets: array<struct<kind: string, player_out: string>>>>>>>>
"""
