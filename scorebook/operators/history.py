"""Features of a contest from what happened strictly before it.

The order is (match_date, match_id). State changes only with completed contests
that have a winner; every other contest sees the state and leaves it alone. State
is computed with the running and rolling helpers of
:mod:`scorebook.functions.timeline`, so neither a side, nor a place, nor the whole
league is ever one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import flag
from scorebook.functions.timeline import Running, rolling_before, running, shared

# Where contests without a date, and after them requests, stand in the order.
UNDATED = "9000-01-01"
REQUESTED_FROM = "9001-01-01"
REQUEST_DAYS = 4096

# The feature contract.
NUMERIC = [
    "season", "team1_is_home", "is_neutral_venue", "is_playoff", "toss_winner_is_team1",
    "toss_decision_is_bat", "team1_career_win_rate", "team2_career_win_rate", "team1_form_short",
    "team2_form_short", "team1_form_long", "team2_form_long", "form_short_diff", "form_long_diff",
    "career_win_rate_diff", "team1_h2h_win_rate", "h2h_matches", "team1_venue_win_rate",
    "team2_venue_win_rate", "venue_win_rate_diff", "team1_avg_runs_scored",
    "team2_avg_runs_scored", "team1_avg_runs_conceded", "team2_avg_runs_conceded",
    "team1_net_run_strength", "team2_net_run_strength", "net_run_strength_diff",
    "team1_rest_days", "team2_rest_days", "rest_days_diff", "team1_season_points",
    "team2_season_points", "season_points_diff", "team1_season_matches", "team2_season_matches",
    "venue_avg_first_innings", "venue_chase_win_rate", "team1_win_streak", "team2_win_streak",
    "team1_xi_batting_average", "team2_xi_batting_average", "team1_xi_strike_rate",
    "team2_xi_strike_rate", "team1_xi_bowling_economy", "team2_xi_bowling_economy",
    "team1_xi_experience", "team2_xi_experience", "xi_batting_average_diff",
    "xi_strike_rate_diff", "xi_bowling_economy_diff", "xi_experience_diff", "has_xi_data",
]
# The feature contract.
CATEGORICAL = ["team1", "team2", "venue", "toss_decision"]

# One value per side, emitted as team1_<name> and team2_<name>.
SIDE_FEATURES = [
    "career_win_rate", "form_short", "form_long", "venue_win_rate", "avg_runs_scored",
    "avg_runs_conceded", "net_run_strength", "rest_days", "season_points", "season_matches",
    "win_streak", "venue_avg_score", "xi_batting_average", "xi_strike_rate", "xi_bowling_economy",
    "xi_experience",
]
# Differences (side 1 minus side 2) and the value they are taken from.
DIFFERENCES = {
    "form_short_diff": "form_short", "form_long_diff": "form_long",
    "career_win_rate_diff": "career_win_rate", "venue_win_rate_diff": "venue_win_rate",
    "net_run_strength_diff": "net_run_strength", "rest_days_diff": "rest_days",
    "season_points_diff": "season_points", "xi_batting_average_diff": "xi_batting_average",
    "xi_strike_rate_diff": "xi_strike_rate", "xi_bowling_economy_diff": "xi_bowling_economy",
    "xi_experience_diff": "xi_experience",
}


def shrink(successes: Column, trials: Column, prior: float = k.PRIOR_WIN_RATE) -> Column:
    """Rate pulled towards a prior while there is little history."""
    return (successes + F.lit(prior * k.SHRINKAGE)) / (trials + F.lit(k.SHRINKAGE))


def _mean_or(total: Column, n: Column, default: Column | float) -> Column:
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(n > 0, total.cast("double") / n).otherwise(other)


def contest_base(contests: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Narrow, ordered contest rows: everything the state needs and nothing else."""
    extra = ["winner", "toss_winner", "toss_decision", "home_team", "first_batting_team"]
    frame = contests.where(F.col("team1").isNotNull() & F.col("team2").isNotNull()).select(
        "match_id", "match_key", "season", "match_date",
        F.coalesce("match_date", F.to_date(F.lit(UNDATED))).alias("day"),
        F.coalesce("venue", F.lit("")).alias("place"),
        "venue", "team1", "team2", *extra,
        *[
            F.coalesce(c, F.lit(False)).alias(c)
            for c in ("is_completed", "is_no_result", "is_neutral_venue", "is_playoff")
        ],
    )
    if periods is None:
        frame = frame.withColumns(
            {"runs1": F.lit(None).cast("long"), "runs2": F.lit(None).cast("long")}
        )
    else:
        scores = periods.groupBy("match_id").agg(
            *[
                F.max(F.when(F.col("innings_no") == n, F.col("runs"))).alias(f"runs{n}")
                for n in (1, 2)
            ]
        )
        frame = frame.join(scores, "match_id", "left")
    done = F.col("is_completed") & F.col("winner").isNotNull()
    first = F.col("first_batting_team")
    chasing = F.when(first == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))
    return frame.withColumns(
        {
            "done": done,
            "decided": done & ~F.col("is_no_result"),
            "pair_a": F.least("team1", "team2"),
            "pair_b": F.greatest("team1", "team2"),
            "chasing_team": F.when(first.isNotNull(), chasing),
            # What the contest adds to first-innings levels, null when nothing.
            "first_score": F.when(done & first.isNotNull(), F.col("runs1")),
            "chase_score": F.when(done & first.isNotNull(), F.col("runs2")),
        }
    )


def place_and_pair_state(base: DataFrame) -> DataFrame:
    """Head-to-head, place and league levels before each contest (F5, F7, F9, F10)."""
    entry = F.col("first_score")
    counted = flag(entry.isNotNull())
    chase = F.col("decided") & F.col("chase_score").isNotNull()
    state = running(
        base,
        [
            Running(
                ["pair_a", "pair_b"],
                {
                    "h2h_played": flag(F.col("decided")),
                    "h2h_a_wins": flag(F.col("decided") & (F.col("winner") == F.col("pair_a"))),
                },
            ),
            Running(
                ["place"],
                {
                    "place_first_sum": F.coalesce(entry, F.lit(0)),
                    "place_first_n": counted,
                    "place_chases": flag(chase),
                    "place_chase_wins": flag(chase & (F.col("winner") == F.col("chasing_team"))),
                },
            ),
            Running([], {"league_first_n": counted}),
        ],
        day="day",
    )
    state = rolling_before(
        state, ["place"], "place_first_n", {"place_recent": (entry, k.PLACE_RECENT_WINDOW)}
    )
    state = rolling_before(state, [], "league_first_n", {"league_recent": (entry, k.ERA_WINDOW)})
    own = F.when(F.col("pair_a") == F.col("team1"), F.col("h2h_a_wins")).otherwise(
        F.col("h2h_played") - F.col("h2h_a_wins")
    )
    league = _mean_or(F.col("league_recent_sum"), F.col("league_recent_n"), k.PRIOR_SCORE)
    return state.select(
        "match_id",
        shrink(own, F.col("h2h_played")).alias("team1_h2h_win_rate"),
        F.col("h2h_played").cast("double").alias("h2h_matches"),
        _mean_or(F.col("place_first_sum"), F.col("place_first_n"), k.PRIOR_SCORE).alias(
            "venue_avg_first_innings"
        ),
        shrink(F.col("place_chase_wins"), F.col("place_chases")).alias("venue_chase_win_rate"),
        league.alias("league_recent_avg_score"),
        _mean_or(F.col("place_recent_sum"), F.col("place_recent_n"), league).alias(
            "venue_recent_avg_score"
        ),
    )


def side_rows(base: DataFrame, rosters: DataFrame | None = None) -> DataFrame:
    """One row per contest and side with what the contest adds to that side."""
    rows = base.select(
        "match_id", "season", "match_date", "day", "place", "done", "decided", "is_no_result",
        "winner", "first_batting_team", "first_score", "chase_score",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("slot"), F.col("team1").alias("team")),
                F.struct(F.lit(2).alias("slot"), F.col("team2").alias("team")),
            )
        ).alias("side"),
    ).select("*", "side.slot", "side.team").drop("side")
    own_first = F.col("first_batting_team") == F.col("team")
    rows = rows.withColumns(
        {
            "won": F.when(F.col("decided"), flag(F.col("winner") == F.col("team"))),
            "scored": F.when(own_first, F.col("first_score")).otherwise(F.col("chase_score")),
            "conceded": F.when(own_first, F.col("chase_score")).otherwise(F.col("first_score")),
            "points": F.when(
                F.col("decided"), flag(F.col("winner") == F.col("team")) * k.POINTS_WIN
            ).when(F.col("done"), F.lit(k.POINTS_SHARED)).otherwise(F.lit(0)),
        }
    ).drop("winner", "first_batting_team", "first_score", "chase_score")
    if rosters is None:
        return rows.withColumn("has_roster", F.lit(False))
    listed = (
        _lineups(rosters).select("match_id", "team").distinct().withColumn("__listed", F.lit(True))
    )
    return rows.join(listed, ["match_id", "team"], "left").withColumn(
        "has_roster", F.coalesce("__listed", F.lit(False))
    ).drop("__listed")


def _lineups(rosters: DataFrame) -> DataFrame:
    return rosters.where(F.col("is_playing_xi") & F.col("player").isNotNull())


def side_state(rows: DataFrame) -> DataFrame:
    """State of a side before each of its contests (F1-F4, F6, F8, F11, F12), plus
    the contest whose roster stands in when its own is unknown."""
    rows = shared(rows)
    played, zero = F.col("decided"), F.lit(0)
    won = F.coalesce("won", zero)
    state = shared(
        running(
            rows,
            [
                Running(
                    ["team"],
                    {
                        "played_before": flag(played),
                        "won_before": won,
                        "scored_before": flag(F.col("scored").isNotNull()),
                        "conceded_before": flag(F.col("conceded").isNotNull()),
                    },
                    {
                        "last_date": F.when(F.col("done"), F.col("match_date")),
                        "last_roster": F.when(
                            F.col("done") & F.col("has_roster"), F.struct("day", "match_id")
                        ),
                    },
                ),
                Running(
                    ["team", "place"],
                    {
                        "place_played": flag(played),
                        "place_won": won,
                        "place_scored_sum": F.coalesce("scored", zero),
                        "place_scored_n": flag(F.col("scored").isNotNull()),
                    },
                ),
                Running(
                    ["team", "season"],
                    {"season_points": F.col("points"), "season_matches": flag(F.col("done"))},
                ),
            ],
            day="day",
        )
    )
    # A streak is the contests played since the last defeat.
    state = running(
        state,
        [
            Running(
                ["team"],
                maxes={"last_loss": F.when(F.col("won") == 0, F.col("played_before") + 1)},
            )
        ],
        day="day",
    )
    state = rolling_before(
        state, ["team"], "played_before",
        {"short": (F.col("won"), k.FORM_SHORT), "long": (F.col("won"), k.FORM_LONG)},
    )
    state = rolling_before(
        state, ["team"], "scored_before", {"scored10": (F.col("scored"), k.FORM_LONG)}
    )
    state = rolling_before(
        state, ["team"], "conceded_before", {"conceded10": (F.col("conceded"), k.FORM_LONG)}
    )
    scored = _mean_or(F.col("scored10_sum"), F.col("scored10_n"), k.PRIOR_SCORE)
    conceded = _mean_or(F.col("conceded10_sum"), F.col("conceded10_n"), k.PRIOR_SCORE)
    return state.select(
        "match_id", "slot", "team", "day", "match_date", "last_date",
        F.when(F.col("has_roster"), F.col("match_id")).otherwise(F.col("last_roster.match_id"))
        .alias("roster_match_id"),
        shrink(F.col("won_before"), F.col("played_before")).alias("career_win_rate"),
        _mean_or(F.col("short_sum"), F.col("short_n"), k.PRIOR_WIN_RATE).alias("form_short"),
        _mean_or(F.col("long_sum"), F.col("long_n"), k.PRIOR_WIN_RATE).alias("form_long"),
        scored.alias("avg_runs_scored"),
        conceded.alias("avg_runs_conceded"),
        (scored - conceded).alias("net_run_strength"),
        (F.col("played_before") - F.coalesce("last_loss", zero)).cast("double").alias("win_streak"),
        shrink(F.col("place_won"), F.col("place_played")).alias("venue_win_rate"),
        F.when(
            F.col("place_scored_n") > 0,
            F.col("place_scored_sum").cast("double") / F.col("place_scored_n"),
        ).alias("own_venue_score"),
        rest_days(F.col("match_date"), F.col("last_date")).alias("rest_days"),
        F.col("season_points").cast("double").alias("season_points"),
        F.col("season_matches").cast("double").alias("season_matches"),
    )


def rest_days(match_date: Column, last_date: Column) -> Column:
    days = F.least(F.greatest(F.datediff(match_date, last_date), F.lit(0)), F.lit(k.MAX_REST_DAYS))
    return F.when(match_date.isNull() | last_date.isNull(), F.lit(float(k.MAX_REST_DAYS))).otherwise(
        days.cast("double")
    )


def actor_entries(base: DataFrame, attack: DataFrame, defence: DataFrame) -> DataFrame:
    """What each completed contest adds to an actor's career: one stacked sum."""
    zero = F.lit(0).cast("long")
    stacked = attack.select(
        "match_id", "player", F.col("runs").cast("long").alias("runs"),
        F.col("balls").cast("long").alias("balls"), flag(F.col("is_out")).cast("long").alias("outs"),
        zero.alias("conceded"), zero.alias("bowled"), zero.alias("wickets"),
    ).unionByName(
        defence.select(
            "match_id", "player", zero.alias("runs"), zero.alias("balls"), zero.alias("outs"),
            F.col("runs_conceded").cast("long").alias("conceded"),
            F.col("balls").cast("long").alias("bowled"),
            F.col("wickets").cast("long").alias("wickets"),
        )
    )
    done = base.where("done").select("match_id")
    return (
        stacked.where(F.col("player").isNotNull()).join(done, "match_id", "left_semi")
        .groupBy("match_id", "player")
        .agg(
            *[
                F.coalesce(F.sum(c), zero).alias(c)
                for c in ("runs", "balls", "outs", "conceded", "bowled", "wickets")
            ],
            F.lit(1).cast("long").alias("matches"),
        )
    )


CAREER = ["runs", "balls", "outs", "conceded", "bowled", "wickets", "matches"]


def career_before(
    base: DataFrame, attack: DataFrame, defence: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """Career totals of an actor before a contest (F13).

    ``wanted`` lists (match_id, player); without it every actor with a card in a
    contest is described.
    """
    entries = actor_entries(base, attack, defence)
    zero = F.lit(0).cast("long")
    if wanted is None:
        rows = entries.withColumn("wanted", F.lit(1))
    else:
        rows = (
            entries.withColumn("wanted", F.lit(0))
            .unionByName(
                wanted.select(
                    "match_id", "player", *[zero.alias(c) for c in CAREER], F.lit(1).alias("wanted")
                )
            )
            .groupBy("match_id", "player")
            .agg(*[F.sum(c).alias(c) for c in CAREER], F.max("wanted").alias("wanted"))
        )
    rows = shared(rows.join(base.select("match_id", "day"), "match_id"))
    state = running(
        rows, [Running(["player"], {f"career_{c}": F.col(c) for c in CAREER})], day="day"
    )
    return state.where(F.col("wanted") == 1).select(
        "match_id", "player", *[f"career_{c}" for c in CAREER]
    )


def _best(values: Column, n: int, ascending: bool) -> Column:
    """Mean of the n best values of a squad-sized array, null when it is empty."""
    top = F.slice(F.sort_array(F.array_compact(values), asc=ascending), 1, n)
    total = F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(top) > 0, total / F.size(top))


def squad_strength(
    base: DataFrame,
    sides: DataFrame,
    attack: DataFrame,
    defence: DataFrame,
    rosters: DataFrame,
) -> DataFrame:
    """Strength of each side's squad from its members' careers to date (F14).

    ``sides`` has match_id, team and roster_match_id. A squad is a bounded group
    (its roster), so its metrics are folded from one array per measure.
    """
    members = _lineups(rosters).select(
        F.col("match_id").alias("roster_match_id"), "team", "player"
    )
    squads = shared(
        sides.select("match_id", "team", "roster_match_id").join(
            members, ["roster_match_id", "team"]
        )
    )
    careers = career_before(
        base, attack, defence, squads.select("match_id", "player").distinct()
    ).where(F.col("career_matches") > 0)
    known = squads.join(careers, ["match_id", "player"])
    batted = F.col("career_balls") >= k.MIN_CAREER_BALLS
    bowled = F.col("career_bowled") >= k.MIN_CAREER_BALLS
    runs = F.col("career_runs").cast("double")
    folded = known.groupBy("match_id", "team").agg(
        F.collect_list(F.when(batted, runs / F.greatest("career_outs", F.lit(1)))).alias("averages"),
        F.collect_list(F.when(batted, runs * 100 / F.col("career_balls"))).alias("rates"),
        F.collect_list(
            F.when(bowled, F.col("career_conceded").cast("double") * 6 / F.col("career_bowled"))
        ).alias("economies"),
        (F.sum("career_matches").cast("double") / F.count("*")).alias("xi_experience"),
    )
    return folded.select(
        "match_id", "team",
        F.coalesce(
            _best(F.col("averages"), k.TOP_BATTERS, False), F.lit(k.PRIOR_BATTING_AVERAGE)
        ).alias("xi_batting_average"),
        F.coalesce(
            _best(F.col("rates"), k.TOP_BATTERS, False), F.lit(k.PRIOR_STRIKE_RATE)
        ).alias("xi_strike_rate"),
        F.coalesce(
            _best(F.col("economies"), k.TOP_BOWLERS, True), F.lit(k.PRIOR_ECONOMY)
        ).alias("xi_bowling_economy"),
        "xi_experience",
    )


def contest_features(
    contests: DataFrame,
    periods: DataFrame | None = None,
    attack: DataFrame | None = None,
    defence: DataFrame | None = None,
    rosters: DataFrame | None = None,
    include_incomplete: bool = False,
) -> DataFrame:
    """The feature table: one row per contest with both sides' state and targets."""
    base = shared(contest_base(contests, periods))
    table = _assemble(base, attack, defence, rosters, include_incomplete)
    return table.drop("team1_last_date", "team2_last_date")


def _assemble(
    base: DataFrame,
    attack: DataFrame | None,
    defence: DataFrame | None,
    rosters: DataFrame | None,
    include_incomplete: bool,
) -> DataFrame:
    wider = place_and_pair_state(base)
    sides = side_state(side_rows(base, rosters))
    squad = ["xi_batting_average", "xi_strike_rate", "xi_bowling_economy", "xi_experience"]
    if attack is not None and defence is not None and rosters is not None:
        sides = shared(sides)
        sides = sides.join(
            squad_strength(base, sides, attack, defence, rosters), ["match_id", "team"], "left"
        )
    else:
        sides = sides.withColumns({c: F.lit(None).cast("double") for c in squad})
    per_side = [c for c in SIDE_FEATURES if c != "venue_avg_score"] + ["own_venue_score", "last_date"]
    # Both sides of a contest onto one row: an aggregation, not a self join.
    both = sides.groupBy("match_id").agg(
        *[
            F.max(F.when(F.col("slot") == slot, F.struct(*per_side))).alias(f"s{slot}")
            for slot in (1, 2)
        ]
    )
    rows = base.join(wider, "match_id").join(both, "match_id")
    if not include_incomplete:
        rows = rows.where("done")
    columns: dict[str, Column] = {}
    for slot in (1, 2):
        for name in per_side:
            columns[f"team{slot}_{name}"] = F.col(f"s{slot}.{name}")
        columns[f"team{slot}_venue_avg_score"] = F.coalesce(
            F.col(f"s{slot}.own_venue_score"), F.col("venue_avg_first_innings")
        )
    rows = rows.withColumns(columns).withColumns(
        {
            name: F.col(f"team1_{source}") - F.col(f"team2_{source}")
            for name, source in DIFFERENCES.items()
        }
    )
    toss, decision = F.col("toss_winner"), F.col("toss_decision")
    rows = rows.withColumns(
        {
            "team1_is_home": flag(F.col("home_team") == F.col("team1")),
            "is_neutral_venue": flag(F.col("is_neutral_venue")),
            "is_playoff": flag(F.col("is_playoff")),
            "toss_winner_is_team1": flag(toss == F.col("team1")),
            "toss_decision_is_bat": flag(decision == "bat"),
            "venue": F.coalesce("venue", F.lit("Unknown")),
            "toss_decision": F.coalesce(decision, F.lit("unknown")),
            "has_xi_data": flag(
                F.col("team1_xi_batting_average").isNotNull()
                & F.col("team2_xi_batting_average").isNotNull()
            ),
            "is_completed": F.col("done"),
            "target_team1_wins": F.when(F.col("done"), flag(F.col("winner") == F.col("team1"))),
        }
    )
    return rows.select(
        "match_id", "match_key", "match_date", *CATEGORICAL, *NUMERIC, "league_recent_avg_score",
        "venue_recent_avg_score", "team1_venue_avg_score", "team2_venue_avg_score",
        "is_completed", "winner", "first_batting_team", "target_team1_wins",
        F.col("runs1").alias("first_innings_runs"), F.col("runs2").alias("second_innings_runs"),
        "team1_last_date", "team2_last_date",
    )


# The feature contract.
SCORE_NUMERIC = [
    "season", "is_neutral_venue", "is_playoff", "batting_is_home", "batting_won_toss",
    "batting_career_win_rate", "batting_form_short", "bowling_form_short",
    "batting_avg_runs_scored", "bowling_avg_runs_conceded", "venue_avg_first_innings",
    "batting_venue_avg_score", "batting_rest_days", "league_recent_avg_score",
    "venue_recent_avg_score", "batting_xi_batting_average", "batting_xi_strike_rate",
    "bowling_xi_bowling_economy",
]
# The feature contract.
SCORE_CATEGORICAL = ["batting_team", "bowling_team", "venue"]


def score_features(features: DataFrame, require_total: bool = True) -> DataFrame:
    """The same contests seen from the side that bats first.

    The side's own scoring level at the place is used for training and scoring
    alike; ``require_total`` keeps only contests whose first innings is known.
    """
    if require_total:
        features = features.where(F.col("first_innings_runs").isNotNull())
    first = F.coalesce(F.col("first_batting_team") == F.col("team1"), F.lit(False))

    def pick(name: str, batting: bool) -> Column:
        own, other = (1, 2) if batting else (2, 1)
        return F.when(first, F.col(f"team{own}_{name}")).otherwise(F.col(f"team{other}_{name}"))

    return features.select(
        "match_id", "match_date", "season", "venue",
        F.col("first_batting_team").alias("batting_team"),
        F.when(first, F.col("team2")).otherwise(F.col("team1")).alias("bowling_team"),
        "is_neutral_venue", "is_playoff",
        F.when(first, F.col("team1_is_home")).otherwise(F.lit(0)).alias("batting_is_home"),
        F.when(first, F.col("toss_winner_is_team1"))
        .otherwise(F.lit(1) - F.col("toss_winner_is_team1")).alias("batting_won_toss"),
        pick("career_win_rate", True).alias("batting_career_win_rate"),
        pick("form_short", True).alias("batting_form_short"),
        pick("form_short", False).alias("bowling_form_short"),
        pick("avg_runs_scored", True).alias("batting_avg_runs_scored"),
        pick("avg_runs_conceded", False).alias("bowling_avg_runs_conceded"),
        "venue_avg_first_innings",
        pick("venue_avg_score", True).alias("batting_venue_avg_score"),
        pick("rest_days", True).alias("batting_rest_days"),
        "league_recent_avg_score", "venue_recent_avg_score",
        pick("xi_batting_average", True).alias("batting_xi_batting_average"),
        pick("xi_strike_rate", True).alias("batting_xi_strike_rate"),
        pick("xi_bowling_economy", False).alias("bowling_xi_bowling_economy"),
        F.col("first_innings_runs").alias("target_first_innings_runs"),
    )


def mirror(features: DataFrame) -> DataFrame:
    """The same contests with the sides swapped."""
    swapped = {"team1": F.col("team2"), "team2": F.col("team1")}
    for name in SIDE_FEATURES:
        if f"team1_{name}" in features.columns:
            swapped[f"team1_{name}"] = F.col(f"team2_{name}")
            swapped[f"team2_{name}"] = F.col(f"team1_{name}")
    for name in DIFFERENCES:
        swapped[name] = -F.col(name)
    swapped["team1_is_home"] = F.lit(0)
    for name in ("toss_winner_is_team1", "team1_h2h_win_rate", "target_team1_wins"):
        swapped[name] = F.lit(1) - F.col(name)
    return features.select(
        *[swapped.get(c, F.col(c)).alias(c) for c in features.columns],
        F.lit(True).alias("is_mirrored"),
    )


def featurise_requests(
    requests: DataFrame,
    contests: DataFrame,
    periods: DataFrame | None = None,
    attack: DataFrame | None = None,
    defence: DataFrame | None = None,
    rosters: DataFrame | None = None,
) -> DataFrame:
    """Features of hypothetical fixtures after all known contests (F19).

    ``requests`` has request_id, team1, team2, venue, season and optionally
    match_date, toss_winner, toss_decision, is_playoff, is_neutral_venue and
    home_team. State is computed once per distinct (team1, team2, venue, season),
    through the same path as training, and joined back to the requests.
    """
    optional = {
        "match_date": "date", "toss_winner": "string", "toss_decision": "string",
        "is_playoff": "boolean", "is_neutral_venue": "boolean", "home_team": "string",
    }
    for name, kind in optional.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    combination = ["team1", "team2", "venue", "season"]
    base = contest_base(contests, periods)
    asked = requests.select(*combination).distinct()
    # Negative ids keep the pseudo fixtures apart from contests; days beyond every
    # contest spread them, since no request may see another.
    asked = asked.withColumn("match_id", -F.abs(F.xxhash64(*combination)) - 1)
    pseudo = contest_base(
        asked.select(
            "match_id", F.lit(None).cast("string").alias("match_key"), "season",
            F.lit(None).cast("date").alias("match_date"), "venue", "team1", "team2",
            *[
                F.lit(None).cast("string").alias(c)
                for c in ("winner", "toss_winner", "toss_decision", "home_team", "first_batting_team")
            ],
            *[
                F.lit(False).alias(c)
                for c in ("is_completed", "is_no_result", "is_neutral_venue", "is_playoff")
            ],
        )
    )
    spread = F.pmod(F.hash("match_id"), F.lit(REQUEST_DAYS))
    pseudo = pseudo.withColumn("day", F.date_add(F.to_date(F.lit(REQUESTED_FROM)), spread))
    both = shared(base.unionByName(pseudo.select(*base.columns)))
    state = _assemble(both, attack, defence, rosters, include_incomplete=True).where(
        F.col("match_id") < 0
    )
    fixed = [
        "match_date", "toss_decision", "team1_is_home", "is_neutral_venue", "is_playoff",
        "toss_winner_is_team1", "toss_decision_is_bat", "team1_rest_days", "team2_rest_days",
        "rest_days_diff",
    ]
    given = requests.withColumn("asked_venue", F.coalesce("venue", F.lit("Unknown"))).select(
        "request_id", "team1", "team2", "season", F.col("asked_venue").alias("venue"), "match_date",
        F.col("toss_winner").alias("given_toss"), F.col("toss_decision").alias("given_decision"),
        F.coalesce("home_team", "team1").alias("given_home"),
        flag(F.col("is_playoff")).alias("is_playoff"),
        flag(F.col("is_neutral_venue")).alias("is_neutral_venue"),
    )
    rest1 = rest_days(F.col("match_date"), F.col("team1_last_date"))
    rest2 = rest_days(F.col("match_date"), F.col("team2_last_date"))
    joined = given.join(state.drop(*fixed), combination).withColumns(
        {
            "toss_decision": F.coalesce("given_decision", F.lit("unknown")),
            "team1_is_home": flag(F.col("given_home") == F.col("team1")),
            "toss_winner_is_team1": flag(F.col("given_toss") == F.col("team1")),
            "toss_decision_is_bat": flag(F.col("given_decision") == "bat"),
            "team1_rest_days": rest1,
            "team2_rest_days": rest2,
            "rest_days_diff": rest1 - rest2,
        }
    )
    return joined.select(
        "request_id", "match_date", *CATEGORICAL, *NUMERIC, "league_recent_avg_score",
        "venue_recent_avg_score", "team1_venue_avg_score", "team2_venue_avg_score",
    )


# Label, side 1 column, side 2 column, shown as a percentage.
DRIVERS = [
    ("Recent form (last 5)", "team1_form_short", "team2_form_short", True),
    ("Career win rate", "team1_career_win_rate", "team2_career_win_rate", True),
    ("Head-to-head", "team1_h2h_win_rate", None, True),
    ("Record at this venue", "team1_venue_win_rate", "team2_venue_win_rate", True),
    ("Avg runs scored", "team1_avg_runs_scored", "team2_avg_runs_scored", False),
    ("Rest days", "team1_rest_days", "team2_rest_days", False),
]


def drivers(features: DataFrame, keys: Sequence[str] = ("match_id",), digits: int | None = 1) -> DataFrame:
    """The labelled factor pairs behind a prediction, one row each."""

    def value(column: str | None, percent: bool) -> Column:
        if column is None:
            return F.lit(None).cast("double")
        shown = F.col(column) * 100 if percent else F.col(column)
        return shown if digits is None else F.bround(shown, digits)

    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"), value(one, percent).alias("team1_value"),
                value(two, percent).alias("team2_value"),
                F.lit("%" if percent else "").alias("unit"),
            )
            for label, one, two, percent in DRIVERS
        ]
    )
    return features.select(*keys, F.explode(rows).alias("driver")).select(*keys, "driver.*")
