"""League tables and what is left to play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where, ratio, rounded

TEAM_SEASON = ["season", "team"]


def _league(contests: DataFrame, season: int | None) -> DataFrame:
    frame = contests.where(~F.coalesce("is_playoff", F.lit(False)))
    return frame if season is None else frame.where(F.col("season") == season)


def _positions(table: DataFrame, *order: Column) -> DataFrame:
    """One row per side and season, so the window is bounded by the sides."""
    ranked = Window.partitionBy("season").orderBy(*order, "team")
    return table.withColumn("position", F.row_number().over(ranked))


def standings(
    contests: DataFrame,
    season: int | None = None,
    points_win: int = k.POINTS_WIN,
    points_shared: int = k.POINTS_SHARED,
) -> DataFrame:
    """Points table of every season (or one) over completed league contests.

    Run the winner_not_playing check first: a winner that is neither side would
    leave both sides with a loss.
    """
    shared = F.coalesce("is_no_result", F.lit(False)) | F.col("winner").isNull()
    sides = (
        _league(contests, season)
        .where(F.col("is_completed") & F.col("team1").isNotNull() & F.col("team2").isNotNull())
        .select(
            "season", "winner", shared.alias("shared"),
            F.explode(F.array("team1", "team2")).alias("team"),
        )
    )
    won = ~F.col("shared") & (F.col("winner") == F.col("team"))
    lost = ~F.col("shared") & (F.col("winner") != F.col("team"))
    table = sides.groupBy(*TEAM_SEASON).agg(
        F.count("*").alias("played"),
        count_where(won).alias("won"),
        count_where(lost).alias("lost"),
        count_where(F.col("shared")).alias("no_result"),
    ).withColumn("points", F.col("won") * points_win + F.col("no_result") * points_shared)
    return _positions(table, F.desc("points"), F.desc("won"))


def with_net_run_rate(
    table: DataFrame,
    periods: DataFrame,
    contests: DataFrame,
    season: int | None = None,
    full_quota: int = k.FULL_QUOTA_BALLS,
    max_wickets: int = k.MAX_WICKETS,
    digits: int | None = 3,
) -> DataFrame:
    """Add net run rate and re-rank; a side all out is charged the full quota.

    Each innings is turned into its two sides, so runs for and against come from
    one aggregation.
    """
    counted = _league(contests, season).where("is_completed").select("match_id", "season")
    charged = F.when(F.coalesce("wickets", F.lit(0)) >= max_wickets, F.lit(full_quota)).otherwise(
        F.coalesce("balls", F.lit(full_quota))
    )
    zero = F.lit(0).cast("long")
    runs, balls = F.col("runs").cast("long"), charged.cast("long")
    rows = periods.drop("season").join(counted, "match_id").select(
        "season",
        F.explode(
            F.array(
                F.struct(F.col("batting_team").alias("team"), runs.alias("rf"), balls.alias("bf"),
                         zero.alias("ra"), zero.alias("ba")),
                F.struct(F.col("bowling_team").alias("team"), zero.alias("rf"), zero.alias("bf"),
                         runs.alias("ra"), balls.alias("ba")),
            )
        ).alias("side"),
    )
    totals = rows.groupBy("season", F.col("side.team").alias("team")).agg(
        F.sum("side.rf").alias("runs_for"), F.sum("side.bf").alias("balls_for"),
        F.sum("side.ra").alias("runs_against"), F.sum("side.ba").alias("balls_against"),
    )
    rate = ratio(F.col("runs_for"), F.col("balls_for"), 6) - ratio(
        F.col("runs_against"), F.col("balls_against"), 6
    )
    joined = table.drop("position").join(totals, TEAM_SEASON, "left").withColumn(
        "net_run_rate", rounded(rate, digits)
    )
    return _positions(joined, F.desc("points"), F.desc_nulls_last("net_run_rate"))


def remaining_fixtures(contests: DataFrame, season: int | None = None) -> DataFrame:
    return _league(contests, season).where(~F.col("is_completed") | F.col("winner").isNull())


def remaining_per_side(
    contests: DataFrame,
    table: DataFrame,
    season: int | None = None,
    points_win: int = k.POINTS_WIN,
) -> DataFrame:
    """Contests left and the most points a side can still reach."""
    left = (
        remaining_fixtures(contests, season)
        .where(F.col("team1").isNotNull() & F.col("team2").isNotNull())
        .select("season", F.explode(F.array("team1", "team2")).alias("team"))
        .groupBy(*TEAM_SEASON).agg(F.count("*").alias("matches_remaining"))
    )
    zero = F.lit(0).cast("long")
    return table.select(*TEAM_SEASON, "points", "played").join(left, TEAM_SEASON, "full").select(
        *TEAM_SEASON,
        F.coalesce("points", zero).alias("current_points"),
        F.coalesce("played", zero).alias("matches_played"),
        F.coalesce("matches_remaining", zero).alias("matches_remaining"),
        (F.coalesce("points", zero) + F.coalesce("matches_remaining", zero) * points_win).alias(
            "max_possible_points"
        ),
    )


def with_forced_results(contests: DataFrame, forced: DataFrame) -> DataFrame:
    """Contests with some results set: ``forced`` has match_id and winner."""
    outcome = forced.select("match_id", F.col("winner").alias("__forced"))
    return contests.join(outcome, "match_id", "left").withColumns(
        {
            "winner": F.coalesce("__forced", "winner"),
            "is_completed": F.col("is_completed") | F.col("__forced").isNotNull(),
        }
    ).drop("__forced")

