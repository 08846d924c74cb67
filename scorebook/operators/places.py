"""Places, phases and scoring levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where, mean_of, phase_of, ratio, rounded
from scorebook.operators.sides import decided, long_form


def place_summary(
    contests: DataFrame,
    periods: DataFrame | None = None,
    min_matches: int = 1,
    digits: int | None = None,
) -> DataFrame:
    """Two aggregations, one per input table, joined on the place."""
    known = F.col("first_batting_team").isNotNull()
    chase_won = known & (F.col("winner") != F.col("first_batting_team"))
    one_digit = None if digits is None else 1
    pct = rounded(ratio(count_where(chase_won), count_where(known), 100), digits)
    summary = decided(contests).groupBy("venue").agg(
        F.count("*").alias("matches"),
        F.countDistinct("season").alias("seasons"),
        F.min_by(
            "city", F.when(F.col("city").isNotNull(), F.struct("match_date", "match_id"))
        ).alias("city"),
        F.when(count_where(known) > 0, count_where(known)).alias("decided"),
        F.when(count_where(known) > 0, count_where(chase_won)).alias("chase_wins"),
        pct.alias("chase_win_pct"),
        rounded(F.lit(100.0) - pct, digits).alias("bat_first_win_pct"),
        rounded(mean_of(F.col("win_margin_runs")), one_digit).alias("avg_win_margin_runs"),
        rounded(mean_of(F.col("win_margin_wickets")), one_digit).alias("avg_win_margin_wickets"),
    ).where(F.col("matches") >= min_matches)
    if periods is None:
        return summary
    first, second = F.col("innings_no") == 1, F.col("innings_no") == 2
    runs = F.when(first, F.col("runs"))
    scoring = periods.where(first | second).groupBy("venue").agg(
        rounded(mean_of(runs), digits).alias("avg_first_innings"),
        F.max(runs).alias("highest_first_innings"),
        F.min(runs).alias("lowest_first_innings"),
        rounded(F.avg(F.when(first, F.col("run_rate"))), digits).alias("avg_run_rate"),
        rounded(mean_of(F.when(second, F.col("runs"))), digits).alias("avg_second_innings"),
    )
    return summary.join(scoring, "venue", "left")


def side_record_by_place(
    contests: DataFrame,
    venue: str | None = None,
    min_matches: int = 1,
    digits: int | None = None,
) -> DataFrame:
    frame = contests if venue is None else contests.where(F.col("venue") == venue)
    return long_form(frame).groupBy("venue", "team").agg(
        F.count("*").alias("matches"),
        F.sum("won").alias("wins"),
        (F.count("*") - F.sum("won")).alias("losses"),
        rounded(ratio(F.sum("won"), F.count("*"), 100), digits).alias("win_pct"),
    ).where(F.col("matches") >= min_matches)


def phase_profile(
    events: DataFrame,
    powerplay: int = k.POWERPLAY_OVERS,
    death_from: int = k.DEATH_OVERS_FROM,
    digits: int | None = None,
) -> DataFrame:
    """Per-innings phase sums first, so the second aggregation is three groups of
    partial means."""
    per_innings = events.groupBy(
        "match_id", "innings_no", phase_of(F.col("over_no"), powerplay, death_from).alias("phase")
    ).agg(
        F.sum("total_runs").alias("runs"),
        count_where(F.col("is_wicket")).alias("wickets"),
        count_where(F.col("is_legal")).alias("balls"),
    )
    table = per_innings.groupBy("phase").agg(
        mean_of(F.col("runs")).alias("avg_runs"),
        mean_of(F.col("wickets")).alias("avg_wickets"),
        mean_of(F.col("balls")).alias("avg_balls"),
        F.count("*").alias("innings"),
    )
    rate = F.when(F.col("avg_balls") > 0, F.col("avg_runs") * 6 / F.col("avg_balls"))
    return table.select(
        F.when(F.col("phase") == "powerplay", 1).when(F.col("phase") == "middle", 2).otherwise(3)
        .alias("phase_order"),
        "phase",
        *[rounded(F.col(c), digits).alias(c) for c in ("avg_runs", "avg_wickets", "avg_balls")],
        "innings",
        rounded(rate, digits).alias("run_rate"),
    )


def scoring_trend(periods: DataFrame, digits: int | None = None) -> DataFrame:
    return periods.where(F.col("innings_no") == 1).groupBy("season").agg(
        F.count("runs").alias("innings"),
        rounded(mean_of(F.col("runs")), digits).alias("avg_score"),
        F.max("runs").alias("highest"),
        rounded(F.avg("run_rate"), digits).alias("avg_run_rate"),
        rounded(mean_of(F.col("sixes")), digits).alias("avg_sixes"),
        rounded(mean_of(F.col("fours")), digits).alias("avg_fours"),
    )


def _first_by(rank: Column, *carried: str) -> Column:
    """Carried columns of the first row by ``rank``, then by date and id."""
    return F.min(
        F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "match_date", "match_id", *carried))
    )


def place_records(
    contests: DataFrame, periods: DataFrame, venue: str | None = None, digits: int | None = None
) -> DataFrame:
    """Headline records of every place (or one)."""
    played = contests.where("is_completed")
    if venue is not None:
        played = played.where(F.col("venue") == venue)
    summary = played.groupBy("venue").agg(
        F.count("*").alias("matches"),
        F.min("match_date").alias("first_match"),
        F.max("match_date").alias("last_match"),
        _first_by(-F.col("win_margin_runs"), "winner").alias("by_runs"),
        _first_by(-F.col("win_margin_wickets"), "winner").alias("by_wickets"),
    )
    totals = (
        periods.drop("venue", "match_date")
        .join(played.select("match_id", "venue", "match_date"), "match_id")
        .groupBy("venue")
        .agg(
            _first_by(-F.col("runs"), "innings_no", "wickets", "batting_team").alias("high"),
            _first_by(F.col("runs"), "innings_no", "wickets", "batting_team").alias("low"),
            rounded(mean_of(F.col("runs")), digits).alias("average_total"),
        )
    )

    def total(name: str, sign: int) -> Column:
        runs = (F.col(f"{name}.rank") * sign).cast("string")
        return F.concat(
            runs, F.lit("/"), F.col(f"{name}.wickets").cast("string"), F.lit(" by "),
            F.col(f"{name}.batting_team"),
        )

    def win(name: str, unit: str) -> Column:
        return F.concat(
            F.col(f"{name}.winner"), F.lit(" by "), (-F.col(f"{name}.rank")).cast("string"),
            F.lit(f" {unit}"),
        )

    return summary.join(totals, "venue", "left").select(
        "venue", "matches", "first_match", "last_match",
        total("high", -1).alias("highest_total"),
        total("low", 1).alias("lowest_total"),
        "average_total",
        win("by_runs", "runs").alias("biggest_win_runs"),
        win("by_wickets", "wickets").alias("biggest_win_wickets"),
    )


def score_history(periods: DataFrame, digits: int | None = None) -> DataFrame:
    """First-innings level of every place by season."""
    return periods.where(F.col("innings_no") == 1).groupBy("venue", "season").agg(
        rounded(mean_of(F.col("runs")), digits).alias("avg_score"),
        F.max("runs").alias("highest"),
        F.min("runs").alias("lowest"),
        F.count("runs").alias("innings"),
    )


def place_list(contests: DataFrame) -> DataFrame:
    return contests.where(F.col("venue").isNotNull()).groupBy("venue").agg(
        F.count("*").alias("matches")
    )


def side_list(contests: DataFrame, active_since: int) -> DataFrame:
    """Distinct sides over both slots; sides seen since a season count as active
    and sort first."""
    slots = contests.select(
        "season", F.explode(F.array("team1", "team2")).alias("team")
    ).where(F.col("team").isNotNull())
    return slots.groupBy("team").agg(
        (F.max("season") >= active_since).alias("is_active")
    ).withColumn("sort_group", F.when(F.col("is_active"), 0).otherwise(1))


def season_list(contests: DataFrame) -> DataFrame:
    return contests.select("season").distinct()


def events_at(events: DataFrame, contests: DataFrame, venue: str) -> DataFrame:
    """Events of the completed contests of one place."""
    ids = contests.where((F.col("venue") == venue) & F.col("is_completed")).select("match_id")
    return events.join(ids, "match_id", "left_semi")


def latest_results(contests: DataFrame, venue: str | None = None, n: int = 8) -> DataFrame:
    """Newest completed contests; the limit is pushed into every task's sort."""
    played = contests.where("is_completed")
    if venue is not None:
        played = played.where(F.col("venue") == venue)
    return played.orderBy(F.desc("match_date"), F.desc("match_id")).limit(n).select(
        "match_id", "match_date", "venue", "team1", "team2", "winner", "result_summary"
    )


def next_fixtures(contests: DataFrame, n: int = 8) -> DataFrame:
    return contests.where(~F.col("is_completed")).orderBy("match_date", "match_id").limit(n).select(
        "match_id", "match_date", "venue", "team1", "team2"
    )


