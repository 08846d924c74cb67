"""Records of sides: form, head-to-head, toss and batting order.

A side may have taken part in any share of all contests, so records are plain
aggregations (partial sums before the shuffle) and timelines use the day-split
running state of :mod:`scorebook.functions.timeline`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.rates import count_where, flag, mean_of, ratio, rounded
from scorebook.functions.timeline import Running, rolling_before, running, shared

PAIR = ["side_a", "side_b"]


def decided(contests: DataFrame) -> DataFrame:
    """Completed contests with a winner."""
    return contests.where(F.col("is_completed") & F.col("winner").isNotNull())


def long_form(contests: DataFrame) -> DataFrame:
    """Two rows per decided contest, one per side, from one pass over the table."""

    def side(own: str, other: str) -> Column:
        return F.struct(
            F.col(own).alias("team"),
            F.col(other).alias("opponent"),
            flag(F.col("winner") == F.col(own)).alias("won"),
            flag(F.col("home_team") == F.col(own)).alias("is_home"),
            flag(F.col("first_batting_team") == F.col(own)).alias("batted_first"),
            flag(F.col("toss_winner") == F.col(own)).alias("won_toss"),
        )

    return (
        decided(contests)
        .select(
            "match_id", "season", "match_date", "venue", "is_playoff", "toss_decision",
            "is_no_result",
            F.explode(F.array(side("team1", "team2"), side("team2", "team1"))).alias("side"),
        )
        .select(
            "match_id", "season", "match_date", "venue", "side.team", "side.opponent", "side.won",
            "side.is_home", "is_playoff", "side.batted_first", "side.won_toss", "toss_decision",
            "is_no_result",
        )
        .where(F.col("team").isNotNull())
    )


def title_counts(contests: DataFrame) -> DataFrame:
    return (
        decided(contests).where(F.lower("stage") == "final")
        .groupBy(F.col("winner").alias("team")).agg(F.count("*").alias("titles"))
    )


def team_summary(contests: DataFrame, min_matches: int = 1, digits: int | None = None) -> DataFrame:
    long = long_form(contests)
    won, home, first = F.col("won"), F.col("is_home") == 1, F.col("batted_first") == 1

    def pct(condition: Column) -> Column:
        return rounded(
            ratio(F.sum(F.when(condition, won)), count_where(condition), 100), digits
        )

    # Seasons are few, so the distinct count costs one extra row per side and season.
    summary = long.groupBy("team").agg(
        F.count("*").alias("matches"),
        F.sum("won").alias("wins"),
        F.sum("is_home").alias("home_matches"),
        pct(home).alias("home_win_pct"),
        pct(~home).alias("away_win_pct"),
        pct(first).alias("bat_first_win_pct"),
        pct(~first).alias("chasing_win_pct"),
        F.countDistinct("season").alias("seasons"),
    )
    return (
        summary.where(F.col("matches") >= min_matches)
        .join(title_counts(contests), "team", "left")
        .select(
            "team", "matches", "wins", "home_matches",
            (F.col("matches") - F.col("wins")).alias("losses"),
            rounded(ratio(F.col("wins"), F.col("matches"), 100), digits).alias("win_pct"),
            "home_win_pct", "away_win_pct", "bat_first_win_pct", "chasing_win_pct",
            F.coalesce("titles", F.lit(0)).alias("titles"),
            "seasons",
        )
    )


def season_summary(
    contests: DataFrame, team: str | None = None, digits: int | None = None
) -> DataFrame:
    long = long_form(contests)
    if team is not None:
        long = long.where(F.col("team") == team)
    return long.groupBy("team", "season").agg(
        F.count("*").alias("matches"),
        F.sum("won").alias("wins"),
        (F.count("*") - F.sum("won")).alias("losses"),
        rounded(ratio(F.sum("won"), F.count("*"), 100), digits).alias("win_pct"),
    )


def form_timeline(
    contests: DataFrame, window: int = 5, team: str | None = None, digits: int | None = None
) -> DataFrame:
    """Rolling and expanding win percentage after each contest, for every side."""
    long = long_form(contests).select(
        "match_id", "team", "match_date", "season", "opponent", "venue", "won"
    )
    if team is not None:
        long = long.where(F.col("team") == team)
    long = shared(long)
    placed = running(
        long,
        [Running(["team"], {"match_number": F.lit(1), "wins_to_date": F.col("won")})],
        inclusive=True,
    ).withColumn("place", F.col("match_number") - 1)
    rolled = rolling_before(
        placed, ["team"], "place", {"form": (F.col("won"), window)}, inclusive=True
    )
    return rolled.select(
        "team", "match_number", "match_id", "match_date", "season", "opponent", "venue", "won",
        rounded(ratio(F.col("form_sum"), F.col("form_n"), 100), digits).alias("rolling_win_pct"),
        rounded(
            ratio(F.col("wins_to_date"), F.col("match_number"), 100), digits
        ).alias("cumulative_win_pct"),
    )


def recent_form(contests: DataFrame, n: int = 10, window: int = 5) -> DataFrame:
    """Latest n timeline rows per side. The rank filter is applied before the
    shuffle as well as after it, so at most n rows per side and task move."""
    newest = Window.partitionBy("team").orderBy(F.desc("match_number"))
    return (
        form_timeline(contests, window)
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= n)
        .select(
            "team", "recency", "match_id", "opponent",
            F.when(F.col("won") == 1, F.lit("Won")).otherwise(F.lit("Lost")).alias("result"),
            "rolling_win_pct",
        )
    )


def meetings(contests: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Decided contests with their pair: (a, b) as given, else in name order."""
    frame = decided(contests)
    if a is not None and b is not None:
        frame = frame.where(
            ((F.col("team1") == a) & (F.col("team2") == b))
            | ((F.col("team1") == b) & (F.col("team2") == a))
        )
        first, second = F.lit(a), F.lit(b)
    else:
        frame = frame.where(F.col("team1").isNotNull() & F.col("team2").isNotNull())
        first, second = F.least("team1", "team2"), F.greatest("team1", "team2")
    return (
        frame.withColumn("side_a", first).withColumn("side_b", second)
        .withColumn("a_won", flag(F.col("winner") == F.col("side_a")))
        .withColumn("b_won", flag(F.col("winner") == F.col("side_b")))
    )


def current_streak(contests: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Winner of the latest meeting and how many in a row it has won.

    The run is the meetings after the last one somebody else won, which two
    small aggregates give without ordering a pair's whole history.
    """
    met = meetings(contests, a, b).select(
        *PAIR, "winner", F.struct("match_date", "match_id").alias("at")
    )
    last_wins = met.groupBy(*PAIR, "winner").agg(F.max("at").alias("last_at"))
    latest = last_wins.groupBy(*PAIR).agg(
        F.max_by("winner", "last_at").alias("streak_team"),
        F.sort_array(F.collect_list("last_at"), asc=False).alias("ends"),
    ).select(*PAIR, "streak_team", F.try_element_at("ends", F.lit(2)).alias("broken_at"))
    return (
        met.join(latest, PAIR)
        .where(F.col("broken_at").isNull() | (F.col("at") > F.col("broken_at")))
        .groupBy(*PAIR, "streak_team").agg(F.count("*").alias("streak"))
    )


def last_result(contests: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Latest result text of each pair."""
    return (
        meetings(contests, a, b).where(F.col("result_summary").isNotNull())
        .groupBy(*PAIR)
        .agg(F.max_by("result_summary", F.struct("match_date", "match_id")).alias("last_result"))
    )


def head_to_head(
    contests: DataFrame, a: str | None = None, b: str | None = None, digits: int | None = None
) -> DataFrame:
    record = meetings(contests, a, b).groupBy(*PAIR).agg(
        F.count("*").alias("matches"),
        F.sum("a_won").alias("a_wins"),
        F.sum("b_won").alias("b_wins"),
        count_where(F.col("is_no_result")).alias("no_result"),
        rounded(ratio(F.sum("a_won"), F.count("*"), 100), digits).alias("a_win_pct"),
        rounded(ratio(F.sum("b_won"), F.count("*"), 100), digits).alias("b_win_pct"),
        F.max_by(
            "result_summary",
            F.when(F.col("result_summary").isNotNull(), F.struct("match_date", "match_id")),
        ).alias("last_result"),
    )
    return record.join(current_streak(contests, a, b), PAIR, "left")


def head_to_head_by(
    contests: DataFrame, by: str, a: str | None = None, b: str | None = None
) -> DataFrame:
    return meetings(contests, a, b).groupBy(*PAIR, by).agg(
        F.count("*").alias("matches"),
        F.sum("a_won").alias("a_wins"),
        (F.count("*") - F.sum("a_won")).alias("b_wins"),
    )


def meeting_list(contests: DataFrame, a: str, b: str) -> DataFrame:
    """Meetings of one pair, newest first."""
    return (
        meetings(contests, a, b)
        .orderBy(F.desc("match_date"), F.desc("match_id"))
        .select(
            "match_id", "match_date", "season", "venue", "team1", "team2", "winner",
            "result_summary", *(["player_of_match"] if "player_of_match" in contests.columns else []),
        )
    )


def _tossed(contests: DataFrame) -> DataFrame:
    return decided(contests).where(F.col("toss_winner").isNotNull()).withColumn(
        "toss_winner_won", flag(F.col("toss_winner") == F.col("winner"))
    )


def _toss_measures(digits: int | None) -> list[Column]:
    return [
        F.count("*").alias("matches"),
        F.sum("toss_winner_won").alias("toss_winner_wins"),
        rounded(ratio(F.sum("toss_winner_won"), F.count("*"), 100), digits).alias(
            "toss_winner_advantage_pct"
        ),
    ]


def toss_impact(
    contests: DataFrame, by: str | None = None, digits: int | None = None
) -> DataFrame:
    group = F.lit("All matches") if by is None else F.col(by)
    return _tossed(contests).groupBy(group.alias("group")).agg(*_toss_measures(digits))


def toss_impact_sets(
    contests: DataFrame,
    by: Sequence[str] = ("season", "venue", "toss_decision"),
    digits: int | None = None,
) -> DataFrame:
    """All groupings of :func:`toss_impact` in one aggregation."""
    frame = _tossed(contests).select(
        *[F.col(c).cast("string").alias(c) for c in by], "toss_winner_won"
    )
    sets = [[], *[[F.col(c)] for c in by]]
    grouped = frame.groupingSets(sets, *[F.col(c) for c in by]).agg(
        *_toss_measures(digits), *[F.grouping(c).alias(f"__{c}") for c in by]
    )
    grouping = F.lit("all")
    group = F.lit("All matches")
    for column in by:
        grouping = F.when(F.col(f"__{column}") == 0, F.lit(column)).otherwise(grouping)
        group = F.when(F.col(f"__{column}") == 0, F.col(column)).otherwise(group)
    return grouped.select(
        grouping.alias("grouping"), group.alias("group"), "matches", "toss_winner_wins",
        "toss_winner_advantage_pct",
    )


def batting_first_advantage(
    contests: DataFrame, periods: DataFrame | None = None, digits: int | None = None
) -> DataFrame:
    summary = (
        decided(contests).where(F.col("first_batting_team").isNotNull())
        .withColumn("first_won", flag(F.col("winner") == F.col("first_batting_team")))
        .groupBy("season")
        .agg(F.count("*").alias("matches"), F.sum("first_won").alias("bat_first_wins"))
    )
    pct = rounded(ratio(F.col("bat_first_wins"), F.col("matches"), 100), digits)
    summary = summary.select(
        "season", "matches", "bat_first_wins",
        (F.col("matches") - F.col("bat_first_wins")).alias("chase_wins"),
        pct.alias("bat_first_win_pct"),
        rounded(F.lit(100.0) - pct, digits).alias("chase_win_pct"),
    )
    if periods is None:
        return summary
    scores = periods.where(F.col("innings_no") == 1).groupBy("season").agg(
        rounded(mean_of(F.col("runs")), None if digits is None else 1).alias(
            "avg_first_innings_score"
        )
    )
    return summary.join(scores, "season", "left")


def compare_sides(contests: DataFrame, teams: Sequence[str], digits: int | None = None) -> DataFrame:
    return team_summary(contests, digits=digits).where(F.col("team").isin(*teams))


def season_pivot(contests: DataFrame, teams: Sequence[str], digits: int | None = None) -> DataFrame:
    """Win percentage per season, one column per side."""
    return (
        long_form(contests).where(F.col("team").isin(*teams))
        .groupBy("season").pivot("team", list(teams))
        .agg(rounded(ratio(F.sum("won"), F.count("won"), 100), digits))
    )


def fixture_list(
    contests: DataFrame,
    season: int | None = None,
    team: str | None = None,
    completed: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Page through fixtures, newest first."""
    frame = contests
    if season is not None:
        frame = frame.where(F.col("season") == season)
    if team is not None:
        frame = frame.where((F.col("team1") == team) | (F.col("team2") == team))
    if completed is not None:
        frame = frame.where(F.col("is_completed") == completed)
    return (
        frame.orderBy(F.desc("match_date"), F.desc("match_id")).offset(offset).limit(limit)
        .select(
            "match_id", "season", "match_date", "venue", "team1", "team2", "winner",
            "result_summary", "is_completed",
        )
    )
