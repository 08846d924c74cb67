"""Report tables and convenience views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where, flag, phase_of, ratio, rounded
from scorebook.operators import actors, places, sides


def contests_per_season(contests: DataFrame) -> DataFrame:
    return contests.groupBy("season").agg(F.count("*").alias("matches"))


def place_scoring(
    contests: DataFrame, periods: DataFrame, top: int = 12, min_matches: int = 15
) -> DataFrame:
    """The most used places, re-ordered by their first-innings level."""
    used = (
        places.place_summary(contests, periods, min_matches)
        .orderBy(F.desc("matches"), "venue").limit(top)
    )
    return used.orderBy(F.desc("avg_first_innings"), "venue").select(
        "venue", "matches", "avg_first_innings", "chase_win_pct"
    )


def score_histogram(periods: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range, last bin closed.

    The range is a scalar subquery, so binning is a map over the rows.
    """
    scores = periods.where((F.col("innings_no") == 1) & F.col("runs").isNotNull()).select("runs")
    low = scores.select(F.min("runs")).scalar()
    high = scores.select(F.max("runs")).scalar()
    mean = scores.select(F.avg("runs")).scalar()
    spread = scores.select("runs", low.alias("low"), high.alias("high"), mean.alias("mean_runs"))
    bucket = F.when(F.col("high") == F.col("low"), F.lit(bins // 2)).otherwise(
        F.least(
            F.expr(f"((runs - low) * {bins}) div nullif(high - low, 0)"), F.lit(bins - 1)
        )
    )
    return spread.groupBy(bucket.cast("int").alias("bin"), "low", "high", "mean_runs").agg(
        F.count("*").alias("innings")
    ).select(
        "bin",
        (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / F.lit(float(bins))).alias(
            "from_runs"
        ),
        "innings", "mean_runs",
    )


def phase_rates_by_season(
    events: DataFrame,
    powerplay: int = k.POWERPLAY_OVERS,
    death_from: int = k.DEATH_OVERS_FROM,
    digits: int | None = None,
) -> DataFrame:
    phase = phase_of(F.col("over_no"), powerplay, death_from)
    return (
        events.select("season", "total_runs", "is_legal", phase.alias("phase"))
        .groupBy("season").pivot("phase", ["powerplay", "middle", "death"])
        .agg(rounded(ratio(F.sum("total_runs"), count_where(F.col("is_legal")), 6), digits))
    )


def overview(
    contests: DataFrame,
    periods: DataFrame,
    attack: DataFrame,
    defence: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """Data set size as (metric, value) rows."""
    header = contests.agg(
        F.min("season").cast("long").alias("first_season"),
        F.max("season").cast("long").alias("last_season"),
        F.count("*").alias("contests"),
        count_where(F.col("is_completed")).alias("completed_contests"),
        F.countDistinct("venue").alias("places"),
    )
    names = [
        "first_season", "last_season", "contests", "completed_contests", "places",
    ]
    out = header.unpivot([], names, "metric", "value")
    slots = contests.select(F.explode(F.array("team1", "team2")).alias("team"))
    out = out.unionByName(
        slots.agg(F.countDistinct("team").alias("value")).select(
            F.lit("sides").alias("metric"), "value"
        )
    )
    for name, frame in {
        "periods": periods, "attack_cards": attack, "defence_cards": defence, "events": events,
    }.items():
        out = out.unionByName(
            frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        )
    return out


def leading_batters(attack: DataFrame, top: int = 12, min_innings: int = 1) -> DataFrame:
    return actors.batting_leaderboard(attack, min_innings=min_innings).orderBy(
        F.desc("runs"), "player"
    ).limit(top)


def leading_bowlers(defence: DataFrame, top: int = 12, min_innings: int = 1) -> DataFrame:
    return actors.bowling_leaderboard(defence, min_innings=min_innings).orderBy(
        F.desc("wickets"), "player"
    ).limit(top)


def leading_sides(contests: DataFrame, top: int = 15, min_matches: int = 10) -> DataFrame:
    return sides.team_summary(contests, min_matches).orderBy(F.desc("win_pct"), "team").limit(top)


def highest_totals(periods: DataFrame, top: int = 10) -> DataFrame:
    return periods.orderBy(F.desc("runs"), "match_id", "innings_no").limit(top).select(
        "match_id", "innings_no", F.col("batting_team").alias("team"), "runs", "wickets", "overs",
        "season", "venue",
    )


def leading_scorers(
    attack: DataFrame, min_balls: int = 500, top: int = 20, digits: int | None = None
) -> DataFrame:
    return (
        actors.batting_leaderboard(attack, digits=digits).where(F.col("balls") > min_balls)
        .orderBy(F.desc("runs"), "player").limit(top)
        .select("player", "innings", "runs", "balls", "strike_rate", "average")
    )


def death_economy(
    events: DataFrame,
    death_from: int = k.DEATH_OVERS_FROM,
    min_balls: int = 300,
    top: int = 20,
    digits: int | None = None,
) -> DataFrame:
    economy = ratio(F.sum("total_runs"), F.count("*"), 6)
    return (
        events.where((F.col("over_no") >= death_from) & F.col("is_legal"))
        .groupBy(F.col("bowler").alias("player"))
        .agg(
            F.count("*").alias("balls"),
            F.sum("total_runs").alias("runs"),
            rounded(economy, digits).alias("economy"),
            count_where(F.col("is_wicket")).alias("wickets"),
        )
        .where(F.col("balls") >= min_balls).orderBy("economy", "player").limit(top)
    )


def bat_first_by_season(contests: DataFrame, digits: int | None = None) -> DataFrame:
    """An unknown batting order counts as not batting first."""
    first_won = flag(F.col("winner") == F.col("first_batting_team"))
    return sides.decided(contests).groupBy("season").agg(
        F.count("*").alias("matches"),
        F.sum(first_won).alias("bat_first_wins"),
        rounded(ratio(F.sum(first_won), F.count("*"), 100), digits).alias("bat_first_pct"),
    )


VIEW_COLUMNS = [
    "match_id", "match_key", "season", "match_date", "stage", "is_playoff", "venue", "city",
    "team1", "team2", "toss_winner", "toss_decision", "first_batting_team", "winner",
    "result_type", "win_margin_runs", "win_margin_wickets", "result_summary", "player_of_match",
    "is_completed",
]


def contests_view(contests: DataFrame, name: str = "v_matches") -> DataFrame:
    """The 20-column named view, registered for SQL."""
    view = contests.select(*VIEW_COLUMNS)
    view.createOrReplaceTempView(name)
    return view


def side_records_view(
    contests: DataFrame, name: str = "v_team_records", digits: int | None = None
) -> DataFrame:
    """Record over both slots of completed contests; no-results count as played."""
    slots = contests.where("is_completed").select(
        "winner", F.explode(F.array("team1", "team2")).alias("team")
    ).where(F.col("team").isNotNull())
    wins = flag(F.col("winner") == F.col("team"))
    view = slots.groupBy("team").agg(
        F.count("*").alias("matches"),
        F.sum(wins).alias("wins"),
        rounded(ratio(F.sum(wins), F.count("*"), 100), digits).alias("win_pct"),
    )
    view.createOrReplaceTempView(name)
    return view
