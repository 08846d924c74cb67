"""Actor statistics over attack and defence cards.

Everything is keyed by actor and starts with an aggregation per (actor, contest),
which the distinct contest counts, the milestones and the hauls all share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where, flag, ratio, rounded
from scorebook.functions.timeline import shared


def _selected(cards: DataFrame, season: int | None, team: str | None) -> DataFrame:
    if season is not None:
        cards = cards.where(F.col("season") == season)
    if team is not None:
        cards = cards.where(F.col("team") == team)
    return cards


def _batting(cards: DataFrame, keys: Sequence[str], fifty: int, hundred: int) -> DataFrame:
    per_match = cards.groupBy(*keys, "match_id").agg(
        F.sum("runs").alias("runs"),
        F.sum("balls").alias("balls"),
        F.sum("fours").alias("fours"),
        F.sum("sixes").alias("sixes"),
        F.sum(flag(F.col("is_out"))).alias("dismissals"),
        F.max("runs").alias("best"),
    )
    runs = F.col("runs")
    return per_match.groupBy(*keys).agg(
        F.count("*").alias("innings"),
        F.sum("runs").alias("runs"),
        F.sum("balls").alias("balls"),
        F.sum("fours").alias("fours"),
        F.sum("sixes").alias("sixes"),
        F.sum("dismissals").alias("dismissals"),
        F.max("best").alias("highest_score"),
        count_where((runs >= fifty) & (runs < hundred)).alias("fifties"),
        count_where(runs >= hundred).alias("hundreds"),
        count_where(runs == 0).alias("ducks"),
    )


def batting_leaderboard(
    cards: DataFrame,
    season: int | None = None,
    team: str | None = None,
    min_innings: int = 1,
    keys: Sequence[str] = ("player",),
    fifty: int = 50,
    hundred: int = 100,
    digits: int | None = None,
) -> DataFrame:
    """Batting totals per actor; ``keys`` may add team, place or opposition."""
    table = _batting(_selected(cards, season, team), keys, fifty, hundred)
    boundary = F.col("fours") * 4 + F.col("sixes") * 6
    return table.where(F.col("innings") >= min_innings).select(
        *keys, "innings", "runs", "balls", "fours", "sixes", "dismissals", "highest_score",
        rounded(ratio(F.col("runs"), F.col("dismissals")), digits).alias("average"),
        rounded(ratio(F.col("runs"), F.col("balls"), 100), digits).alias("strike_rate"),
        boundary.alias("boundary_runs"),
        rounded(ratio(boundary, F.col("runs"), 100), digits).alias("boundary_pct"),
        "fifties", "hundreds", "ducks",
    )


def milestones(cards: DataFrame, fifty: int = 50, hundred: int = 100) -> DataFrame:
    return _batting(cards, ["player"], fifty, hundred).select(
        "player", "fifties", "hundreds", "ducks"
    )


def bowling_leaderboard(
    cards: DataFrame,
    season: int | None = None,
    team: str | None = None,
    min_innings: int = 1,
    keys: Sequence[str] = ("player",),
    digits: int | None = None,
) -> DataFrame:
    sums = ("balls", "runs_conceded", "wickets", "maidens", "wides", "no_balls")
    per_match = _selected(cards, season, team).groupBy(*keys, "match_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("wickets").alias("best")
    )
    table = per_match.groupBy(*keys).agg(
        F.count("*").alias("innings"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("best").alias("best_wickets"),
        count_where(F.col("wickets") == 4).alias("four_wicket_hauls"),
        count_where(F.col("wickets") >= 5).alias("five_wicket_hauls"),
    )
    return table.where(F.col("innings") >= min_innings).select(
        *keys, "innings", *sums, "best_wickets",
        rounded(
            F.col("balls").cast("double") / k.BALLS_PER_OVER, None if digits is None else 1
        ).alias("overs"),
        rounded(ratio(F.col("runs_conceded"), F.col("wickets")), digits).alias("average"),
        rounded(
            ratio(F.col("runs_conceded"), F.col("balls"), k.BALLS_PER_OVER), digits
        ).alias("economy"),
        rounded(ratio(F.col("balls"), F.col("wickets")), digits).alias("strike_rate"),
        "four_wicket_hauls", "five_wicket_hauls",
    )


def hauls(cards: DataFrame) -> DataFrame:
    return bowling_leaderboard(cards).select("player", "four_wicket_hauls", "five_wicket_hauls")


def _appearances(attack: DataFrame, defence: DataFrame) -> DataFrame:
    """Actor, contest, team and season of every card, both kinds."""
    columns = ["player", "match_id", "team", "season"]
    return attack.select(*columns).unionByName(defence.select(*columns))


def active_actors(attack: DataFrame, defence: DataFrame, min_matches: int = 1) -> DataFrame:
    return (
        _appearances(attack, defence).select("player", "match_id").distinct()
        .groupBy("player").agg(F.count("*").alias("matches"))
        .where(F.col("matches") >= min_matches)
    )


def career_summary(
    attack: DataFrame,
    defence: DataFrame,
    contests: DataFrame,
    min_matches: int = 1,
    fifty: int = 50,
    hundred: int = 100,
    digits: int | None = None,
) -> DataFrame:
    """One row per actor over both card types and the awards.

    Teams and seasons are distinct before they are listed, so a list holds one
    entry per side or season and never one per card.
    """
    attack, defence = shared(attack), shared(defence)
    seen = _appearances(attack, defence)
    matches = active_actors(attack, defence, min_matches)
    teams = seen.select("player", "team").where(F.col("team").isNotNull()).distinct().groupBy(
        "player"
    ).agg(F.array_sort(F.collect_list("team")).alias("teams"))
    seasons = seen.select("player", "season").where(F.col("season").isNotNull()).distinct().groupBy(
        "player"
    ).agg(F.array_sort(F.collect_list("season")).alias("seasons"))
    awards = (
        contests.where(F.col("player_of_match").isNotNull())
        .groupBy(F.col("player_of_match").alias("player"))
        .agg(F.count("*").alias("player_of_match_awards"))
    )
    batting = batting_leaderboard(attack, fifty=fifty, hundred=hundred, digits=digits)
    bowling = bowling_leaderboard(defence, digits=digits)
    batting = batting.select(
        "player", *[F.col(c).alias(f"batting_{c}") for c in batting.columns if c != "player"]
    )
    bowling = bowling.select(
        "player", *[F.col(c).alias(f"bowling_{c}") for c in bowling.columns if c != "player"]
    )
    return (
        matches.join(teams, "player", "left").join(seasons, "player", "left")
        .join(awards, "player", "left").join(batting, "player", "left")
        .join(bowling, "player", "left")
        .withColumn(
            "player_of_match_awards", F.coalesce("player_of_match_awards", F.lit(0))
        )
    )


def season_trend(attack: DataFrame, defence: DataFrame, digits: int | None = None) -> DataFrame:
    keys = ["player", "season"]
    batting = attack.groupBy(*keys, "match_id").agg(
        F.sum("runs").alias("runs"), F.sum("balls").alias("balls"),
        F.sum(flag(F.col("is_out"))).alias("outs"),
    ).groupBy(*keys).agg(
        F.count("*").alias("innings"),
        F.sum("runs").alias("runs"),
        rounded(ratio(F.sum("runs"), F.sum("outs")), digits).alias("batting_average"),
        rounded(ratio(F.sum("runs"), F.sum("balls"), 100), digits).alias("strike_rate"),
    )
    bowling = defence.groupBy(*keys).agg(
        F.sum("wickets").alias("wickets"),
        rounded(
            ratio(F.sum("runs_conceded"), F.sum("balls"), k.BALLS_PER_OVER), digits
        ).alias("economy"),
    )
    return batting.join(bowling, keys, "full")


def _split(cards: DataFrame, by: str, digits: int | None) -> DataFrame:
    return batting_leaderboard(cards, keys=("player", by), digits=digits)


def place_split(cards: DataFrame, min_innings: int = 2, digits: int | None = None) -> DataFrame:
    return (
        _split(cards, "venue", digits).where(F.col("innings") >= min_innings)
        .select(
            "player", "venue", "innings", "runs", "balls", "dismissals", "highest_score",
            "average", "strike_rate",
        )
    )


def opposition_split(cards: DataFrame, digits: int | None = None) -> DataFrame:
    return _split(cards, "opposition", digits).select(
        "player", "opposition", "innings", "runs", "balls", "dismissals", "average", "strike_rate"
    )


def compare_actors(
    players: Sequence[str],
    attack: DataFrame,
    defence: DataFrame,
    contests: DataFrame,
    digits: int | None = None,
) -> DataFrame:
    """Side by side in the order asked for; an unknown name gives zeros and nulls.

    Cards are cut down to the named actors before anything is aggregated.
    """
    spark = attack.sparkSession
    wanted = spark.createDataFrame(
        [(i + 1, p) for i, p in enumerate(players)], "list_position int, player string"
    )
    names = wanted.select("player").distinct()
    career = career_summary(
        attack.join(names, "player", "left_semi"),
        defence.join(names, "player", "left_semi"),
        contests,
        digits=digits,
    )
    zero = F.lit(0)
    return wanted.join(career, "player", "left").select(
        "list_position", "player",
        F.coalesce("matches", zero).alias("matches"),
        F.coalesce("batting_runs", zero).alias("runs"),
        F.col("batting_average"),
        F.col("batting_strike_rate").alias("strike_rate"),
        F.coalesce("batting_fifties", zero).alias("fifties"),
        F.coalesce("batting_hundreds", zero).alias("hundreds"),
        F.coalesce("bowling_wickets", zero).alias("wickets"),
        F.col("bowling_average"),
        F.col("bowling_economy").alias("economy"),
        F.coalesce("player_of_match_awards", zero).alias("player_of_match_awards"),
    )


def runs_by_season(cards: DataFrame, players: Sequence[str]) -> DataFrame:
    """Season by actor matrix of runs."""
    return (
        cards.where(F.col("player").isin(*players)).groupBy("season")
        .pivot("player", list(players)).agg(F.sum("runs"))
    )


def scorecard(
    periods: DataFrame, attack: DataFrame, defence: DataFrame, match_id: int
) -> DataFrame:
    """Both innings of one contest as lines in display order: batters by position,
    bowlers by overs, then the extras that are not zero."""
    one = F.col("match_id") == match_id
    batting = attack.where(one).select(
        "innings_no", F.lit(1).alias("block"), F.col("batting_position").cast("long").alias("line"),
        F.col("player").alias("name"), "runs", "balls", "fours", "sixes",
        F.lit(None).cast("long").alias("wickets"), F.col("dismissal_kind").alias("note"),
    )
    by_overs = Window.partitionBy("innings_no").orderBy(F.desc("balls"), "player")
    bowling = defence.where(one).select(
        "innings_no", F.lit(2).alias("block"), F.row_number().over(by_overs).cast("long").alias("line"),
        F.col("player").alias("name"), F.col("runs_conceded").alias("runs"), "balls",
        F.lit(None).cast("long").alias("fours"), F.lit(None).cast("long").alias("sixes"),
        "wickets", F.lit(None).cast("string").alias("note"),
    )
    kinds = [c for c in ("byes", "leg_byes", "wides", "no_balls") if c in periods.columns]
    extras = (
        periods.where(one).select("innings_no", *kinds)
        .unpivot(["innings_no"], kinds, "name", "runs").where(F.col("runs") > 0)
    )
    by_name = Window.partitionBy("innings_no").orderBy("name")
    extras = extras.select(
        "innings_no", F.lit(3).alias("block"), F.row_number().over(by_name).cast("long").alias("line"),
        "name", "runs", *[F.lit(None).cast("long").alias(c) for c in ("balls", "fours", "sixes", "wickets")],
        F.lit(None).cast("string").alias("note"),
    )
    return batting.unionByName(bowling).unionByName(extras)


def squad_leaders(
    attack: DataFrame, defence: DataFrame, top: int = 12, digits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Leading run scorers and wicket takers of every side."""
    runs = batting_leaderboard(attack, keys=("team", "player"), digits=digits)
    wickets = bowling_leaderboard(defence, keys=("team", "player"), digits=digits)
    by_runs = Window.partitionBy("team").orderBy(F.desc("runs"), "player")
    by_wickets = Window.partitionBy("team").orderBy(F.desc("wickets"), "player")
    return (
        runs.withColumn("rank", F.row_number().over(by_runs)).where(F.col("rank") <= top),
        wickets.withColumn("rank", F.row_number().over(by_wickets)).where(F.col("rank") <= top),
    )
