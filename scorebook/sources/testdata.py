"""Contest-shaped tables derived from the generated star-schema Parquet.

Orders are cut into contests of 60 consecutive keys; the lines of even and odd
orders are its two innings. See ``FIXTURES.md`` section 3 for the rules. Every
table is a plan over the Parquet scan, so filters and column pruning reach it.

An innings here is at most 30 orders, so windows over (match_id, innings_no) are
bounded by the key itself and all of them share one shuffle on ``match_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDERS_PER_CONTEST = 60
# A contest is completed while fewer of its orders than this share are pending.
PENDING_LIMIT = 0.36
# Contests whose roster can be left out: match_id % 13 == 5.
ROSTER_GAP = (13, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batter_runs() -> Column:
    digit = F.col("l_quantity").cast("int") % 10
    return (
        F.when(digit <= 4, F.lit(0)).when(digit <= 7, F.lit(1)).when(digit == 8, F.lit(4))
        .otherwise(F.lit(6))
    )


def scored_lines(lines: DataFrame) -> DataFrame:
    """Line items as unordered, unnamed events; stateless, so it also serves streams."""
    wide = F.col("l_discount") == 0.0
    no_ball = F.col("l_discount") == 0.01
    return (
        lines.withColumn("match_id", F.expr(f"l_orderkey div {ORDERS_PER_CONTEST}"))
        .withColumn("innings_no", (F.lit(1) + F.col("l_orderkey") % 2).cast("int"))
        .withColumn("is_wide", wide)
        .withColumn("is_no_ball", no_ball)
        .withColumn("is_legal", ~(wide | no_ball))
        .withColumn("batter_runs", _batter_runs())
        .withColumn("extra_runs", F.when(wide | no_ball, F.lit(1)).otherwise(F.lit(0)))
        .withColumn("total_runs", F.col("batter_runs") + F.col("extra_runs"))
        .withColumn(
            "is_wicket",
            (F.col("l_returnflag") == "R") & (F.col("l_quantity").cast("int") % 6 == 0),
        )
    )


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(table(spark, sf_dir, "lineitem"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture facts known before a ball is bowled, with ids and names."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")

    def named(alias: str) -> DataFrame:
        return nation.select(
            F.col("n_nationkey").cast("long").alias(f"{alias}_key"), F.col("n_name").alias(alias)
        )

    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("place_key"),
        F.col("n_name").alias("venue"),
        F.col("r_name").alias("city"),
    )
    # The largest order of a bucket names its customer and day; the share of pending
    # orders says whether the contest is over.
    order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.expr(f"o_orderkey div {ORDERS_PER_CONTEST}").alias("match_id"))
        .agg(
            F.max_by(
                F.struct("o_custkey", "o_orderdate"), F.struct("o_totalprice", "o_orderkey")
            ).alias("top"),
            (F.sum((F.col("o_orderstatus") == "P").cast("int")) / F.count(F.lit(1))).alias("pending"),
        )
        .select("match_id", "top.*", "pending")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    fixture = order.join(customer, order.o_custkey == customer.c_custkey).select(
        "match_id",
        "o_custkey",
        F.col("o_orderdate").alias("start_datetime"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.year("o_orderdate").alias("season"),
        (F.col("pending") < PENDING_LIMIT).alias("is_completed"),
        (F.col("c_nationkey") % 10).cast("long").alias("team1_key"),
        ((F.col("c_nationkey") % 10 + 1 + F.col("o_custkey") % 9) % 10)
        .cast("long")
        .alias("team2_key"),
    )
    fixture = fixture.withColumn("place_key", F.col("match_id") % 25)
    toss_first = F.col("o_custkey") % 2 == 0
    decision_bat = F.col("o_custkey") % 3 == 0
    first_is_team1 = toss_first == decision_bat
    final = F.col("match_id") % 21 == 0
    playoff = F.col("match_id") % 7 == 0
    known_order = F.col("match_id") % 11 != 0
    out = (
        fixture.join(named("team1"), "team1_key").join(named("team2"), "team2_key")
        .join(place, "place_key")
    )
    first = F.when(first_is_team1, F.col("team1")).otherwise(F.col("team2"))
    second = F.when(first_is_team1, F.col("team2")).otherwise(F.col("team1"))
    return (
        out.withColumn("bat1", first)
        .withColumn("bat2", second)
        .withColumn("first_is_team1", first_is_team1)
        .select(
            "match_id",
            F.concat_ws(":", F.lit("feed"), "season", "match_id").alias("match_key"),
            "season",
            "match_date",
            "start_datetime",
            F.concat(F.lit("Match "), (F.col("match_id") % 70 + 1).cast("string")).alias(
                "match_number"
            ),
            F.when(final, F.lit("Final")).when(playoff, F.lit("Qualifier"))
            .otherwise(F.lit("League")).alias("stage"),
            playoff.alias("is_playoff"),
            F.when(F.col("match_id") % 5 == 0, F.lit("supplement")).otherwise(F.lit("official"))
            .alias("source"),
            "city",
            (F.col("match_id") % 9 == 0).alias("is_neutral_venue"),
            "is_completed",
            F.when(decision_bat, F.lit("bat")).otherwise(F.lit("field")).alias("toss_decision"),
            (F.col("match_id") % 50 == 7).alias("is_no_result"),
            (F.col("match_id") % 40 == 3).alias("is_super_over"),
            (F.col("match_id") % 23 == 0).alias("is_dls_applied"),
            F.lit(20).alias("overs_per_innings"),
            "venue",
            "team1",
            "team2",
            F.col("team1").alias("home_team"),
            F.col("team2").alias("away_team"),
            F.when(toss_first, F.col("team1")).otherwise(F.col("team2")).alias("toss_winner"),
            F.when(known_order, F.col("bat1")).alias("first_batting_team"),
            F.when(known_order, F.col("bat2")).alias("second_batting_team"),
            "bat1",
            "bat2",
            "team1_key",
            "team2_key",
            "place_key",
            "first_is_team1",
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered, named event stream. One shuffle on match_id serves the join and
    every window."""
    lines = _scored_lines(spark, sf_dir)
    head = headers(spark, sf_dir).select("match_id", "bat1", "bat2", "season", "match_date")
    innings = Window.partitionBy("match_id", "innings_no").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    legal_before = F.coalesce(
        F.sum(F.col("is_legal").cast("int")).over(
            innings.rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    first = F.col("innings_no") == 1
    batting = F.when(first, F.col("bat1")).otherwise(F.col("bat2"))
    bowling = F.when(first, F.col("bat2")).otherwise(F.col("bat1"))

    def actor(side: Column, number: Column) -> Column:
        return F.concat(side, F.lit("_P"), number.cast("string"))

    kind = F.col("l_suppkey") % 5
    over = Window.partitionBy("match_id", "innings_no", "over_no").orderBy("ball_seq")
    return (
        lines.join(head, "match_id")
        .withColumn("ball_seq", F.row_number().over(innings))
        .withColumn("over_no", (F.floor(legal_before / 6) + 1).cast("int"))
        .withColumn("ball_no", F.row_number().over(over))
        .select(
            "match_id",
            "innings_no",
            "over_no",
            "ball_no",
            "ball_seq",
            "batter_runs",
            "extra_runs",
            "total_runs",
            "is_legal",
            "is_wide",
            "is_no_ball",
            (F.col("batter_runs") == 4).alias("is_four"),
            (F.col("batter_runs") == 6).alias("is_six"),
            "is_wicket",
            F.when(
                F.col("is_wicket"),
                F.when(kind == 0, F.lit("caught")).when(kind == 1, F.lit("bowled"))
                .when(kind == 2, F.lit("lbw")).when(kind == 3, F.lit("run out"))
                .otherwise(F.lit("retired hurt")),
            ).alias("wicket_type"),
            batting.alias("batting_team"),
            bowling.alias("bowling_team"),
            actor(batting, F.col("l_partkey") % 11).alias("batter"),
            actor(batting, (F.col("l_partkey") + 1) % 11).alias("non_striker"),
            actor(bowling, (F.col("match_id") + F.col("over_no")) % 6).alias("bowler"),
            F.when(F.col("is_wicket"), actor(batting, F.col("l_partkey") % 11)).alias("dismissed"),
            "season",
            "match_date",
        )
    )


def innings_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and wickets per innings straight from the lines: no ordering needed."""
    return (
        _scored_lines(spark, sf_dir)
        .groupBy("match_id", "innings_no")
        .agg(
            F.sum("total_runs").alias("runs"),
            F.sum(F.col("is_wicket").cast("int")).alias("wickets"),
        )
    )


def contests(spark: SparkSession, sf_dir: str, award: bool = False) -> DataFrame:
    """Contest table with names and outcome. ``award`` adds player_of_match, which
    needs a second aggregation of the lines and is left out unless asked for."""
    head = headers(spark, sf_dir)
    scores = (
        _scored_lines(spark, sf_dir)
        .groupBy("match_id")
        .agg(
            F.sum(F.when(F.col("innings_no") == 1, F.col("total_runs"))).alias("runs1"),
            F.sum(F.when(F.col("innings_no") == 2, F.col("total_runs"))).alias("runs2"),
            F.sum(
                F.when((F.col("innings_no") == 2) & F.col("is_wicket"), 1).otherwise(0)
            ).alias("wickets2"),
        )
    )
    joined = head.join(scores, "match_id", "left")
    decided = F.col("is_completed") & ~F.col("is_no_result")
    first_won = decided & (F.col("runs1") > F.col("runs2"))
    chase_won = decided & (F.col("runs2") > F.col("runs1"))
    tie = decided & (F.col("runs1") == F.col("runs2"))
    runs_margin = F.col("runs1") - F.col("runs2")
    wickets_margin = F.greatest(F.lit(10) - F.col("wickets2"), F.lit(0))
    joined = (
        joined.withColumn(
            "winner", F.when(first_won, F.col("bat1")).when(chase_won, F.col("bat2"))
        )
        .withColumn("is_tie", F.coalesce(tie, F.lit(False)))
        .withColumn(
            "result_type",
            F.when(F.col("is_completed") & F.col("is_no_result"), F.lit("no result"))
            .when(tie, F.lit("tie")).when(first_won, F.lit("runs"))
            .when(chase_won, F.lit("wickets")),
        )
        .withColumn("win_margin_runs", F.when(first_won, runs_margin).cast("int"))
        .withColumn("win_margin_wickets", F.when(chase_won, wickets_margin).cast("int"))
        .withColumn("target_runs", (F.col("runs1") + 1).cast("int"))
    )
    joined = joined.withColumn(
        "result_summary",
        F.when(F.col("result_type") == "no result", F.lit("Match abandoned without a result"))
        .when(F.col("result_type") == "tie", F.lit("Match Tied"))
        .when(
            F.col("result_type") == "runs",
            F.concat(F.col("winner"), F.lit(" Won by "), F.col("win_margin_runs"), F.lit(" Runs")),
        )
        .when(
            F.col("result_type") == "wickets",
            F.concat(
                F.col("winner"), F.lit(" Won by "), F.col("win_margin_wickets"), F.lit(" Wickets")
            ),
        ),
    )
    columns = [
        "match_id", "match_key", "season", "match_date", "start_datetime", "match_number", "stage",
        "is_playoff", "source", "city", "is_neutral_venue", "is_completed", "toss_decision",
        "result_type", "win_margin_runs", "win_margin_wickets", "is_tie", "is_no_result",
        "is_super_over", "is_dls_applied", "target_runs", "result_summary", "overs_per_innings",
        "venue", "team1", "team2", "home_team", "away_team", "toss_winner", "first_batting_team",
        "second_batting_team", "winner",
    ]
    if not award:
        return joined.select(*columns)
    top = (
        _scored_lines(spark, sf_dir)
        .groupBy("match_id", "innings_no", (F.col("l_partkey") % 11).alias("number"))
        .agg(F.sum("batter_runs").alias("scored"))
    )
    best = (
        head.select("match_id", "bat1", "bat2").join(top, "match_id")
        .withColumn(
            "name",
            F.concat(
                F.when(F.col("innings_no") == 1, F.col("bat1")).otherwise(F.col("bat2")),
                F.lit("_P"),
                F.col("number").cast("string"),
            ),
        )
        .groupBy("match_id")
        .agg(F.min(F.struct((-F.col("scored")).alias("rank"), "name")).alias("best"))
        .select("match_id", F.col("best.name").alias("player_of_match"))
    )
    return joined.join(best, "match_id", "left").select(
        *columns,
        F.when(F.col("is_completed") & ~F.col("is_no_result"), F.col("player_of_match")).alias(
            "player_of_match"
        ),
    )


def rosters(
    spark: SparkSession, sf_dir: str, stream: DataFrame | None = None, with_gaps: bool = False
) -> DataFrame:
    """Distinct batters and bowlers per contest and side. ``with_gaps`` leaves some
    contests without a roster, which is what the last-known-roster rule is for."""
    stream = events(spark, sf_dir) if stream is None else stream
    if with_gaps:
        every, rest = ROSTER_GAP
        stream = stream.where(F.col("match_id") % every != rest)
    seen = stream.select(
        "match_id", "season", "match_date",
        F.explode(
            F.array(
                F.struct(F.col("batting_team").alias("team"), F.col("batter").alias("player")),
                F.struct(F.col("bowling_team").alias("team"), F.col("bowler").alias("player")),
            )
        ).alias("seen"),
    )
    number = F.regexp_extract("player", "_P([0-9]+)$", 1).cast("int")
    return (
        seen.select("match_id", "season", "match_date", "seen.*").distinct()
        .select(
            "match_id",
            (number != 10).alias("is_playing_xi"),
            (number == 0).alias("is_captain"),
            (number == 1).alias("is_wicketkeeper"),
            (number % 4 == 3).alias("is_overseas"),
            (number + 1).alias("playing_order"),
            F.when(number < 6, F.lit("batter")).otherwise(F.lit("bowler")).alias("role"),
            "player",
            "team",
            "season",
            "match_date",
        )
    )


def _side_id(name: Column) -> Column:
    return F.regexp_extract(name, "^NATION_([0-9]+)$", 1).try_cast("long") + 1


def _actor_id(name: Column) -> Column:
    side = F.regexp_extract(name, "^NATION_([0-9]+)_P", 1).try_cast("long")
    number = F.regexp_extract(name, "_P([0-9]+)$", 1).try_cast("long")
    return side * 11 + number + 1


def warehouse(spark: SparkSession, sf_dir: str):
    """The same tables in stored form: names replaced by surrogate keys."""
    from scorebook.operators import derive
    from scorebook.sources.warehouse import Warehouse

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    side = nation.where(F.col("n_nationkey") < 10)

    def keyed(df: DataFrame, sides: dict[str, str], actors: dict[str, str]) -> DataFrame:
        df = df.withColumns(
            {
                **{key: _side_id(F.col(name)) for name, key in sides.items()},
                **{key: _actor_id(F.col(name)) for name, key in actors.items()},
            }
        )
        return df.drop(*sides, *actors, "season", "match_date")

    def cards(derived: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return keyed(
            derived(events(spark, sf_dir)), {"team": "team_id"}, {"player": "player_id"}
        )

    def stored_contests() -> DataFrame:
        roles = (
            "team1", "team2", "home_team", "away_team", "toss_winner", "first_batting_team",
            "second_batting_team", "winner",
        )
        return contests(spark, sf_dir, award=True).withColumns(
            {
                **{f"{role}_id": _side_id(F.col(role)) for role in roles},
                "venue_id": _side_id(F.col("venue")),
                "player_of_match_id": _actor_id(F.col("player_of_match")),
            }
        ).withColumnRenamed("match_id", "id").drop(*roles, "venue", "player_of_match")

    def stored_events() -> DataFrame:
        order = Window.partitionBy("match_id", "innings_no").orderBy("ball_seq")
        return keyed(
            events(spark, sf_dir)
            .withColumn("cumulative_runs", F.sum("total_runs").over(order))
            .withColumn("cumulative_wickets", F.sum(F.col("is_wicket").cast("int")).over(order)),
            {"batting_team": "batting_team_id", "bowling_team": "bowling_team_id"},
            {"batter": "batter_id", "bowler": "bowler_id"},
        ).drop("non_striker", "dismissed")

    readers: dict[str, Callable[[], DataFrame]] = {
        "sides": lambda: side.select(
            (F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name")
        ),
        "places": lambda: nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            (F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"),
            F.col("r_name").alias("city"),
        ),
        "actors": lambda: side.select(
            "n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("n")
        ).select(
            (F.col("n_nationkey") * 11 + F.col("n") + 1).cast("long").alias("id"),
            F.concat("n_name", F.lit("_P"), F.col("n").cast("string")).alias("name"),
        ),
        "contests": stored_contests,
        "periods": lambda: keyed(
            derive.period_totals(events(spark, sf_dir)),
            {"batting_team": "batting_team_id", "bowling_team": "bowling_team_id"}, {},
        ),
        "attack_cards": lambda: cards(derive.attack_cards),
        "defence_cards": lambda: cards(derive.defence_cards),
        "dismissals": lambda: cards(derive.dismissals),
        "stands": lambda: keyed(
            derive.stands(events(spark, sf_dir)), {"team": "team_id"},
            {"striker": "striker_id", "non_striker": "non_striker_id"},
        ),
        "events": stored_events,
        "rosters": lambda: keyed(
            rosters(spark, sf_dir), {"team": "team_id"}, {"player": "player_id"}
        ),
    }
    return Warehouse(lambda name: readers[name]())
