"""Scorecards derived from the event stream.

All of these group or order by (match_id, innings_no, ...). When the stream is
already partitioned by ``match_id``, Spark reuses that partitioning and none of
them shuffles the events again. An innings is a bounded group by the rules of the
contest (about 120 balls); for a stream where nothing enforces that, pass
``split_rows`` and a long innings is cut into runs that are worked on separately.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where, flag, over_notation, phase_of, ratio
from scorebook.functions.timeline import in_order

INNINGS = ["match_id", "innings_no"]


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")


def flatten_events(docs: DataFrame, max_innings: int = 2) -> DataFrame:
    """Nested innings -> overs -> deliveries to one row per ball.

    ``docs`` has match_id, team1, team2 and ``innings`` (see
    ``schemas.DOCUMENT``); blocks beyond ``max_innings`` are not events.
    """
    balls = (
        docs.select(
            "match_id", "team1", "team2", F.posexplode("innings").alias("block_at", "block")
        )
        .where(F.col("block_at") < max_innings)
        .select(
            "match_id", "team1", "team2",
            (F.col("block_at") + 1).alias("innings_no"),
            F.col("block.team").alias("batting_team"),
            F.posexplode("block.overs").alias("over_at", "over"),
        )
        .select("*", F.posexplode("over.deliveries").alias("ball_at", "ball"))
    )
    extras = F.col("ball.extras")
    wicket = F.try_element_at(F.col("ball.wickets"), F.lit(1))
    batter_runs = F.coalesce(F.col("ball.runs.batter"), F.lit(0))
    extra_runs = F.coalesce(F.col("ball.runs.extras"), F.lit(0))

    def extra(name: str) -> Column:
        return F.coalesce(extras[name], F.lit(0))

    fields = balls.select(
        *INNINGS,
        (F.coalesce(F.col("over.over"), F.lit(0)) + 1).alias("over_no"),
        (F.col("ball_at") + 1).alias("ball_no"),
        "over_at",
        "ball_at",
        "batting_team",
        opponent_of(F.col("batting_team"), F.col("team1"), F.col("team2")).alias("bowling_team"),
        F.col("ball.batter").alias("batter"),
        F.col("ball.non_striker").alias("non_striker"),
        F.col("ball.bowler").alias("bowler"),
        batter_runs.alias("batter_runs"),
        extra_runs.alias("extra_runs"),
        F.coalesce(F.col("ball.runs.total"), batter_runs + extra_runs).alias("total_runs"),
        extras["wides"].isNotNull().alias("is_wide"),
        extras["noballs"].isNotNull().alias("is_no_ball"),
        extras["byes"].isNotNull().alias("is_bye"),
        extras["legbyes"].isNotNull().alias("is_leg_bye"),
        (batter_runs + extra("wides") + extra("noballs") + extra("penalty")).alias("charged_runs"),
        F.coalesce(F.size("ball.wickets"), F.lit(0)).alias("wickets_on_ball"),
        wicket["kind"].alias("wicket_type"),
        wicket["player_out"].alias("dismissed"),
    )
    ordered = Window.partitionBy(*INNINGS).orderBy("over_at", "ball_at")
    return (
        fields.withColumn("wickets_on_ball", F.greatest("wickets_on_ball", F.lit(0)))
        .withColumn("is_legal", ~(F.col("is_wide") | F.col("is_no_ball")))
        .withColumn("is_four", F.col("batter_runs") == 4)
        .withColumn("is_six", F.col("batter_runs") == 6)
        .withColumn("is_wicket", F.col("wickets_on_ball") > 0)
        .withColumn("ball_seq", F.row_number().over(ordered))
        .withColumn("cumulative_runs", F.sum("total_runs").over(ordered))
        .withColumn("cumulative_wickets", F.sum("wickets_on_ball").over(ordered))
        .drop("over_at", "ball_at", "wickets_on_ball")
    )


def has_extra_innings(docs: DataFrame, max_innings: int = 2) -> DataFrame:
    """Contests whose document has more blocks than innings: a super over."""
    return docs.select(
        "match_id", (F.coalesce(F.size("innings"), F.lit(0)) > max_innings).alias("is_super_over")
    )


def opponent_of(side: Column, side1: Column, side2: Column) -> Column:
    return F.when(side == side1, side2).when(side == side2, side1)


def attack_cards(
    events: DataFrame,
    credited: Sequence[str] = k.CREDITED_KINDS,
    not_out: Sequence[str] = k.NOT_OUT_KINDS,
    split_rows: int | None = None,
) -> DataFrame:
    """One row per player who batted, stood at the other end or was dismissed.

    A ball is turned into its (at most three) appearances, so one aggregation of
    one scan yields order of appearance, totals and the last dismissal.
    """
    victim = F.coalesce("dismissed", "batter")
    kind = F.lower("wicket_type")
    rank = F.col("ball_seq") * 3
    balls = in_order(
        events, INNINGS, "ball_seq", {"wicket_no": flag(F.col("is_wicket"))}, split_rows
    )
    out = F.struct(
        "ball_seq",
        F.col("wicket_type").alias("kind"),
        F.col("wicket_no").cast("int").alias("wicket_no"),
    )
    credit = F.struct("ball_seq", "bowler")
    nothing_out = F.lit(None).cast("struct<ball_seq:int,kind:string,wicket_no:int>")
    nothing_credit = F.lit(None).cast("struct<ball_seq:int,bowler:string>")
    zero = F.lit(0)

    def appearance(player: Column, at: Column, faced: bool, fell: bool) -> Column:
        not_wide = ~F.col("is_wide")
        return F.struct(
            player.alias("player"),
            at.alias("seen_at"),
            (F.col("batter_runs") if faced else zero).alias("runs"),
            (flag(not_wide) if faced else zero).alias("balls"),
            (flag(not_wide & (F.col("total_runs") == 0)) if faced else zero).alias("dots"),
            (flag(F.col("is_four")) if faced else zero).alias("fours"),
            (flag(F.col("is_six")) if faced else zero).alias("sixes"),
            (out if fell else nothing_out).alias("dismissal"),
            (F.when(kind.isin(*credited), credit) if fell else nothing_credit).alias("credit"),
        )

    seen = balls.select(
        *INNINGS,
        "batting_team",
        F.explode(
            F.array(
                appearance(F.col("batter"), rank, True, False),
                appearance(F.col("non_striker"), rank + 1, False, False),
                F.when(F.col("is_wicket"), appearance(victim, rank + 2, False, True)),
            )
        ).alias("seen"),
    ).where(F.col("seen.player").isNotNull())
    cards = seen.groupBy(
        *INNINGS, F.col("batting_team").alias("team"), F.col("seen.player").alias("player")
    ).agg(
        F.min("seen.seen_at").alias("seen_at"),
        *[
            F.sum(f"seen.{field}").cast("long").alias(name)
            for field, name in [
                ("runs", "runs"), ("balls", "balls"), ("dots", "dot_balls"),
                ("fours", "fours"), ("sixes", "sixes"),
            ]
        ],
        F.max("seen.dismissal").alias("dismissal"),
        F.max("seen.credit").alias("credit"),
    )
    position = Window.partitionBy(*INNINGS).orderBy("seen_at")
    return cards.select(
        *INNINGS,
        F.row_number().over(position).alias("batting_position"),
        "runs", "balls", "dot_balls", "fours", "sixes",
        ratio(F.col("runs"), F.col("balls"), 100).alias("strike_rate"),
        F.coalesce(
            F.col("dismissal").isNotNull()
            & ~F.coalesce(F.lower("dismissal.kind").isin(*not_out), F.lit(False)),
            F.lit(False),
        ).alias("is_out"),
        F.when(F.col("dismissal").isNull(), F.lit("not out"))
        .otherwise(F.col("dismissal.kind")).alias("dismissal_kind"),
        F.col("credit.bowler").alias("bowler"),
        F.col("dismissal.wicket_no").alias("wicket_number"),
        "player",
        "team",
    )


def _charged(events: DataFrame) -> Column:
    if "charged_runs" in events.columns:
        return F.coalesce("charged_runs", "total_runs")
    return F.col("total_runs")


def bowler_overs(events: DataFrame, credited: Sequence[str] = k.CREDITED_KINDS) -> DataFrame:
    """Per bowler and over: the grain at which a maiden is decided."""
    legal = F.col("is_legal")
    return events.where(F.col("bowler").isNotNull()).groupBy(
        *INNINGS, "bowling_team", "bowler", "over_no"
    ).agg(
        F.min("ball_seq").alias("first_seen"),
        count_where(legal).alias("balls"),
        F.sum(_charged(events)).cast("long").alias("runs"),
        count_where(
            F.col("is_wicket") & F.lower("wicket_type").isin(*credited)
        ).alias("wickets"),
        _sum_where(F.col("is_wide"), F.col("extra_runs")).alias("wides"),
        _sum_where(F.col("is_no_ball"), F.col("extra_runs")).alias("no_balls"),
        count_where(legal & (F.col("total_runs") == 0)).alias("dots"),
    )


def maidens(events: DataFrame, legal_balls: int = k.BALLS_PER_OVER) -> DataFrame:
    """Overs in which the bowler conceded nothing."""
    return bowler_overs(events).where(
        (F.col("runs") == 0) & (F.col("balls") >= legal_balls)
    ).select(*INNINGS, "bowling_team", "bowler", "over_no")


def defence_cards(events: DataFrame, credited: Sequence[str] = k.CREDITED_KINDS) -> DataFrame:
    cards = bowler_overs(events, credited).groupBy(*INNINGS, "bowling_team", "bowler").agg(
        F.min("first_seen").alias("first_seen"),
        F.sum("balls").alias("balls"),
        count_where(
            (F.col("runs") == 0) & (F.col("balls") >= k.BALLS_PER_OVER)
        ).alias("maidens"),
        F.sum("runs").alias("runs_conceded"),
        F.sum("wickets").alias("wickets"),
        F.sum("wides").alias("wides"),
        F.sum("no_balls").alias("no_balls"),
        F.sum("dots").alias("dot_balls"),
    )
    order = Window.partitionBy(*INNINGS).orderBy("first_seen")
    return cards.select(
        *INNINGS,
        F.row_number().over(order).alias("bowling_order"),
        over_notation(F.col("balls")).alias("overs"),
        "balls", "maidens", "runs_conceded", "wickets", "wides", "no_balls", "dot_balls",
        ratio(F.col("runs_conceded"), F.col("balls"), k.BALLS_PER_OVER).alias("economy"),
        F.col("bowler").alias("player"),
        F.col("bowling_team").alias("team"),
    )


def dismissals(events: DataFrame, split_rows: int | None = None) -> DataFrame:
    """One row per wicket ball with the score and legal-ball position after it."""
    sums = {
        "wicket_no": flag(F.col("is_wicket")),
        "fall_score": F.col("total_runs"),
        "legal": flag(F.col("is_legal")),
    }
    return (
        in_order(events, INNINGS, "ball_seq", sums, split_rows)
        .where("is_wicket")
        .select(
            *INNINGS, F.col("wicket_no").cast("int").alias("wicket_no"),
            F.coalesce("dismissed", "batter").alias("player"),
            F.col("batting_team").alias("team"),
            "fall_score",
            over_notation(F.col("legal")).alias("fall_overs"),
            *([F.col("season")] if "season" in events.columns else []),
        )
    )


def stands(events: DataFrame, split_rows: int | None = None) -> DataFrame:
    """Runs added between consecutive wickets, with what each partner made.

    The stand of a ball is the number of wickets before it plus one. Members are
    aggregated first, so a stand row is folded from one row per batter.
    """
    keep = [c for c in ("season", "match_date") if c in events.columns]
    fell = flag(F.col("is_wicket"))
    balls = in_order(
        events, INNINGS, "ball_seq", {"fallen": fell, "legal": flag(F.col("is_legal"))}, split_rows
    ).withColumn("wicket_no", (F.col("fallen") - fell + 1).cast("int"))
    members = balls.groupBy(*INNINGS, "wicket_no", "batting_team", *keep, "batter").agg(
        F.sum("batter_runs").alias("member_runs"),
        count_where(~F.col("is_wide")).alias("member_balls"),
        F.sum("total_runs").alias("runs"),
        F.sum("extra_runs").alias("extras"),
        count_where(~F.col("is_wide")).alias("balls"),
        F.max("legal").alias("legal"),
        F.max(flag(F.col("is_wicket"))).alias("broken"),
        F.max(F.struct("ball_seq", "batter", "non_striker")).alias("last"),
    )
    stand = members.groupBy(*INNINGS, "wicket_no", "batting_team", *keep).agg(
        F.sum("runs").alias("runs"),
        F.sum("balls").alias("balls"),
        F.sum("extras").alias("extras"),
        F.max("legal").alias("legal"),
        F.max("broken").alias("broken"),
        F.max("last").alias("last"),
        # At most one entry per batter of the innings.
        F.map_from_entries(
            F.collect_list(
                F.when(
                    F.col("batter").isNotNull(),
                    F.struct("batter", F.struct("member_runs", "member_balls")),
                )
            )
        ).alias("members"),
    )
    previous = F.lag("legal").over(Window.partitionBy(*INNINGS).orderBy("wicket_no"))
    stand = stand.withColumn(
        "start_over",
        F.when(F.col("wicket_no") == 1, F.lit(0.1)).otherwise(over_notation(previous)),
    ).where((F.col("broken") == 1) | (F.col("balls") > 0))

    def member(name: str, field: str) -> Column:
        player = F.col(f"last.{name}")
        value = F.try_element_at(F.col("members"), player)[field]
        return F.when(player.isNotNull(), F.coalesce(value, F.lit(0)))

    return stand.select(
        *INNINGS, "wicket_no", "runs", "balls",
        member("batter", "member_runs").alias("striker_runs"),
        member("batter", "member_balls").alias("striker_balls"),
        member("non_striker", "member_runs").alias("non_striker_runs"),
        member("non_striker", "member_balls").alias("non_striker_balls"),
        "extras", "start_over",
        over_notation(F.col("legal")).alias("end_over"),
        (F.col("broken") == 0).alias("is_unbroken"),
        F.col("last.batter").alias("striker"),
        F.col("last.non_striker").alias("non_striker"),
        F.col("batting_team").alias("team"),
        *keep,
    )


def period_totals(
    events: DataFrame,
    powerplay: int = k.POWERPLAY_OVERS,
    death_from: int = k.DEATH_OVERS_FROM,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Innings totals, extras by type and phase splits in one aggregation."""
    wicket = F.col("is_wicket")
    phase = phase_of(F.col("over_no"), powerplay, death_from)
    by_type = {
        name: column
        for name, column in {
            "byes": "is_bye", "leg_byes": "is_leg_bye", "wides": "is_wide", "no_balls": "is_no_ball",
        }.items()
        if column in events.columns
    }
    totals = events.groupBy(*INNINGS, "batting_team", "bowling_team").agg(
        F.sum("total_runs").cast("long").alias("runs"),
        count_where(wicket).alias("wickets"),
        count_where(F.col("is_legal")).alias("balls"),
        F.sum("extra_runs").cast("long").alias("extras"),
        *[
            _sum_where(F.col(column), F.col("extra_runs")).alias(name)
            for name, column in by_type.items()
        ],
        *[
            column
            for name in ("powerplay", "middle", "death")
            for column in (
                _sum_where(phase == name, F.col("total_runs")).alias(f"{name}_runs"),
                count_where((phase == name) & wicket).alias(f"{name}_wickets"),
            )
        ],
        count_where(F.col("is_four")).alias("fours"),
        count_where(F.col("is_six")).alias("sixes"),
        count_where(F.col("is_legal") & (F.col("total_runs") == 0)).alias("dot_balls"),
    )
    totals = totals.withColumn("overs", over_notation(F.col("balls"))).withColumn(
        "run_rate", ratio(F.col("runs"), F.col("balls"), k.BALLS_PER_OVER)
    )
    if targets is not None:
        totals = totals.join(targets.select(*INNINGS, "target"), INNINGS, "left")
    return totals


def merge_period_totals(card: DataFrame, derived: DataFrame) -> DataFrame:
    """Scorecard totals win, phases and boundaries come from the events, and the
    derived ball count is used only where the card has none."""
    headline = ["batting_team", "bowling_team", "runs", "wickets", "extras"]
    only_derived = [
        "powerplay_runs", "powerplay_wickets", "middle_runs", "middle_wickets",
        "death_runs", "death_wickets", "fours", "sixes", "dot_balls",
    ]
    both = card.alias("c").join(derived.alias("d"), INNINGS, "full")
    balls = F.coalesce("c.balls", "d.balls")
    runs = F.coalesce("c.runs", "d.runs")
    return both.select(
        *INNINGS,
        *[F.coalesce(f"c.{c}", f"d.{c}").alias(c) for c in headline],
        balls.alias("balls"),
        F.when(F.col("c.balls").isNotNull(), F.coalesce("c.overs", over_notation(balls)))
        .otherwise(over_notation(balls)).alias("overs"),
        F.coalesce("c.run_rate", ratio(runs, balls, k.BALLS_PER_OVER)).alias("run_rate"),
        *[F.col(f"d.{c}").alias(c) for c in only_derived],
    )


def reconcile_periods(card: DataFrame, events: DataFrame) -> DataFrame:
    """Innings whose event sum differs from the scorecard total."""
    derived = events.groupBy(*INNINGS).agg(F.sum("total_runs").cast("long").alias("event_runs"))
    return card.select(*INNINGS, F.col("runs").alias("card_runs")).join(derived, INNINGS).where(
        F.col("card_runs") != F.col("event_runs")
    )


def with_context(cards: DataFrame, contests: DataFrame) -> DataFrame:
    """Add season, date, place and opposition to cards or period rows."""
    context = contests.select("match_id", "season", "match_date", "venue", "team1", "team2")
    joined = cards.drop("season", "match_date").join(context, "match_id")
    if "team" in cards.columns:
        joined = joined.withColumn(
            "opposition",
            F.when(F.col("team") == F.col("team1"), F.col("team2")).otherwise(F.col("team1")),
        )
    return joined.drop("team1", "team2")
