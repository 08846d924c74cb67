"""In-play and award features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import flag, ratio, rounded

# The feature contract.
CHASE_NUMERIC = [
    "target", "current_runs", "wickets_fallen", "wickets_in_hand", "balls_bowled",
    "balls_remaining", "runs_required", "current_run_rate", "required_run_rate",
    "run_rate_pressure", "over_no", "runs_last_5_overs", "wickets_last_5_overs",
    "chase_progress", "is_powerplay", "is_death",
]
# The feature contract.
CHASE_CATEGORICAL = ["batting_team", "bowling_team", "venue"]
# The feature contract.
AWARD_NUMERIC = [
    "runs", "balls", "fours", "sixes", "strike_rate", "boundary_runs", "wickets", "runs_conceded",
    "balls_bowled", "maidens", "economy", "batting_impact", "bowling_impact", "total_impact",
    "team_won", "total_impact_rank", "total_impact_share", "runs_rank", "runs_share",
    "wickets_rank", "wickets_share",
]
RECENT_BALLS = 30


def state_columns(df: DataFrame, digits: int | None) -> DataFrame:
    """Rates and flags from target, current_runs, wickets_fallen, balls_bowled and
    over_no. Training rows and live requests share this."""
    remaining = F.greatest(F.lit(k.FULL_QUOTA_BALLS) - F.col("balls_bowled"), F.lit(0))
    required = F.greatest(F.col("target") - F.col("current_runs"), F.lit(0))
    current_rate = F.coalesce(
        ratio(F.col("current_runs"), F.col("balls_bowled"), k.BALLS_PER_OVER), F.lit(0.0)
    )
    needed_rate = F.least(
        F.coalesce(ratio(required, remaining, k.BALLS_PER_OVER), F.lit(k.MAX_REQUIRED_RATE)),
        F.lit(k.MAX_REQUIRED_RATE),
    )
    return df.withColumns(
        {
            "wickets_in_hand": F.lit(k.MAX_WICKETS) - F.col("wickets_fallen"),
            "balls_remaining": remaining,
            "runs_required": required,
            "current_run_rate": rounded(current_rate, digits),
            "required_run_rate": rounded(needed_rate, digits),
            "run_rate_pressure": rounded(needed_rate - current_rate, digits),
            "chase_progress": rounded(
                F.coalesce(ratio(F.col("current_runs"), F.col("target")), F.lit(0.0)),
                None if digits is None else digits + 1,
            ),
            "is_powerplay": flag(F.col("over_no") <= k.POWERPLAY_OVERS),
            "is_death": flag(F.col("over_no") >= k.DEATH_OVERS_FROM),
        }
    )


def decided(contests: DataFrame) -> DataFrame:
    """Contests with a winner, under the columns that chase rows carry."""
    return contests.where(
        F.col("is_completed") & F.col("winner").isNotNull()
        & ~F.coalesce("is_no_result", F.lit(False))
    ).select(
        "match_id", "winner", F.coalesce("venue", F.lit("Unknown")).alias("venue"),
        F.col("season"), F.col("match_date"),
    )


def chase_features(
    events: DataFrame, contests: DataFrame, stride: int = 1, digits: int | None = 3
) -> DataFrame:
    """One row per ball of a decided chase, with the state after the ball.

    Every window is partitioned by contest (two innings at most), so a stream
    already partitioned by ``match_id`` is not shuffled again.
    """
    label = decided(contests)
    contest = Window.partitionBy("match_id")
    order = Window.partitionBy("match_id", "innings_no").orderBy("ball_seq")
    balls = events.select(
        "match_id", "innings_no", "ball_seq", "over_no", "batting_team", "bowling_team",
        "total_runs", "is_legal", "is_wicket",
    ).withColumn(
        "first_total", F.sum(F.when(F.col("innings_no") == 1, F.col("total_runs"))).over(contest)
    )
    state = (
        balls.where(F.col("innings_no") == 2)
        .withColumns(
            {
                "index": F.row_number().over(order) - 1,
                "side": F.first("batting_team").over(order),
                "other": F.first("bowling_team").over(order),
                "current_runs": F.sum("total_runs").over(order),
                "wickets_fallen": F.sum(flag(F.col("is_wicket"))).over(order),
                "balls_bowled": F.sum(flag(F.col("is_legal"))).over(order),
            }
        )
        .withColumns(
            {
                f"{name}_last_5_overs": F.col(column)
                - F.coalesce(
                    F.lag(column, RECENT_BALLS).over(order), F.first(column).over(order)
                )
                for name, column in {"runs": "current_runs", "wickets": "wickets_fallen"}.items()
            }
        )
        .withColumn("target", F.col("first_total") + 1)
        .where(
            (F.col("index") % stride == 0) & F.col("first_total").isNotNull()
            & F.col("side").isNotNull()
            # Both are monotone, so the end of a chase is a plain filter.
            & (F.col("wickets_fallen") < k.MAX_WICKETS)
            & (F.col("current_runs") < F.col("target"))
        )
        .drop("batting_team", "bowling_team")
        .withColumnsRenamed({"side": "batting_team", "other": "bowling_team"})
    )
    rows = state_columns(state.join(label, "match_id"), digits)
    return rows.select(
        "match_id", "ball_seq", "season", "match_date", *CHASE_CATEGORICAL, *CHASE_NUMERIC,
        flag(F.col("winner") == F.col("batting_team")).alias("target_chase_success"),
    )


def chase_rows(requests: DataFrame, digits: int | None = 3) -> DataFrame:
    """Feature rows for live states given as target, current_runs, wickets_fallen,
    balls_bowled and the three names; recent form defaults to zero."""
    for column in ("runs_last_5_overs", "wickets_last_5_overs"):
        if column not in requests.columns:
            requests = requests.withColumn(column, F.lit(0))
    placed = requests.withColumn(
        "over_no", (F.expr(f"balls_bowled div {k.BALLS_PER_OVER}") + 1).cast("int")
    )
    return state_columns(placed, digits)


def terminal_overrides(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """A finished chase is decided by its score and not by a model."""
    return scored.withColumn(
        probability,
        F.when(F.col("current_runs") >= F.col("target"), F.lit(1.0))
        .when(
            (F.col("wickets_fallen") >= k.MAX_WICKETS)
            | (F.col("balls_bowled") >= k.FULL_QUOTA_BALLS),
            F.lit(0.0),
        )
        .otherwise(F.col(probability)),
    )


def sensitivity_rows(
    requests: DataFrame, reach: int = 60, step: int = 5, digits: int | None = 3
) -> DataFrame:
    """Each live state repeated with more runs on the board, up to one short."""
    ahead = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(reach), F.lit(step)),
            lambda extra: F.least(F.col("current_runs") + extra, F.col("target") - 1),
        )
    )
    return chase_rows(requests.withColumn("current_runs", F.explode(ahead)), digits)


def award_features(attack: DataFrame, defence: DataFrame, contests: DataFrame) -> DataFrame:
    """One row per actor and contest with in-contest ranks and shares.

    Both card kinds are stacked and summed once, which also treats a missing side
    as equal to a missing side. The award is only the label: null while it is open.
    """
    zero = F.lit(0).cast("long")
    labels = contests.select(
        "match_id", "winner", "player_of_match", *(["season"] if "season" in contests.columns else [])
    )
    batting = ["runs", "balls", "fours", "sixes"]
    bowling = {
        "wickets": "wickets", "runs_conceded": "runs_conceded", "balls_bowled": "balls",
        "maidens": "maidens",
    }
    keys = ["match_id", "player", "team"]
    stacked = attack.select(
        *keys, *[F.col(c).cast("long").alias(c) for c in batting], *[zero.alias(c) for c in bowling]
    ).unionByName(
        defence.select(
            *keys, *[zero.alias(c) for c in batting],
            *[F.col(source).cast("long").alias(c) for c, source in bowling.items()],
        )
    )
    rows = stacked.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in [*batting, *bowling]]
    ).join(labels, "match_id")
    strike_rate = F.coalesce(ratio(F.col("runs"), F.col("balls"), 100), F.lit(0.0))
    economy = F.coalesce(
        ratio(F.col("runs_conceded"), F.col("balls_bowled"), k.BALLS_PER_OVER), F.lit(0.0)
    )
    rows = rows.withColumns(
        {
            "strike_rate": strike_rate,
            "economy": economy,
            "boundary_runs": F.col("fours") * 4 + F.col("sixes") * 6,
            "team_won": flag(F.col("winner") == F.col("team")),
            "target_is_award": F.when(
                F.col("player_of_match").isNotNull(), flag(F.col("player_of_match") == F.col("player"))
            ),
        }
    ).withColumns(
        {
            "batting_impact": F.col("runs")
            + (F.col("strike_rate") - k.PAR_STRIKE_RATE) * F.col("balls") / F.lit(100.0),
            "bowling_impact": F.col("wickets") * k.WICKET_IMPACT
            - (F.col("economy") - k.PAR_ECONOMY) * (F.col("balls_bowled") / F.lit(float(k.BALLS_PER_OVER))),
        }
    ).withColumn("total_impact", F.col("batting_impact") + F.col("bowling_impact"))
    return within_contest(rows, ["total_impact", "runs", "wickets"]).drop(
        "winner", "player_of_match"
    )


def within_contest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Min-rank (descending) and share of the absolute total inside a contest."""
    contest = Window.partitionBy("match_id")

    def share(column: str) -> Column:
        # Rounded below any meaning, so that the order of summation cannot show.
        total = F.round(F.sum(F.abs(F.col(column))).over(contest), 9)
        return F.col(column) / F.when(total == 0, F.lit(1.0)).otherwise(total)

    return rows.withColumns(
        {
            **{
                f"{c}_rank": F.rank().over(contest.orderBy(F.desc(c))).cast("double")
                for c in columns
            },
            **{f"{c}_share": share(c) for c in columns},
        }
    )
