"""Metrics over scored predictions, computed as aggregations.

Ranks are needed for AUC and ROC. Predictions are first summed per distinct score,
then dealt to range partitions by score, and the running state of
:mod:`scorebook.functions.timeline` is carried from range to range (one total a
range), so no task ever sorts all predictions and no score is compared with cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.rates import count_where, flag, ratio
from scorebook.functions.timeline import Running, running, shared

LOWER_IS_BETTER = ("rmse", "mae", "log_loss", "brier", "mean_error")


def _per_score(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, dealt over range partitions of
    (key, falling score). The partition number is written with the row, so it is the
    same wherever the row is read again."""
    table = predictions.groupBy(*keys, "probability").agg(
        count_where(F.col("label") == 1).alias("positives"),
        count_where(F.col("label") == 0).alias("negatives"),
    ).withColumn("falling", -F.col("probability"))
    dealt = table.repartitionByRange(*keys, "falling")
    return shared(dealt.withColumn("score_range", F.spark_partition_id()))


def _ranked(predictions: DataFrame, keys: Sequence[str], inclusive: bool) -> DataFrame:
    """Distinct scores with the positives and negatives above them."""
    return running(
        _per_score(predictions, keys),
        [
            Running(
                list(keys),
                {"positives_above": F.col("positives"), "negatives_above": F.col("negatives")},
            )
        ],
        day="score_range",
        order=("falling",),
        inclusive=inclusive,
    )


def classification_metrics(
    predictions: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Metrics of (label, probability) rows, one row per key.

    AUC counts a negative below a positive as one and a tie as a half; it and the
    log loss are null when only one class is present.
    """
    p, y = F.col("probability"), F.col("label")
    predicted = p >= threshold
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = -F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    n = F.count("*")
    both = (F.sum(y) > 0) & (F.sum(y) < n)
    basic = predictions.groupBy(*keys).agg(
        n.alias("support"),
        count_where(predicted & (y == 1)).alias("true_positive"),
        count_where(predicted & (y == 0)).alias("false_positive"),
        count_where(~predicted & (y == 1)).alias("false_negative"),
        count_where(~predicted & (y == 0)).alias("true_negative"),
        F.when(both, F.avg(loss)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        ratio(F.sum(y), n).alias("positive_rate"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    zero = F.lit(0.0)
    basic = basic.withColumns(
        {
            "accuracy": (tp + F.col("true_negative")) / F.col("support").cast("double"),
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(ratio(tp, tp + fn), zero),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        }
    )
    ranked = _ranked(predictions, keys, inclusive=False)
    pairs = F.col("negatives") * (2 * F.col("positives_above") + F.col("positives"))
    auc = ranked.groupBy(*keys).agg(
        F.try_divide(
            F.sum(pairs).cast("double"),
            (2 * F.sum("positives") * F.sum("negatives")).cast("double"),
        ).alias("roc_auc")
    )
    if keys:
        return basic.join(auc, list(keys), "left")
    return basic.withColumn("roc_auc", auc.scalar())


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of (label, prediction) rows, one row per key."""
    error = F.col("prediction") - F.col("label")
    n = F.count("*")
    squares = F.sum(error * error)
    spread = F.var_pop("label") * n
    return predictions.groupBy(*keys).agg(
        F.sqrt(squares / n).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(n > 1, F.lit(1.0) - F.try_divide(squares, spread)).alias("r2"),
        F.avg(error).alias("mean_error"),
        F.avg(flag(F.abs(error) <= 10)).alias("within_10"),
        F.avg(flag(F.abs(error) <= 20)).alias("within_20"),
        F.stddev_pop(error).alias("residual_std"),
        n.alias("support"),
    )


def roc_points(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score."""
    points = shared(_ranked(predictions, keys, inclusive=True))
    totals = points.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(
        F.sum("positives").alias("p"), F.sum("negatives").alias("n")
    )
    if keys:
        match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
        points = points.join(totals, match).drop(*[f"__{c}" for c in keys])
    else:
        points = points.withColumns(
            {
                "p": points.select(F.sum("positives")).scalar(),
                "n": points.select(F.sum("negatives")).scalar(),
            }
        )
    return points.where((F.col("p") > 0) & (F.col("n") > 0)).select(
        *keys,
        F.col("probability").alias("threshold"),
        (F.col("negatives_above").cast("double") / F.col("n")).alias("fpr"),
        (F.col("positives_above").cast("double") / F.col("p")).alias("tpr"),
    )


def calibration_table(
    predictions: DataFrame, keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Predicted and observed rate per equal-width bin; empty bins are left out."""
    p = F.col("probability")
    bucket = F.greatest(F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1)), F.lit(0))
    return predictions.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("count"),
        F.avg("probability").alias("predicted"),
        ratio(F.sum("label"), F.count("*")).alias("observed"),
    )


def top1_accuracy(predictions: DataFrame, contest: str = "match_id") -> DataFrame:
    """Share of contests whose highest-scored row is the labelled one. The first
    row wins a tie, by name."""
    pick = predictions.groupBy(contest).agg(
        F.max_by("label", F.struct("probability", F.col("player"))).alias("hit")
    )
    return pick.agg(ratio(F.sum("hit"), F.count("*")).alias("top1_accuracy"))


def pick_best(
    metrics: DataFrame, metric: str, keys: Sequence[str] = (), higher_is_better: bool | None = None
) -> DataFrame:
    """Best model per key; null scores lose, equal scores go by name, and when no
    model has a score the first by name is named."""
    if higher_is_better is None:
        higher_is_better = metric not in LOWER_IS_BETTER
    value = F.col(metric)
    usable = value.isNotNull() & ~F.isnan(value.cast("double"))
    rank = F.when(usable, -value if higher_is_better else value)
    return metrics.groupBy(*keys).agg(
        F.min_by("model", F.struct(flag(~usable), rank, "model")).alias("best_model")
    )


def comparison_table(
    metrics: DataFrame, metric: str, families: dict[str, str], keys: Sequence[str] = ("task",)
) -> DataFrame:
    """All candidates with the chosen one marked."""
    best = pick_best(metrics, metric, keys)
    family = F.lit(None).cast("string")
    for model, name in families.items():
        family = F.when(F.col("model") == model, F.lit(name)).otherwise(family)
    return metrics.join(best, list(keys)).select(
        "*", family.alias("family"), (F.col("model") == F.col("best_model")).alias("is_best")
    ).drop("best_model")


def in_contest_share(scored: DataFrame, top: int = 5, contest: str = "match_id") -> DataFrame:
    """Probability as a share of its contest, best ``top`` rows of each contest."""
    window = Window.partitionBy(contest)
    total = F.sum("probability").over(window)
    share = F.col("probability") / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100
    order = window.orderBy(F.desc("award_probability"), "player")
    return (
        scored.withColumn("award_probability", F.bround(share, 2))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    )


