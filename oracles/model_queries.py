"""Registered evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracles.queries import (
    awards,
    card_tables,
    chases,
    full_features,
    live_states,
    register,
    requests,
)
from scorebook.operators import history
from scorebook.plans import evaluate, learn
from scorebook.sources import testdata as td

# Small candidates: the registered runs check the jobs, not the models.
QUICK = learn.Effort(
    trees=10, classifier_depth=4, regressor_depth=4, rounds=5, boosted_depth=2, step=0.3
)
LINEAR_ONLY = learn.Effort(candidates=(learn.LINEAR,))
TEST_FROM = 2000


def predictions(spark, sf_dir):
    """Labels with a score that both engines can compute from the key."""
    labels = td.table(spark, sf_dir, "labels")

    def scored(model, label, factor):
        p = ((F.col("doc_id") * factor + 13) % 1000).cast("double") / 1000.0
        lifted = F.least(F.lit(1.0), p * 0.7 + F.col(label) * 0.3)
        return labels.select(
            F.lit(model).alias("model"), "doc_id", F.col(label).alias("label"), lifted.alias("probability")
        )

    return scored("quality", "quality", 7919).unionByName(scored("toxic", "toxic", 104729))


@register("m1_clean_features")
def _m1(spark, sf_dir):
    broken = history.contest_features(
        td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir)
    ).select(
        "match_id",
        F.when(F.col("match_id") % 3 == 0, F.lit(float("inf"))).when(
            F.col("match_id") % 3 == 1, F.lit(float("nan"))
        ).otherwise(F.col("team1_form_short")).alias("team1_form_short"),
        F.when(F.col("match_id") % 4 == 0, F.lit(None)).otherwise(F.col("venue")).alias("venue"),
    )
    return learn.clean_features(broken, ["team1_form_short", "absent"], ["venue", "nowhere"])


@register("m2_split_by_season")
def _m2(spark, sf_dir):
    rows = td.headers(spark, sf_dir).select("match_id", "season")
    out = None
    for cut in (TEST_FROM, 2100):
        for part, frame in zip(("train", "test"), learn.split_by_season(rows, cut)):
            counted = frame.groupBy("season").agg(F.count("*").alias("rows")).select(
                F.lit(cut).alias("test_from"), F.lit(part).alias("part"), "season", "rows"
            )
            out = counted if out is None else out.unionByName(counted)
    return out


def _digits(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("m11_classification_metrics")
def _m11(spark, sf_dir):
    table = evaluate.classification_metrics(predictions(spark, sf_dir), ["model"])
    return _digits(table, "log_loss", "brier", "roc_auc")


@register("m12_regression_metrics")
def _m12(spark, sf_dir):
    rows = td.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_quantity") * 3).alias("label"),
        (F.col("l_quantity") * 3 + F.col("l_suppkey") % 31 - 12).alias("prediction"),
    )
    table = evaluate.regression_metrics(rows, ["model"])
    return _digits(table, "rmse", "mae", "r2", "mean_error", "within_10", "within_20", "residual_std")


def _candidate_metrics(spark, sf_dir):
    """One row per (side, season) that plays the part of task and model."""
    return td.headers(spark, sf_dir).groupBy(
        F.col("team1").alias("task"), F.concat(F.lit("m"), "season").alias("model")
    ).agg(
        F.when(F.count("*") % 3 != 0, F.count("*").cast("double")).alias("roc_auc"),
        F.sum("place_key").cast("double").alias("rmse"),
    )


@register("m13_pick_best")
def _m13(spark, sf_dir):
    table = _candidate_metrics(spark, sf_dir)
    return evaluate.pick_best(table, "roc_auc", ["task"]).join(
        evaluate.pick_best(table, "rmse", ["task"]).withColumnRenamed("best_model", "best_by_rmse"),
        "task",
    )


@register("m14_calibration_table")
def _m14(spark, sf_dir):
    return _digits(evaluate.calibration_table(predictions(spark, sf_dir), ["model"]), "predicted")


@register("m15_roc_points")
def _m15(spark, sf_dir):
    return _digits(evaluate.roc_points(predictions(spark, sf_dir), ["model"]), "threshold")


@register("m17_comparison_table")
def _m17(spark, sf_dir):
    return evaluate.comparison_table(
        _candidate_metrics(spark, sf_dir), "roc_auc", {"m1999": "old", "m2001": "new"}
    )


@register("m7_winner_task")
def _m7(spark, sf_dir):
    return learn.winner_task(full_features(spark, sf_dir), TEST_FROM, QUICK).metrics


@register("m8_score_task")
def _m8(spark, sf_dir):
    return learn.score_task(full_features(spark, sf_dir), TEST_FROM, QUICK).metrics


@register("m9_chase_task")
def _m9(spark, sf_dir):
    return learn.chase_task(chases(spark, sf_dir), TEST_FROM, QUICK).metrics


@register("m10_award_task")
def _m10(spark, sf_dir):
    return learn.award_task(awards(spark, sf_dir), TEST_FROM, QUICK).metrics


@register("m6_class_balance")
def _m6(spark, sf_dir):
    features = history.shared(full_features(spark, sf_dir))
    rows = {"winner": features, "first_innings_score": features, "chase": chases(spark, sf_dir), "award": awards(spark, sf_dir)}
    out = None
    for name, task in learn.TASKS.items():
        table = learn.class_balance(task, rows[name], TEST_FROM)
        out = table if out is None else out.unionByName(table)
    return out


@register("m22_training_summary")
def _m22(spark, sf_dir):
    features = history.shared(full_features(spark, sf_dir))
    trained = learn.train_all(features, chases(spark, sf_dir), awards(spark, sf_dir), TEST_FROM, QUICK)
    return learn.training_summary(trained).select(
        "task", "model", "family", "is_best", "train_rows", "support"
    )


@register("m10_top1_accuracy")
def _m10_top1(spark, sf_dir):
    """The batting impact stands in for a score, so both engines can rank it."""
    rows = awards(spark, sf_dir).where("target_is_award IS NOT NULL").select(
        "match_id", "player", F.col("target_is_award").alias("label"),
        F.col("runs").cast("double").alias("probability"),
    )
    return evaluate.top1_accuracy(rows)


@register("m21_award_share")
def _m21_share(spark, sf_dir):
    """Ranking of every contest, also those whose award is open, on a score both engines have."""
    rows = awards(spark, sf_dir).withColumn("probability", F.col("runs").cast("double"))
    return evaluate.in_contest_share(rows).select("match_id", "rank", "player", "team", "award_probability")


@register("m16_feature_importance")
def _m16(spark, sf_dir):
    trained = learn.chase_task(
        chases(spark, sf_dir, 3), TEST_FROM,
        learn.Effort(trees=10, classifier_depth=4, candidates=(learn.FOREST,)),
    )
    return learn.feature_importance(trained.model, spark)


@register("m18_score_winners")
def _m18(spark, sf_dir):
    trained = learn.winner_task(full_features(spark, sf_dir), TEST_FROM, LINEAR_ONLY)
    cards, spells, lineups = card_tables(spark, sf_dir)
    features = history.featurise_requests(
        requests(spark, sf_dir), td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir),
        cards, spells, lineups,
    )
    return learn.score_winners(trained.model, features).select(
        "request_id", "team1", "team2", "predicted_winner", "team1_win_probability", "confidence"
    )


@register("m19_score_totals")
def _m19(spark, sf_dir):
    features = history.shared(full_features(spark, sf_dir, True))
    trained = learn.score_task(features.where("is_completed"), TEST_FROM, LINEAR_ONLY)
    rows = history.score_features(features, require_total=False)
    return learn.score_totals(trained.model, rows, trained.residual_std).select(
        "match_id", "prediction", "low", "high"
    )


def _live_model(spark, sf_dir):
    return learn.chase_task(chases(spark, sf_dir, 3), TEST_FROM, LINEAR_ONLY).model


@register("m20_score_chases")
def _m20(spark, sf_dir):
    scored, _ = learn.score_chases(_live_model(spark, sf_dir), live_states(spark, sf_dir))
    return scored.select("match_id", "ball_seq", "probability", "required_run_rate")


@register("m21_rank_awards")
def _m21(spark, sf_dir):
    rows = history.shared(awards(spark, sf_dir))
    trained = learn.award_task(rows, TEST_FROM, LINEAR_ONLY)
    return learn.rank_awards(trained.model, rows).select(
        "match_id", "rank", "player", "team", "award_probability"
    )


@register("r4_fixture_probabilities")
def _r4(spark, sf_dir):
    league, scores = td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir)
    trained = learn.winner_task(
        history.contest_features(league, scores), TEST_FROM, LINEAR_ONLY
    )
    return learn.fixture_probabilities(trained.model, league, periods=scores)
