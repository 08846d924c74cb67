"""Training, choice, persistence and scoring on a small generated frame."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scorebook.plans import evaluate, learn

SMALL = learn.Effort(trees=5, classifier_depth=3, regressor_depth=3, rounds=3, boosted_depth=2, step=0.3)


@pytest.fixture(scope="module")
def awards(spark):
    from scorebook.operators.inplay import AWARD_NUMERIC

    rng = random.Random(3)
    rows = []
    for match in range(60):
        for player in range(6):
            values = [rng.random() for _ in AWARD_NUMERIC]
            rows.append((match, f"p{player}", "A", 2020 + match // 20, int(values[0] > 0.8), *values))
    names = ", ".join(f"{c} double" for c in AWARD_NUMERIC)
    return spark.createDataFrame(
        rows, f"match_id long, player string, team string, season int, target_is_award int, {names}"
    )


def test_award_model_trains_scores_and_persists(spark, awards, tmp_path):
    trained = learn.award_task(awards, 2022, SMALL)
    assert trained.best in learn.FAMILIES
    table = {r.model: r for r in trained.metrics.collect()}
    assert set(table) == {learn.LINEAR, learn.FOREST, learn.BOOSTED}
    for row in table.values():
        assert 0 <= row.roc_auc <= 1 and 0 <= row.brier <= 1
        assert row.true_positive + row.false_negative + row.false_positive + row.true_negative == row.support
    assert table[trained.best].roc_auc == max(r.roc_auc for r in table.values())
    assert 0 <= trained.extra["top1_accuracy"] <= 1
    root = str(tmp_path)
    learn.save({"award": trained}, root)
    again = learn.load(root, "award")
    ranked = learn.rank_awards(again, awards, top=2)
    assert ranked.groupBy("match_id").count().where("count > 2").count() == 0
    listed = {r.task: r for r in learn.list_models(spark, root + "/metrics").collect()}
    assert listed["award"].is_available and not listed["winner"].is_available
    assert learn.feature_importance(again, spark).agg(F.sum("importance")).first()[0] <= 1.0 + 1e-9


def test_classifiers_score_after_an_observation(spark, awards):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("rows")).collect()
    assert seen.get == {"rows": 3}
    trained = learn.award_task(awards, 2022, SMALL)
    assert trained.scored.count() == 120
    importance = learn.feature_importance(trained.models[learn.FOREST], spark)
    assert abs(importance.agg(F.sum("importance")).first()[0] - 1) < 1e-9


def test_tasks_with_names_score_at_once_after_an_observation(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("rows")).collect()
    assert seen.get == {"rows": 3}
    made = {}
    for task in (learn.WINNER, learn.CHASE):
        rows = spark.range(150).select(
            F.col("id").alias("match_id"), (2020 + F.col("id") % 3).cast("int").alias("season"),
            (F.xxhash64("id") % 2 == 0).cast("int").alias(task.label),
            *[(F.col("id") * (i + 7) % 31).cast("double").alias(c) for i, c in enumerate(task.numeric) if c != "season"],
            *[F.concat(F.lit("name"), F.col("id") % (i + 2)).alias(c) for i, c in enumerate(task.categorical)],
        )
        made[task.name] = learn.train(task, *learn.split_by_season(rows, 2022), SMALL)
        assert made[task.name].scored.count() == 50
    one = learn.score_winners(made["winner"].model, rows.withColumns({"team1": F.lit("A"), "team2": F.lit("B")}))
    assert {r.predicted_winner for r in one.collect()} <= {"A", "B"}


def test_parts_read_rows_made_once(awards):
    for part in learn.task_split(learn.AWARD, awards.where("match_id >= 0"), 2022):
        assert [f for f in part.inputFiles() if "/shared-" in f]


def test_too_few_rows_train_nothing(awards):
    assert learn.award_task(awards.limit(10), 2022, SMALL).best is None


def test_no_model_gives_metrics_without_rows(spark, awards):
    full, few = (learn.award_task(rows, 2022, learn.Effort(candidates=(learn.LINEAR,))) for rows in (awards, awards.limit(10)))
    assert few.model is None and few.metrics.dtypes == full.metrics.dtypes and few.metrics.count() == 0
    totals = spark.range(5).selectExpr("id match_id", "2020 season", "cast(id as double) target_first_innings_runs")
    scores = learn.train(learn.SCORE, totals, totals, SMALL)
    assert scores.model is None and "rmse" in scores.metrics.columns and scores.metrics.count() == 0
    summary = learn.training_summary({"award": full, "first_innings_score": scores})
    assert [(r.task, r.model, r.is_best) for r in summary.collect()] == [("award", learn.LINEAR, True)]
    assert learn.training_summary({"award": few}).select("task", "family", "is_best", "support").count() == 0


def test_no_model_picks_no_winner(spark):
    rows = spark.createDataFrame([(1, "A", "B")], "request_id long, team1 string, team2 string")
    row = learn.score_winners(None, rows).first()
    assert (row.request_id, row.team1) == (1, "A")
    assert row.predicted_winner is row.team1_win_probability is row.team2_win_probability is row.confidence is None


def test_no_model_leaves_live_chases_open(spark):
    rows = spark.createDataFrame(
        [(1, 150, 40, 2, 30), (2, 150, 150, 2, 100), (3, 150, 90, 10, 80), (4, 0, 1, 1, 1)],
        "match_id long, target int, current_runs int, wickets_fallen int, balls_bowled int",
    ).withColumns({c: F.lit("A") for c in learn.CHASE.categorical})
    scored, rejected = learn.score_chases(None, rows)
    assert {r.match_id: r.probability for r in scored.collect()} == {1: None, 2: 1.0, 3: 0.0}
    assert scored.where("match_id = 1").first().required_run_rate == 7.333
    assert [r.match_id for r in rejected.collect()] == [4]


def test_no_model_expects_no_total(spark):
    totals = spark.range(150).selectExpr("id match_id", "2020 season", "cast(id as double) target_first_innings_runs")
    trained = learn.train(learn.SCORE, totals, totals.limit(0), learn.Effort(candidates=(learn.LINEAR,)))
    assert trained.model is None and trained.residual_std is None
    row = learn.score_totals(trained.model, totals, trained.residual_std).first()
    assert row.match_id is not None and row.prediction is row.low is row.high is None


def test_no_model_ranks_nobody(awards):
    ranked = learn.rank_awards(learn.award_task(awards.limit(10), 2022, SMALL).model, awards)
    assert dict(ranked.dtypes)["award_probability"] == "double" and dict(ranked.dtypes)["rank"] == "int"
    assert ranked.count() == 0


def test_no_model_has_no_importance(spark, awards):
    few = learn.award_task(awards.limit(10), 2022, SMALL)
    none_held_out = learn.award_task(awards.where("season = 2020"), 2022, learn.Effort(candidates=(learn.LINEAR,)))
    assert none_held_out.best is None and none_held_out.metrics.count() == 0
    for trained in (few, none_held_out):
        table = learn.feature_importance(trained.model, spark)
        assert table.dtypes == [("feature", "string"), ("importance", "double")] and table.count() == 0


def test_a_forest_without_positives_scores_zero(spark, awards):
    forest = learn.Effort(trees=3, classifier_depth=2, candidates=(learn.FOREST,))
    trained = learn.award_task(awards.withColumn("target_is_award", F.lit(0)), 2022, forest)
    assert trained.best == learn.FOREST and trained.scored.where("probability = 0").count() == 120
    assert learn.feature_importance(trained.model, spark).agg(F.sum("importance")).first()[0] == 0


def test_calibration_counts_every_row(spark):
    rows = spark.range(100).selectExpr("id % 2 as label", "id / 99.0d as probability")
    table = evaluate.calibration_table(rows)
    assert table.agg(F.sum("count")).first()[0] == 100


def test_split_falls_back_to_the_last_season(spark):
    rows = spark.range(30).selectExpr("id", "cast(2020 + id % 3 as int) as season")
    train, test = learn.split_by_season(rows, 2030)
    assert train.count() == 20 and {r.season for r in test.collect()} == {2022}


def brute_auc(rows):
    """Share of (positive, negative) pairs in order, by sorting everything."""
    import numpy as np

    label, p = (np.array(c) for c in zip(*rows))
    _, place, size = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2.0)[place]
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_ranks_of_many_distinct_scores(spark):
    """A million distinct scores, nine tenths of them of one model; the other model has a null name."""
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 10 != 0, F.lit("big")).alias("model"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("label"),
        ((F.col("id") * 7919 % 1_000_003) / F.lit(1_000_003.0)).alias("probability"),
    )
    seen = {}
    for r in rows.toLocalIterator():
        seen.setdefault(r.model, []).append((r.label, r.probability))
    ranked = evaluate._ranked(rows, ["model"], inclusive=False)
    assert ranked.count() == 1_000_000 and ranked.select("score_range").distinct().count() > 4
    plan = ranked._jdf.queryExecution().toString()
    assert "percentile" not in plan and "filter(" not in plan
    pairs = F.col("negatives") * (2 * F.col("positives_above") + F.col("positives"))
    found = ranked.groupBy("model").agg((F.sum(pairs) / (2 * F.sum("positives") * F.sum("negatives"))).alias("auc"))
    for r in found.collect():
        assert r.auc == pytest.approx(brute_auc(seen[r.model]), abs=1e-12)
    last = evaluate.roc_points(rows.where("model is null"), ["model"]).agg(F.max("fpr"), F.max("tpr"), F.count("*")).first()
    assert tuple(last) == (1.0, 1.0, 100_000)


def test_tied_scores_without_keys(spark):
    rows = spark.range(3000).selectExpr("cast(id % 7 = 0 as int) label", "id % 11 / 11.0d as probability")
    value = evaluate.classification_metrics(rows).first()["roc_auc"]
    assert value == pytest.approx(brute_auc([tuple(r) for r in rows.collect()]))
    assert evaluate.classification_metrics(rows.limit(0), ["label"]).count() == 0


def test_tasks_train_at_once_and_alike(spark, awards, monkeypatch):
    import threading

    pools, meet = [], threading.Barrier(2, timeout=120)
    plain = learn.train

    def watched(task, *rows, **options):
        pools.append((task.name, spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("caller")))
        meet.wait()
        return plain(task, *rows, **options)

    monkeypatch.setattr(learn, "train", watched)
    monkeypatch.setattr(learn, "TASKS", {"award": learn.AWARD, "again": learn.AWARD})
    spark.sparkContext.setLocalProperty("caller", "me")
    effort = learn.Effort(candidates=(learn.LINEAR,))
    trained = learn.train_all(awards, awards, awards, 2022, effort)
    assert pools == [("award", "award", "me")] * 2
    one, two = (trained[n].metrics.drop("train_seconds").first() for n in ("award", "again"))
    assert one == two and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    summary = learn.training_summary(trained).collect()
    assert [r.is_best for r in summary] == [True, True] and all(r.train_rows == 240 for r in summary)


@pytest.fixture()
def chase_rows(spark, events, contests, monkeypatch):
    """The chase query's tables are the small ones; rows that a task would train on are kept, not fitted."""
    from oracles import model_queries, queries

    monkeypatch.setattr(queries.td, "events", lambda *_: events)
    monkeypatch.setattr(queries.td, "contests", lambda *_, **__: contests)
    kept = {}

    def keep(rows):
        kept["chase"] = rows
        return learn.Trained(learn.CHASE, None, {}, rows, None)

    monkeypatch.setattr(model_queries.learn, "chase_task", lambda rows, *_: keep(rows))
    monkeypatch.setattr(model_queries.learn, "train_all", lambda _, rows, *__: keep(rows))
    monkeypatch.setattr(model_queries.learn, "training_summary", lambda _: spark.createDataFrame(
        [], "task string, model string, family string, is_best boolean, train_rows long, support long"))
    monkeypatch.setattr(model_queries, "full_features", lambda *_: spark.range(1))
    monkeypatch.setattr(model_queries, "awards", lambda *_: spark.range(1))
    return kept


def _every_open_ball(events, contests):
    from scorebook.operators import inplay

    found = {(r.match_id, r.ball_seq) for r in inplay.chase_features(events, contests).collect()}
    assert {seq % 3 for _, seq in found} == {0, 1, 2}
    return found


def test_the_chase_task_learns_from_every_ball(spark, events, contests, chase_rows):
    from oracles import model_queries

    model_queries._m9(spark, "")
    found = [(r.match_id, r.ball_seq) for r in chase_rows["chase"].select("match_id", "ball_seq").collect()]
    assert len(found) == len(set(found)) and set(found) == _every_open_ball(events, contests)


def test_the_summary_of_all_tasks_learns_chases_from_every_ball(spark, events, contests, chase_rows):
    from oracles import model_queries

    model_queries._m22(spark, "")
    found = [(r.match_id, r.ball_seq) for r in chase_rows["chase"].select("match_id", "ball_seq").collect()]
    assert len(found) == len(set(found)) and set(found) == _every_open_ball(events, contests)
