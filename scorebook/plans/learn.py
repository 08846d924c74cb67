"""Training, evaluation and batch scoring with MLlib pipelines."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.timeline import shared
from scorebook.operators import history, inplay
from scorebook.operators.standings import remaining_fixtures
from scorebook.plans import evaluate
from scorebook.session import ensure_checkpoint_dir

MIN_TRAINING_ROWS = 60
LINEAR, FOREST, BOOSTED = "linear", "random_forest", "gradient_boosting"
FAMILIES = {LINEAR: "Linear", FOREST: "Bagged trees", BOOSTED: "Boosted trees"}


@dataclass(frozen=True)
class Effort:
    """Size of the candidates; the defaults are for a cluster."""

    trees: int = 400
    classifier_depth: int = 8
    regressor_depth: int = 10
    rounds: int = 250
    step: float = 0.05
    boosted_depth: int = 3
    subsample: float = 0.85
    min_rows_per_leaf: int = 5
    seed: int = 42
    candidates: tuple[str, ...] = (LINEAR, FOREST, BOOSTED)


@dataclass(frozen=True)
class Task:
    """What a model is trained on."""

    name: str
    label: str
    numeric: Sequence[str]
    categorical: Sequence[str]
    classification: bool
    metric: str
    contest_rank: bool = False


WINNER = Task("winner", "target_team1_wins", history.NUMERIC, history.CATEGORICAL, True, "roc_auc")
SCORE = Task(
    "first_innings_score", "target_first_innings_runs", history.SCORE_NUMERIC,
    history.SCORE_CATEGORICAL, False, "rmse",
)
CHASE = Task(
    "chase", "target_chase_success", inplay.CHASE_NUMERIC, inplay.CHASE_CATEGORICAL, True, "roc_auc"
)
AWARD = Task("award", "target_is_award", inplay.AWARD_NUMERIC, (), True, "roc_auc", True)
TASKS = {task.name: task for task in (WINNER, SCORE, CHASE, AWARD)}


@dataclass
class Trained:
    """A task's fitted candidates and their held-out metrics; too few rows train no
    candidate and none held out choose none, so ``best`` and ``model`` are None and the
    metrics have no row."""

    task: Task
    best: str | None
    models: dict[str, PipelineModel]
    metrics: DataFrame
    scored: DataFrame | None
    residual_std: float | None = None
    extra: dict[str, float] = field(default_factory=dict)

    @property
    def model(self) -> PipelineModel | None:
        return self.models.get(self.best)


def clean_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Missing columns appear, infinities become null, unknown names say so."""
    columns = {}
    for name in numeric:
        value = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        columns[name] = F.when(finite, value)
    for name in categorical:
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        columns[name] = F.coalesce(value, F.lit("Unknown"))
    return df.withColumns(columns)


def split_by_season(df: DataFrame, test_from: int) -> tuple[DataFrame, DataFrame]:
    """Seasons before / from ``test_from``; when that leaves nothing to test on, the
    last season is held out. The cut is a scalar subquery, not an action."""
    last = df.select(F.max("season")).scalar()
    first = df.select(F.min("season")).scalar()
    marked = df.withColumns({"__last": last, "__first": first})
    cut = F.when(
        (F.col("__last") < test_from) & (F.col("__last") > F.col("__first")), F.col("__last")
    ).otherwise(F.lit(test_from))
    season = F.col("season")
    return (
        marked.where(season < cut).drop("__last", "__first"),
        marked.where(season >= cut).drop("__last", "__first"),
    )


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], scale: bool) -> list:
    """Median imputation (scaled for linear models) and one-hot names; a name not
    seen in training gets its own empty slot."""
    filled = [f"{c}__filled" for c in numeric]
    stages: list = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
    ]
    numbers = "numbers"
    if scale:
        stages.append(
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)
        )
        numbers = "scaled"
    parts = [numbers]
    if categorical:
        indexed = [f"{c}__index" for c in categorical]
        onehot = [f"{c}__onehot" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=onehot, handleInvalid="keep"),
        ]
        parts += onehot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def estimators(task: Task, effort: Effort, rows: int, weighted: bool = False) -> dict[str, object]:
    """Candidates by family. Spark divides the loss by the rows, so a penalty of one on
    the summed loss is 1 / rows here; only the forest weighs the classes."""
    weight = {"weightCol": "weight"} if weighted else {}
    penalty = {"regParam": 1.0 / max(rows, 1), "standardization": False}
    forest = {
        "numTrees": effort.trees, "minInstancesPerNode": effort.min_rows_per_leaf,
        "seed": effort.seed, "labelCol": "label",
    }
    boosted = {
        "maxIter": effort.rounds, "stepSize": effort.step, "maxDepth": effort.boosted_depth,
        "subsamplingRate": effort.subsample, "seed": effort.seed, "labelCol": "label",
    }
    if task.classification:
        models = {
            LINEAR: LogisticRegression(labelCol="label", maxIter=200, **penalty),
            FOREST: RandomForestClassifier(maxDepth=effort.classifier_depth, **forest, **weight),
            BOOSTED: GBTClassifier(**boosted),
        }
    else:
        models = {
            LINEAR: LinearRegression(labelCol="label", elasticNetParam=0.0, **penalty),
            FOREST: RandomForestRegressor(
                maxDepth=effort.regressor_depth, featureSubsetStrategy="sqrt", **forest
            ),
            BOOSTED: GBTRegressor(**boosted),
        }
    return {name: models[name] for name in effort.candidates}


def score(model: PipelineModel | None, rows: DataFrame, classification: bool = True) -> DataFrame:
    """Rows with ``probability`` (or ``prediction``) and without helper columns; null
    where no model is given."""
    if model is None:
        value = "probability" if classification else "prediction"
        return rows.withColumn(value, F.lit(None).cast("double"))
    out = model.transform(rows)
    if classification:
        # A forest that only saw class 0 has no place for class 1.
        positive = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))
        out = out.withColumn("__p", positive)
        return out.select(*rows.columns, F.col("__p").alias("probability"))
    return out.select(*rows.columns, "prediction")


def without_summary(fitted: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same model, read back from the checkpoint folder where its last stage has a
    training summary.

    A summary holds the session it was made in, and a model that scores is sent to the
    tasks whole. A session in which anything was ever observed (the counts of a load)
    cannot be sent, so its classifiers would fit but never score.
    """
    *before, last = fitted.stages
    if not getattr(last, "hasSummary", False):
        return fitted
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    last.write().save(path)
    return PipelineModel([*before, type(last).load(path)])


def held_out_metrics(task: Task, scored: DataFrame, seconds: dict[str, float], train_rows: int) -> DataFrame:
    """One row per candidate of the scored rows."""
    compute = evaluate.classification_metrics if task.classification else evaluate.regression_metrics
    metrics = compute(scored, ["model"])
    took = F.lit(None).cast("double")
    for name, value in seconds.items():
        took = F.when(F.col("model") == name, F.lit(value)).otherwise(took)
    return shared(
        metrics.select(
            F.lit(task.name).alias("task"),
            # Digits beyond these depend on the order in which tasks add their rows.
            *[F.round(c, 12).alias(c) if kind == "double" else F.col(c) for c, kind in metrics.dtypes],
            took.alias("train_seconds"),
            F.lit(train_rows).alias("train_rows"),
        )
    )


def train(
    task: Task,
    train_rows: DataFrame,
    test_rows: DataFrame,
    effort: Effort = Effort(),
    min_rows: int = MIN_TRAINING_ROWS,
) -> Trained:
    """Fit every candidate, score the held-out rows, choose by the task's metric.

    The driver sees row counts, one row of medians per column inside the imputer
    and one row of metrics per candidate; rows stay on the executors.
    """
    columns = [c for c in ("match_id", "player", "season") if c in train_rows.columns]

    def prepared(df: DataFrame) -> DataFrame:
        clean = clean_features(df, task.numeric, task.categorical)
        return clean.select(
            *columns, *[c for c in (*task.numeric, *task.categorical) if c not in columns],
            F.col(task.label).cast("double").alias("label"),
        ).where(F.col("label").isNotNull())

    fit_rows, held_out = shared(prepared(train_rows)), shared(prepared(test_rows))
    known = fit_rows.agg(
        F.count("*").alias("__n"), F.sum("label").alias("__positive"),
        *[F.count(c).alias(c) for c in task.numeric],
    ).first()
    value = "probability" if task.classification else "prediction"
    if known["__n"] < min_rows:
        nothing = fit_rows.where(F.lit(False)).select(
            F.lit(None).cast("string").alias("model"), "label", F.lit(None).cast("double").alias(value)
        )
        return Trained(task, None, {}, held_out_metrics(task, nothing, {}, known["__n"]), None)
    numeric = [c for c in task.numeric if known[c] > 0]
    weighted = task.classification and task.contest_rank
    if weighted:
        positives = max(known["__positive"], 1.0)
        imbalance = (known["__n"] - positives) / positives
        fit_rows = fit_rows.withColumn(
            "weight", F.when(F.col("label") == 1, F.lit(imbalance)).otherwise(F.lit(1.0))
        )
    models, scored = {}, None
    seconds = {}
    for name, estimator in estimators(task, effort, known["__n"], weighted).items():
        stages = preprocessing(numeric, task.categorical, scale=name == LINEAR)
        started = time.monotonic()
        fitted = Pipeline(stages=[*stages, estimator]).fit(fit_rows)
        seconds[name] = round(time.monotonic() - started, 2)
        models[name] = without_summary(fitted, fit_rows.sparkSession)
        rows = score(models[name], held_out, task.classification).select(
            F.lit(name).alias("model"),
            *[c for c in ("match_id", "player") if c in columns], "label", value,
        )
        scored = rows if scored is None else scored.unionByName(rows)
    scored = shared(scored)
    metrics = held_out_metrics(task, scored, seconds, known["__n"])
    best = evaluate.pick_best(metrics, task.metric).first()["best_model"]
    result = Trained(task, best, models, metrics, scored.where(F.col("model") == best))
    if not task.classification:
        chosen = metrics.where(F.col("model") == best).first()
        result.residual_std = chosen["residual_std"] if chosen else None
    if task.contest_rank:
        result.extra = evaluate.top1_accuracy(result.scored).first().asDict()
    return result


def task_split(task: Task, rows: DataFrame, test_from: int) -> tuple[DataFrame, DataFrame]:
    """What a task is trained and tested on. The winner task learns from both
    orientations of every contest and is tested on the given one. Chases and awards come
    from every ball, and both parts and the two ends of the seasons read them, so they
    are made once."""
    if task in (CHASE, AWARD):
        rows = shared(rows)
    if task == WINNER:
        fit, held_out = split_by_season(rows.where("is_completed"), test_from)
        return fit.unionByName(history.mirror(fit).drop("is_mirrored")), held_out
    if task == SCORE:
        rows = history.score_features(rows)
    return split_by_season(rows, test_from)


def class_balance(task: Task, rows: DataFrame, test_from: int) -> DataFrame:
    """Labelled rows of both parts, their positives, and the weight that the forest
    gives a positive row of the training part; null where labels are no classes."""
    out = None
    for part, frame in zip(("train", "test"), task_split(task, rows, test_from)):
        n, positives = F.count(task.label), F.sum(F.col(task.label).cast("double"))
        counted = frame.agg(n.alias("rows"), positives.alias("positives")).select(
            F.lit(task.name).alias("task"), F.lit(part).alias("part"), "rows",
            F.when(F.lit(task.classification), F.coalesce("positives", F.lit(0.0))).alias("positives"),
        )
        out = counted if out is None else out.unionByName(counted)
    weighted = F.lit(task.classification and task.contest_rank) & (F.col("part") == "train")
    most = F.greatest(F.col("positives"), F.lit(1.0))
    return out.withColumn("positive_weight", F.when(weighted, (F.col("rows") - most) / most))


def winner_task(features: DataFrame, test_from: int, effort: Effort = Effort(), **options) -> Trained:
    return train(WINNER, *task_split(WINNER, features, test_from), effort, **options)


def score_task(features: DataFrame, test_from: int, effort: Effort = Effort(), **options) -> Trained:
    return train(SCORE, *task_split(SCORE, features, test_from), effort, **options)


def chase_task(chases: DataFrame, test_from: int, effort: Effort = Effort(), **options) -> Trained:
    return train(CHASE, *task_split(CHASE, chases, test_from), effort, **options)


def award_task(awards: DataFrame, test_from: int, effort: Effort = Effort(), **options) -> Trained:
    return train(AWARD, *task_split(AWARD, awards, test_from), effort, **options)


def train_all(
    features: DataFrame, chases: DataFrame, awards: DataFrame, test_from: int,
    effort: Effort = Effort(), at_once: int = len(TASKS), **options,
) -> dict[str, Trained]:
    """Every task, ``at_once`` of them as concurrent Spark jobs.

    A fit is many short jobs that leave executors idle between them, so the tasks
    overlap. Each thread inherits the caller's local properties and works in a
    scheduler pool named after its task, which the cluster may weigh
    (``spark.scheduler.mode`` FAIR). Both first tasks read ``features``: pass a
    :func:`shared` frame. An error of one task is raised after all have ended.
    """
    spark = features.sparkSession
    carried = inheritable_thread_target(spark)
    rows = {WINNER.name: features, SCORE.name: features, CHASE.name: chases, AWARD.name: awards}

    def one(task: Task) -> Trained:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", task.name)
        return train(task, *task_split(task, rows[task.name], test_from), effort, **options)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = {
            name: pool.submit(carried(partial(one, task))) for name, task in TASKS.items()
        }
    return {name: future.result() for name, future in started.items()}


def training_summary(trained: dict[str, Trained]) -> DataFrame:
    """Every candidate of every task with the winner marked."""
    out = None
    for result in trained.values():
        table = evaluate.comparison_table(result.metrics, result.task.metric, FAMILIES)
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def feature_importance(model: PipelineModel | None, spark: SparkSession, top: int = 25) -> DataFrame:
    """Importance (or absolute coefficient) per feature, scaled to one; no row where no
    model is given. Names come from the model, so this is as small as the model."""
    if model is None:
        return spark.createDataFrame([], "feature string, importance double")
    assembler, fitted = model.stages[-2], model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = [float(v) for v in fitted.featureImportances.toArray()]
    else:
        values = [abs(float(v)) for v in fitted.coefficients.toArray()]
    names: list[str] = []
    encoder = next((s for s in model.stages if s.__class__.__name__ == "OneHotEncoderModel"), None)
    sizes = dict(zip(encoder.getOutputCols(), encoder.categorySizes)) if encoder else {}
    numbers = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    for column in assembler.getInputCols():
        if column in sizes:
            base = column.removesuffix("__onehot")
            width = sizes[column]
            names += [f"{base}[{i}]" for i in range(width)]
        else:
            names += [c.removesuffix("__filled") for c in numbers]
    names = (names + [f"feature_{i}" for i in range(len(names), len(values))])[: len(values)]
    table = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    total = table.select(F.sum("importance")).scalar()
    share = F.col("importance") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    return table.select("feature", share.alias("importance")).orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


# Batch scoring ---------------------------------------------------------------


def score_winners(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """Probability, pick and confidence per feature row; null where no model is given."""
    rows = score(model, clean_features(features, WINNER.numeric, WINNER.categorical))
    p = F.col("probability")
    return rows.withColumns(
        {
            "team1_win_probability": p,
            "team2_win_probability": 1 - p,
            "predicted_winner": F.when(p >= 0.5, F.col("team1")).when(p < 0.5, F.col("team2")),
            "confidence": F.abs(p - 0.5) * 2,
        }
    ).drop("probability")


def fixture_probabilities(
    model: PipelineModel | None, contests: DataFrame, season: int | None = None, **tables
) -> DataFrame:
    """match_id and team1_win_probability of every remaining fixture; a coin toss
    where no model is given."""
    fixtures = remaining_fixtures(contests, season).where(
        F.col("team1").isNotNull() & F.col("team2").isNotNull()
    )
    if model is None:
        return fixtures.select("match_id", F.lit(0.5).alias("team1_win_probability"))
    requests = fixtures.select(
        F.col("match_id").alias("request_id"), "team1", "team2", "venue", "season",
        "is_neutral_venue",
    )
    features = history.featurise_requests(requests, contests, **tables)
    scored = score_winners(model, features)
    return fixtures.select("match_id").join(
        scored.select(F.col("request_id").alias("match_id"), "team1_win_probability"),
        "match_id", "left",
    ).withColumn(
        "team1_win_probability", F.coalesce("team1_win_probability", F.lit(0.5))
    )


def score_totals(
    model: PipelineModel | None, rows: DataFrame, residual_std: float | None
) -> DataFrame:
    """Expected total with a one-sigma range that does not go below zero; null where no
    model is given."""
    out = score(model, clean_features(rows, SCORE.numeric, SCORE.categorical), False)
    spread = F.lit(residual_std).cast("double")
    low = F.col("prediction") - spread
    return out.withColumns(
        {
            # greatest() passes over a null.
            "low": F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))),
            "high": F.col("prediction") + spread,
        }
    )


def score_chases(model: PipelineModel | None, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored live states, rejected requests with the reason). Without a model only
    finished chases have a probability."""
    problem = (
        F.when(F.col("target").isNull() | (F.col("target") <= 0), F.lit("target must be positive"))
        .when(F.col("current_runs").isNull() | (F.col("current_runs") < 0),
              F.lit("runs must not be negative"))
        .when(F.col("wickets_fallen").isNull() | ~F.col("wickets_fallen").between(0, 10),
              F.lit("wickets must be between 0 and 10"))
        .when(F.col("balls_bowled").isNull() | ~F.col("balls_bowled").between(0, 120),
              F.lit("balls must be between 0 and 120"))
    )
    judged = requests.withColumn("error", problem)
    good = inplay.chase_rows(judged.where(F.col("error").isNull()).drop("error"))
    scored = score(model, clean_features(good, CHASE.numeric, CHASE.categorical))
    return inplay.terminal_overrides(scored), judged.where(F.col("error").isNotNull())


def rank_awards(model: PipelineModel | None, awards: DataFrame, top: int = 5) -> DataFrame:
    """Best ``top`` rows of each contest by their share of the award. Without a model
    there is nothing to rank by, so no row is ranked."""
    scored = score(model, clean_features(awards, AWARD.numeric, ()))
    if model is None:
        scored = scored.where(F.lit(False))
    return evaluate.in_contest_share(scored, top)


# Persistence -----------------------------------------------------------------


def save(trained: dict[str, Trained], root: str) -> None:
    """Winner of each task as a pipeline, metrics of every candidate as Parquet."""
    for name, result in trained.items():
        if result.best is not None:
            result.model.write().overwrite().save(f"{root}/models/{name}")
    write_metrics(training_summary(trained), f"{root}/metrics")


def load(root: str, task: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{task}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append one run; undefined metrics are null, never NaN."""
    clean = metrics
    for name, kind in metrics.dtypes:
        if kind == "double":
            clean = clean.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    clean.withColumn("trained_at", F.current_timestamp()).coalesce(1).write.mode("append").option(
        "mergeSchema", "true"
    ).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Latest run of every task."""
    log = spark.read.option("mergeSchema", "true").parquet(path)
    latest = log.groupBy("task").agg(F.max("trained_at").alias("trained_at"))
    return log.join(latest, ["task", "trained_at"])


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """Task, chosen model, when and on how many rows it was trained."""
    known = spark.createDataFrame([(t,) for t in TASKS], "task string")
    best = read_metrics(spark, path).where("is_best").select(
        "task", F.col("model").alias("best_model"), "trained_at", "train_rows"
    )
    return known.join(best, "task", "left").withColumn(
        "is_available", F.col("best_model").isNotNull()
    )
