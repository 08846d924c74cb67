"""Keeping the stored tables up to date.

Tables are Parquet without row updates, so an upsert is "stored rows that are not
re-delivered, plus the delivery". The pure part of each job is table in, table
out; :func:`commit_version` writes a new version folder and then moves the
pointer, so a lost executor or driver leaves the previous version readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scorebook import schemas
from scorebook.functions.rates import count_where


def last_delivery(incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; reduced in the map tasks."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    ).select(key, "__last.*").select(*incoming.columns)


def upsert_contests(
    target: DataFrame, incoming: DataFrame, key: str = "match_key", order: Sequence[str] = ("match_id",)
) -> tuple[DataFrame, DataFrame]:
    """(new table, one-row counts of inserted and updated). Of a key that is delivered
    more than once the last delivery by ``order`` counts."""
    incoming = last_delivery(incoming, key, order)
    kept = target.join(incoming.select(key), key, "left_anti")
    table = kept.unionByName(incoming.select(*target.columns))
    stored = target.select(key, F.lit(True).alias("__stored"))
    counts = incoming.select(key).join(stored, key, "left").agg(
        count_where(F.col("__stored").isNull()).alias("inserted"),
        count_where(F.col("__stored")).alias("updated"),
    )
    return table, counts


def mark_changes(
    target: DataFrame, incoming: DataFrame, mark: str, key: str = "match_key"
) -> tuple[DataFrame, DataFrame]:
    """Both frames with a column ``mark``: null for stored rows, inserted or updated for delivered ones."""
    stored = target.select(key, F.lit(True).alias("__stored"))
    change = F.when(F.col("__stored"), F.lit("updated")).otherwise(F.lit("inserted"))
    marked = incoming.join(stored, key, "left").withColumn(mark, change).drop("__stored")
    return target.withColumn(mark, F.lit(None).cast("string")), marked


class Tally:
    """Counts taken in passing by the jobs that write frames, so that counting reads nothing again.

    A counted frame has to be the end of what one job computes: there a task that runs
    again after a lost executor is counted once.
    """

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}

    def on(self, name: str, frame: DataFrame, **conditions: Column) -> DataFrame:
        """The frame; its next job counts all rows and those that meet each condition."""
        self._observed[name] = Observation()
        counts = [count_where(c).alias(k) for k, c in conditions.items()]
        return frame.observe(self._observed[name], F.count(F.lit(1)).alias("rows"), *counts)

    def count(self, name: str, key: str = "rows") -> int:
        """A count of a frame after its job; zero for a frame that was not counted."""
        return int(self._observed[name].get.get(key) or 0) if name in self._observed else 0


def replace_children(
    child: DataFrame, incoming: DataFrame, redelivered: DataFrame, key: str = "match_id"
) -> DataFrame:
    """Drop every stored child of a re-delivered contest, add the delivered ones.
    A re-delivered contest without children of this kind ends up with none."""
    return child.join(redelivered.select(key), key, "left_anti").unionByName(
        incoming.select(*child.columns)
    )


def resolve_dimension(names: DataFrame, dimension: DataFrame, column: str = "name") -> DataFrame:
    """Dimension extended by the names it lacks; keys continue from the largest.

    New names get consecutive keys without gathering them in one task: names are
    hashed into slots, numbered inside a slot, and each slot starts after the
    slots before it. Only the per-slot counts are ordered as a whole.
    """
    slots = 1024
    fresh = (
        names.select(F.col(column).alias("name"))
        .where(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
        .join(dimension.select("name"), "name", "left_anti")
        .withColumn("slot", F.pmod(F.xxhash64("name"), F.lit(slots)).cast("int"))
    )
    counts = fresh.groupBy("slot").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = counts.select("slot", before.alias("start"))
    top = dimension.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = fresh.join(starts, "slot").select(
        (
            top + F.col("start")
            + F.row_number().over(Window.partitionBy("slot").orderBy("name"))
        ).cast("long").alias("id"),
        "name",
    )
    return dimension.unionByName(numbered, allowMissingColumns=True)


def attach_keys(facts: DataFrame, dimension: DataFrame, column: str, key: str) -> DataFrame:
    """Replace a name by its surrogate key; null and empty names get a null key."""
    ids = dimension.select(F.col("id").alias(key), F.col("name").alias("__name"))
    return facts.join(ids, F.col(column) == F.col("__name"), "left").drop("__name", column)


def enrich_actors(
    dimension: DataFrame, attrs: DataFrame, columns: Sequence[str], order: str
) -> DataFrame:
    """Fill null or empty attributes with the first non-empty delivered value."""

    def filled(column: Column) -> Column:
        return column.isNotNull() & (column.cast("string") != "")

    first = attrs.groupBy("name").agg(
        *[
            F.min_by(c, F.when(filled(F.col(c)), F.col(order))).alias(f"__{c}")
            for c in columns
        ]
    )
    joined = dimension.join(first, "name", "left")
    return joined.withColumns(
        {
            c: F.when(filled(F.col(c)), F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c)))
            for c in columns
        }
    ).select(*dimension.columns)


def filter_incremental(
    incoming: DataFrame, stored: DataFrame, key: str = "match_key"
) -> DataFrame:
    """Contests to process: everything except what is stored and completed."""
    return incoming.join(stored.where("is_completed").select(key), key, "left_anti")


def plan_sources(
    offers: DataFrame, requested: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(season, source) to load and the requested seasons nobody offers.

    ``offers`` has season, source and priority; the lowest priority wins.
    """
    chosen = offers.groupBy("season").agg(
        F.min_by("source", F.struct("priority", "source")).alias("source")
    )
    if requested is None:
        return chosen, chosen.select("season").limit(0)
    return (
        chosen.join(requested.select("season"), "season", "left_semi"),
        requested.select("season").distinct().join(chosen, "season", "left_anti"),
    )


def has_both_sides() -> Column:
    """Whether a delivered contest names both sides; others hold a place in the schedule."""
    return F.col("team1").isNotNull() & F.col("team2").isNotNull()


def drop_placeholders(contests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contests with both sides, one-row count of the skipped ones)."""
    known = has_both_sides()
    return contests.where(known), contests.agg(count_where(~known).alias("skipped"))


def start_run(
    spark: SparkSession, ledger_path: str, run_id: int, trigger: str, sources: str, seasons: str
) -> None:
    """Append a running row; the ledger is an append-only log of states."""
    row = spark.createDataFrame(
        [(run_id, "running", trigger, sources, seasons)],
        "id long, status string, trigger string, sources string, seasons string",
    ).withColumn("started_at", F.current_timestamp())
    _append_run(spark, ledger_path, row)


def finish_run(
    spark: SparkSession, ledger_path: str, run_id: int, status: str, message: str | None = None,
    **counts: int,
) -> None:
    begun = latest_state(spark.read.schema(schemas.TABLES["load_runs"]).parquet(ledger_path)).where(
        F.col("id") == run_id
    )
    row = begun.withColumns(
        {
            "status": F.lit(status),
            "message": F.lit(message).cast("string"),
            "finished_at": F.current_timestamp(),
            "duration_seconds": (
                F.current_timestamp().cast("double") - F.col("started_at").cast("double")
            ),
            **{name: F.lit(value).cast("long") for name, value in counts.items()},
        }
    )
    _append_run(spark, ledger_path, row)


def _append_run(spark: SparkSession, ledger_path: str, row: DataFrame) -> None:
    empty = spark.createDataFrame([], schemas.TABLES["load_runs"])
    full = empty.unionByName(row, allowMissingColumns=True)
    full.coalesce(1).write.mode("append").parquet(ledger_path)


def latest_state(ledger: DataFrame) -> DataFrame:
    """Last state of every run: a finished row replaces the running one."""
    columns = [c for c in ledger.columns if c != "id"]
    return ledger.groupBy("id").agg(
        F.max_by(F.struct(*columns), F.struct(F.col("finished_at").isNotNull(), "finished_at"))
        .alias("run")
    ).select("id", "run.*")


def latest_run(ledger: DataFrame) -> DataFrame:
    """The run with the highest id."""
    state = latest_state(ledger)
    columns = [c for c in state.columns if c != "id"]
    return state.agg(F.max("id").alias("id"), F.max_by(F.struct(*columns), "id").alias("run")).where(
        F.col("id").isNotNull()
    ).select("id", "run.*")


def export_slim(
    tables: dict[str, DataFrame], root: str, drop: Sequence[str] = ("events",)
) -> list[str]:
    """Write every table but the dropped ones; a few files per table, as the point
    of the slim copy is to be carried elsewhere."""
    written = []
    for name, frame in tables.items():
        if name not in drop:
            frame.write.mode("overwrite").parquet(f"{root}/{name}")
            written.append(name)
    return written


def commit_version(df: DataFrame, root: str, version: int, partition_by: str | None = "season") -> str:
    """Write one version of a table and publish it last.

    Every attempt has a folder of its own, so writing a version again never
    touches files that a reader, or the attempt itself, is reading.
    """
    path = f"{root}/version={version}-{uuid.uuid4().hex}"
    if partition_by:
        # Rebalance gives few files per value and splits a value that is hot.
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    else:
        writer = df.write
    writer.mode("overwrite").parquet(path)
    spark = df.sparkSession
    row = spark.createDataFrame([(version, path)], "version long, path string")
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{root}/versions_log"
    )
    return path


def published(spark: SparkSession, root: str) -> DataFrame:
    """One row per version: the path of its last published attempt."""
    log = spark.read.schema("version long, path string, published_at timestamp").parquet(
        f"{root}/versions_log"
    )
    return log.groupBy("version").agg(
        F.max_by("path", F.struct("published_at", "path")).alias("path")
    )


def read_current(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """The last published version, or the last one below a version number; the
    pointer is one small row."""
    versions = published(spark, root)
    if below is not None:
        versions = versions.where(F.col("version") < below)
    path = versions.agg(F.max_by("path", "version").alias("path")).first()["path"]
    if path is None:
        raise ValueError(f"no published version below {root}" if below is None else f"no version before {below}: {root}")
    return spark.read.parquet(path)
