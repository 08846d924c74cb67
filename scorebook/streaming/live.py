"""Incremental loads and a live scoreboard.

The batch operators do the work: a stream only decides which rows are new.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorebook.functions.rates import count_where
from scorebook.operators import maintain
from scorebook.session import list_folders, remove_folder

INNINGS = ["match_id", "innings_no"]
EVENT_KEY = ["match_id", "innings_no", "ball_seq"]


def incremental_load(
    arrivals: DataFrame,
    read_target: Callable[[int], DataFrame],
    write_target: Callable[[DataFrame, int], None],
    checkpoint: str,
    key: str = "match_key",
    order: str = "match_id",
) -> StreamingQuery:
    """Upsert every micro-batch of contest rows into the stored table.

    ``read_target`` opens the newest version below a batch id and ``write_target``
    publishes that batch's version, so a batch that is replayed after a failure
    starts from the same table again. Stored and completed contests are skipped.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        target = read_target(batch_id)
        once = maintain.last_delivery(batch, key, ["is_completed", order])
        fresh = maintain.filter_incremental(once, target, key)
        table, _ = maintain.upsert_contests(target, fresh, key, [order])
        write_target(table, batch_id)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deduplicated(events: DataFrame, event_time: str, late: str = "1 day") -> DataFrame:
    """Events delivered once. A key is remembered until the watermark, ``late`` behind
    the newest event time, has passed it; what comes later than that is dropped."""
    return events.withWatermark(event_time, late).dropDuplicatesWithinWatermark(EVENT_KEY)


def scoreboard(events: DataFrame, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Running totals per innings. Sums commute, so balls may arrive in any order;
    the state is one row per innings. With an event time, balls that are delivered
    again count once."""
    once = events if event_time is None else deduplicated(events, event_time, late)
    return once.groupBy(*INNINGS).agg(
        F.sum("total_runs").alias("runs"),
        count_where(F.col("is_wicket")).alias("wickets"),
        count_where(F.col("is_legal")).alias("balls"),
        F.sum("extra_runs").alias("extras"),
    )


# Published batches -------------------------------------------------------------
#
# Below the published path: a folder of changed rows for each batch (delta), now and
# then one of all newest rows (snapshot), and a pointer for each batch that names the
# folders to read. The pointer is written last.

POINTERS = "_pointers"
#: Folders that a pointer names before they are folded into a snapshot.
MOST_FOLDERS = 16


def _number(folder: str) -> int:
    """Batch id of a folder ``kind=<batch id>-<attempt>``."""
    return int(folder.rstrip("/").rsplit("=", 1)[1].split("-", 1)[0])


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Finished pointers, oldest first; of one batch the attempts follow each other."""
    found = sorted(list_folders(spark, f"{path}/{POINTERS}"), key=lambda f: (_number(f), f))
    return [f for f in found if _is_finished(spark, f)]


def _is_finished(spark: SparkSession, folder: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _folders(spark: SparkSession, pointer: str) -> list[str]:
    return [r["path"] for r in spark.read.schema("path string").parquet(pointer).collect()]


def published_folders(spark: SparkSession, path: str, below: int | None = None) -> list[str]:
    """The folders that hold the newest rows (before a batch id); at most MOST_FOLDERS."""
    pointers = [p for p in _pointers(spark, path) if below is None or _number(p) < below]
    return _folders(spark, pointers[-1]) if pointers else []


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last batch of every key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


def add_batch(
    batch: DataFrame, path: str, batch_id: int, keys: Sequence[str] = INNINGS, most_folders: int = MOST_FOLDERS
) -> None:
    """Publish the changed rows of one batch; running it again gives the same newest rows.

    Beyond ``most_folders`` all is folded into a snapshot. Folders that neither this
    pointer nor the one before it names are removed, so a reader that has just opened
    the older pointer still finds its files.
    """
    spark = batch.sparkSession
    folders = published_folders(spark, path, below=batch_id)
    delta = f"{path}/delta={batch_id}-{uuid.uuid4().hex}"
    batch.withColumn("batch", F.lit(batch_id).cast("long")).write.parquet(delta)
    folders = [*folders, delta]
    if len(folders) > most_folders:
        snapshot = f"{path}/snapshot={batch_id}-{uuid.uuid4().hex}"
        newest(spark.read.parquet(*folders), keys).write.parquet(snapshot)
        folders = [snapshot]
    rows = spark.createDataFrame([(f,) for f in folders], "path string")
    rows.coalesce(1).write.parquet(f"{path}/{POINTERS}/at={batch_id}-{uuid.uuid4().hex}")
    _sweep(spark, path)


def _sweep(spark: SparkSession, path: str) -> None:
    kept = _pointers(spark, path)[-2:]
    named = {f.rstrip("/").rsplit("/", 1)[1] for p in kept for f in _folders(spark, p)}
    last = _number(kept[-1])
    for folder in list_folders(spark, path):
        name = folder.rstrip("/").rsplit("/", 1)[1]
        if name.startswith(("delta=", "snapshot=")) and name not in named and _number(folder) <= last:
            remove_folder(spark, folder)
    for pointer in list_folders(spark, f"{path}/{POINTERS}"):
        if pointer not in kept and _number(pointer) <= last:
            remove_folder(spark, pointer)


def publish(
    totals: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = True,
    keys: Sequence[str] = INNINGS, most_folders: int = MOST_FOLDERS,
) -> StreamingQuery:
    """Publish the changed rows of every batch below ``path``; see :func:`latest`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, path, batch_id, keys, most_folders)

    writer = totals.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str] = INNINGS) -> DataFrame:
    """The newest published row of every key."""
    folders = published_folders(spark, path)
    if not folders:
        raise ValueError(f"nothing is published below {path}")
    return newest(spark.read.parquet(*folders), keys).drop("batch")
