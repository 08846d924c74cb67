"""Registered streaming jobs, run to completion over the available files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from oracles.queries import register
from scorebook.functions.timeline import shared
from scorebook.operators import maintain
from scorebook.session import ensure_checkpoint_dir
from scorebook.sources import testdata as td
from scorebook.streaming import chase, live


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    schema = td.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@register("z1_incremental_load")
def _z1(spark, sf_dir):
    """Orders arrive as contest rows; what is stored and completed stays as it is."""
    root = _folder(spark)

    def rows(orders):
        return orders.select(
            F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").cast("string").alias("match_key"),
            (F.col("o_orderstatus") != "P").alias("is_completed"), F.lit("stream").alias("origin"),
        )

    stored = rows(td.table(spark, sf_dir, "orders")).where(F.col("match_id") % 2 == 0).withColumn(
        "origin", F.lit("stored")
    )
    maintain.commit_version(stored, root + "/table", -1, None)
    query = live.incremental_load(
        rows(_stream(spark, sf_dir, "orders")),
        lambda batch: maintain.read_current(spark, root + "/table", below=batch),
        lambda table, batch: maintain.commit_version(table, root + "/table", batch, None) and None,
        root + "/checkpoint",
    )
    query.awaitTermination()
    return maintain.read_current(spark, root + "/table")


def _arrivals(spark, sf_dir):
    """A stream of all events, a part a batch. Two parts hold the earlier years and two the
    later ones; the balls of an innings are spread over two parts in any order. Every second
    ball is in its part twice, and every third one comes again with the later years. A part
    has as many files as its rows need, so no task writes or reads a whole one."""
    root = _folder(spark) + "/arrivals"
    balls = shared(td.events(spark, sf_dir).where("match_date IS NOT NULL").withColumn(
        "event_time",
        F.to_timestamp("match_date") + F.make_interval(hours=F.col("innings_no") * 2, secs=F.col("ball_seq") * 30)))
    files, written = 1 + balls.count() // FILE_ROWS, 0
    hashed = F.xxhash64("match_id", "innings_no", "ball_seq")
    later, half, seq = F.year("match_date") >= SPLIT_YEAR, F.pmod(hashed, F.lit(2)), F.col("ball_seq")
    for part in (~later, later):
        for k in (0, 1):
            own = balls.where(part & (half == k))
            sent = own.unionByName(own.where(seq % 2 == 0))
            if part is later:
                sent = sent.unionByName(balls.where(~later & (half == k) & (seq % 3 == 0)))
            # The files of a part, written after those of the part before it.
            sent.repartition(files).sortWithinPartitions(F.xxhash64(hashed)).write.mode("append").parquet(root)
            written += files
            for _ in range(written - len(spark.read.schema(balls.schema).parquet(root).inputFiles())):
                # Tasks without rows leave no file; empty ones keep a part a batch.
                spark.createDataFrame([], balls.schema).write.mode("append").parquet(root)
    return spark.readStream.schema(balls.schema).option("maxFilesPerTrigger", files).parquet(root)


#: Balls of all parts for each file of one.
FILE_ROWS = 1_000_000
#: First year of the later files, and more than the days that a file of either half covers.
SPLIT_YEAR, LATE = 1995, "1500 days"


#: State on the executors' disks. What all stores of an executor hold in memory has one bound.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": chase.STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _state_on_disk(spark):
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    try:
        for name, value in STATE_ON_DISK.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@register("z2_live_scoreboard")
def _z2(spark, sf_dir):
    """Balls that are delivered twice count once, in the batch and between batches. The keys
    of all balls within LATE are state, so they stay on disk."""
    root = _folder(spark)
    balls = _arrivals(spark, sf_dir)
    with _state_on_disk(spark):
        query = live.publish(live.scoreboard(balls, "event_time", LATE), root + "/scores", root + "/checkpoint")
        query.awaitTermination()
    return live.latest(spark, root + "/scores")


@register("z2_live_chase")
def _z2_chase(spark, sf_dir):
    """States of all chases after shuffled and repeated balls; the finished job is started once more."""
    root = _folder(spark)
    balls = _arrivals(spark, sf_dir)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, chase.STORE)
    try:
        for _ in range(2):
            states = chase.chase_states(balls, "event_time", LATE)
            query = live.publish(states, root + "/states", root + "/checkpoint", keys=["match_id"])
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return chase.live_features(live.latest(spark, root + "/states", ["match_id"]), td.contests(spark, sf_dir), None)
