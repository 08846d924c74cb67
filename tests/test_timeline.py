"""Running and rolling state against brute force, with chunks small enough to cross."""

import datetime
import random

from pyspark.sql import functions as F

from scorebook.functions import timeline
from scorebook.functions.timeline import Running, in_order, rolling_before, running


def _rows():
    rng = random.Random(7)
    rows = []
    for i in range(300):
        entity = "hot" if rng.random() < 0.6 else rng.choice(["x", "y"])
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randint(0, 12))
        rows.append((i, entity, day, rng.choice([None, 0, 1, 5])))
    return rows


def test_running_is_strictly_before(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "match_id long, entity string, match_date date, value int")
    got = {
        r.match_id: (r.total, r.best, r.everything)
        for r in running(
            df,
            [
                Running(
                    ["entity"], {"total": F.coalesce("value", F.lit(0))}, {"best": F.col("value")}
                ),
                Running([], {"everything": F.lit(1)}),
            ],
        ).collect()
    }
    for match_id, entity, day, _ in rows:
        earlier = [r for r in rows if (r[2], r[0]) < (day, match_id)]
        own = [r[3] for r in earlier if r[1] == entity and r[3] is not None]
        assert got[match_id] == (sum(own), max(own, default=None), len(earlier))


def test_rows_that_are_no_entries_never_gather_in_one_window(spark):
    """20,000 rows of which 15,000 share one position: windows stay below chunk plus frame."""
    df = spark.range(20_000).select(
        F.col("id").alias("match_id"), F.lit("hot").alias("entity"),
        F.least("id", F.lit(5000)).alias("place"),
        F.when(F.col("id") < 5000, F.col("id") % 7).alias("value"),
    )
    rolled = rolling_before(df, ["entity"], "place", {"last": (F.col("value"), 10)}, chunk_rows=512)
    windows = rolled._jdf.queryExecution().executedPlan().toString()
    assert windows.index("Window") < windows.index("HashAggregate")  # rows are reduced by position first
    assert rolled.count() == 20_000
    last = rolled.where("match_id >= 5000").select("last_sum", "last_n").distinct().collect()
    assert [tuple(r) for r in last] == [(sum(i % 7 for i in range(4990, 5000)), 10)]
    steps = df.groupBy("entity", "place").count()
    assert steps.count() == 5001  # what the windows see


def test_rolling_counts_entries_across_chunks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "match_id long, entity string, match_date date, value int")
    placed = running(
        df, [Running(["entity"], {"place": F.when(F.col("value").isNotNull(), 1).otherwise(0)})]
    )
    rolled = rolling_before(
        placed, ["entity"], "place", {"last": (F.col("value"), 4)}, chunk_rows=7
    ).collect()
    assert len(rolled) == len(rows)
    got = {r.match_id: (r.last_sum, r.last_n) for r in rolled}
    for match_id, entity, day, _ in rows:
        own = [
            r[3] for r in sorted(rows, key=lambda r: (r[2], r[0]))
            if r[1] == entity and r[3] is not None and (r[2], r[0]) < (day, match_id)
        ][-4:]
        assert got[match_id] == (sum(own) if own else None, len(own))


def test_split_group_equals_one_window(spark):
    df = spark.range(200).selectExpr("1 as g", "cast(id + 1 as int) as n", "id % 5 as v")
    one = in_order(df, ["g"], "n", {"s": F.col("v")})
    split = in_order(df, ["g"], "n", {"s": F.col("v")}, split_rows=16)
    assert sorted(map(tuple, one.collect())) == sorted(
        map(tuple, split.select(*one.columns).collect())
    )


def test_shared_rows_are_read_by_column_from_parquet(spark):
    rows = spark.range(100).selectExpr("id", "id % 7 as part", "cast(null as string) as name", "array(id, id % 7) as ids")
    kept = timeline.shared(rows)
    assert len(kept.inputFiles()) > 0 and kept.dtypes == rows.dtypes
    assert sorted(kept.select("id", "part", "ids").collect()) == sorted(rows.select("id", "part", "ids").collect())
    assert timeline.shared(rows.where("id < 0")).count() == 0


def test_shared_keeps_what_parquet_cannot_store(spark):
    odd = spark.range(3).selectExpr("id", "id + 1 as ID", "null as nothing")
    kept = timeline.shared(odd)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in odd.collect()]
