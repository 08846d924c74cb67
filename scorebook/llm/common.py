"""Helpers shared by the operators: tables, Arrow batches, row keys, bounded fits."""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the rolling hashes; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(frame: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, whatever else the frame holds."""
    return frame.select(*(frame[old].alias(new) for new, old in columns.items()))


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet."""
    taken = {c.lower() for c in frame.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a session in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured or current:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured or current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it on PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    found = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(root) in found or app in _SHIPPED:
        return
    name = f"{tempfile.mkdtemp(prefix='llm-package-')}/scorebook"
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "scorebook"))
    _SHIPPED.add(app)


def cut(frame: DataFrame, kept: bool = False) -> DataFrame:
    """The frame written to the shared checkpoint folder and read again.

    It survives lost executors, is computed once, and carries no partitioning
    that would keep Spark from splitting a skewed join after it. Inside
    :func:`scratch` the folder is removed at the end, unless it is `kept`.
    """
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if _SCRATCH and not kept:
        _SCRATCH[-1].append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that :func:`cut` writes inside are removed at the end; results must be `kept`."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that an operator wrote and no longer needs, wherever Spark stores it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def id_checksum(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text without decoding it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def per_batch(
    frame: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str
) -> DataFrame:
    """One output batch for each Arrow batch; `function` returns columns by name."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(frame.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := function(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return frame.mapInArrow(run, kind)


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """Fit a small model on a sample of bounded size in a single task.

    The caller bounds the sample; only the pickled model comes back to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    ship(sample.sparkSession)
    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([])


def sample_ids(labelled: DataFrame, limit: int) -> DataFrame:
    """At most `limit` labelled rows, chosen by a hash of their id."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; grown on demand and kept."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        _POWERS = tuple(
            np.cumprod(
                np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]), dtype=np.uint64
            )
            for b in (BASE, INVERSE)
        )
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """Sums of word_hash * BASE**i before each word."""
    p, _ = powers(len(words))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p, dtype=np.uint64)])


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from the document's prefix sums."""
    n = len(sums) - 1
    if n < width:
        return np.empty(0, np.uint64)
    _, inverse = powers(n - width + 1)
    return mix((sums[width:] - sums[: n - width + 1]) * inverse)


def row_key(frame: DataFrame) -> list[Column]:
    """Two hashes that tell a document row by its id and text, null ids included."""
    return [F.xxhash64(frame["doc_id"]).alias("id_key"), F.xxhash64(frame["text"]).alias("text_key")]


def keep_rows(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows of `docs` whose (id_key, text_key) is in `survivors`, each key once."""
    columns = docs.columns
    a, b = free_name(docs, "id_key"), free_name(docs, "text_key")
    keyed = docs.withColumns(dict(zip((a, b), row_key(docs))))
    wanted = survivors.select(F.col("id_key").alias(a), F.col("text_key").alias(b))
    return keyed.join(wanted, [a, b], "left_semi").dropDuplicates([a, b]).select(*columns)


def drop_rows(docs: DataFrame, losers: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of `docs` whose (id_key, text_key) is not in `losers`, each key once.

    `repeated` holds the keys that come more than once. Both are written tables, so where
    they are small the documents do not move.
    """
    columns = docs.columns
    a, b = free_name(docs, "id_key"), free_name(docs, "text_key")
    keyed = docs.withColumns(dict(zip((a, b), row_key(docs))))
    gone, again = (f.select(F.col("id_key").alias(a), F.col("text_key").alias(b)) for f in (losers, repeated))
    rest = keyed.join(gone, [a, b], "left_anti")
    return rest.join(again, [a, b], "left_anti").unionByName(
        rest.join(again, [a, b], "left_semi").dropDuplicates([a, b])
    ).select(*columns)
