"""Exact duplicates through a persistent digest index.

The index is a table bucketed and sorted by digest. Documents are reduced to one
candidate per digest first (the reduction starts in the map tasks, so a text that
a third of the corpus shares costs one row per task); a sort-merge anti-join
against the index leaves the digests that are new, and those are appended. The
index side of that join is read bucket by bucket and never shuffled.

Defined cases: a null text is the empty text; documents without any visible
character are equal to each other; among repeated rows with one id the group
counts every row and the id stays once; a null id loses every tie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep_rows, row_key

#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
INDEX_COLUMNS = ["digest", "keep_id", "points", "group_size", "id_key", "text_key"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """One short row per document: id, digest of the normalised text, code points."""
    text = docs["text"]
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
        *row_key(docs),
    )


def candidates(digested: DataFrame) -> DataFrame:
    """One row per digest: longest original text, then smallest id."""
    order = F.struct("points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("rank"))
    return digested.groupBy("digest").agg(
        F.max_by(F.struct("doc_id", "points", "id_key", "text_key"), order).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.points").alias("points"),
        "group_size", F.col("best.id_key").alias("id_key"), F.col("best.text_key").alias("text_key"),
    )


class DigestIndex:
    """A named table of digests in the warehouse, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        """`buckets` is for a new table; no fewer than shuffle partitions, or Spark deals the index anew."""
        self.spark, self.name = spark, name
        self.buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def clear(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, rows: DataFrame) -> None:
        (
            rows.select(*INDEX_COLUMNS).repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def fresh(self, found: DataFrame) -> DataFrame:
        """Those candidates whose digest the index does not hold."""
        if not self.exists():
            return found
        return found.hint("merge").join(self.read().select("digest"), "digest", "left_anti")


def deduplicate(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """Every row of `docs` with the id that stays for its text; the index grows by new texts.

    With several `batches` the digests are cut into as many ranges of their hash, and each
    is joined with an index that holds the ones before it. Returns doc_id, keep_id, group_size (rows of this batch), kept, text_sha256,
    id_key, text_key. A row whose text an earlier batch brought is not kept.
    """
    digested = cut(digests(docs))
    groups = cut(candidates(digested))
    parts = []
    for batch in range(batches):
        arriving = groups.where(F.pmod(F.xxhash64("digest"), F.lit(batches)) == batch)
        parts.append(cut(index.fresh(arriving)))
        index.append(parts[-1])
    fresh = reduce(DataFrame.unionByName, parts)
    stored = index.read().select("digest", F.col("keep_id").alias("stored_id"))
    new = fresh.select("digest", F.lit(True).alias("is_new"))
    verdict = groups.hint("merge").join(stored, "digest").join(new, "digest", "left").select(
        "digest", F.col("stored_id").alias("keep_id"), "group_size",
        F.when(F.col("is_new"), F.col("id_key")).alias("best_id"),
        F.when(F.col("is_new"), F.col("text_key")).alias("best_text"),
    )
    # From a written table both sides of this join are shuffled, so Spark can
    # split a digest that many rows share.
    return digested.join(cut(verdict), "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(
            (F.col("id_key") == F.col("best_id")) & (F.col("text_key") == F.col("best_text")), F.lit(False)
        ).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "id_key", "text_key",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The corpus with one row for each text; columns unchanged."""
    return keep_rows(docs, candidates(digests(docs)))
