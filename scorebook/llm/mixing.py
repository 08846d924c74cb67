"""Mixing sources to target weights by highest quotients.

Words are dealt in blocks of equal size. Sainte-Laguë gives every source whole
blocks, then the same rule deals a source's blocks to its shards (a shard is a
bounded number of documents, so no group grows with the corpus). In a shard the
documents lie in seeded order and the blocks of one pass over them are chosen by
a seeded permutation; a second pass starts only when the first is used up.

Source tables have a row per source and shard tables a row per thousand
documents; only these pass through single groups.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a corpus without words takes nothing; repeated rows count like any
other rows and get the same share of words.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keep_rows, row_key, ship

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words, and at most CAP times a source's own.
SHARE = 1.5
CAP = 2
#: Documents in a shard, and the longest block in words.
SHARD_ROWS = 1000
BLOCK_WORDS = 64
#: A block is never more than this part of all words, so small corpora stay exact.
BLOCK_PART = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def highest_quotients(values: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: seat after seat to the largest value / (2 * won + 1), none above `most`.

    Starts from rounded shares, which differ from the result by few seats, and
    adds or takes back seats by quotient. Ties go to the earlier entry.
    """
    seats = max(0, min(seats, sum(most)))
    total = sum(values)
    won = [
        min(m, math.floor(v / total * seats + 0.5)) if total > 0 else 0 for v, m in zip(values, most)
    ]
    spare = seats - sum(won)
    if spare > 0:
        heap = [(-v / (2 * w + 1), i) for i, (v, w) in enumerate(zip(values, won)) if w < most[i]]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heapq.heappop(heap)
            won[i] += 1
            if won[i] < most[i]:
                heapq.heappush(heap, (-values[i] / (2 * won[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * w - 1), -i) for i, (v, w) in enumerate(zip(values, won)) if w]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            won[-i] -= 1
            if won[-i]:
                heapq.heappush(heap, (values[-i] / (2 * won[-i] - 1), i))
    return won


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """source, source_size, rows -> the same with target: water filling under the cap.

    Capped sources come first when ordered by cap over weight; the first source
    that its share does not fill sets the level for all after it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        SHARE * F.sum("source_size").over(everything)
        - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = weighed.withColumn("level", level).withColumn(
        "capped", F.col("level") * F.col("weight") >= CAP * F.col("source_size")
    )
    first_open = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "level")))
    return levelled.withColumn("open_level", first_open.over(everything)["level"]).select(
        "source", "source_size", "rows", "place",
        F.when(F.col("capped"), CAP * F.col("source_size").cast("double"))
        .otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def _source_quotas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["place"])
    total = sum(r["source_size"] for r in rows)
    block = max(1, min(BLOCK_WORDS, total // BLOCK_PART))
    values = [r["target"] / block for r in rows]
    most = [math.ceil(CAP * r["source_size"] / block) for r in rows]
    quotas = highest_quotients(values, round(sum(values)), most)
    yield pa.RecordBatch.from_pydict({
        "place": pa.array([r["place"] for r in rows], pa.int32()),
        "block": pa.array([block] * len(rows), pa.int64()),
        "quota": pa.array(quotas, pa.int64()),
    })


def _shard_quotas(shards: pa.Table) -> pa.Table:
    rows = sorted(shards.to_pylist(), key=lambda r: r["shard"])
    block, quota = rows[0]["block"], rows[0]["quota"]
    sizes = [r["shard_size"] for r in rows]
    most = [CAP * math.ceil(s / block) for s in sizes]
    won = highest_quotients(sizes, quota, most)
    return pa.table({
        "place": pa.array([r["place"] for r in rows], pa.int32()),
        "shard": pa.array([r["shard"] for r in rows], pa.int64()),
        "shard_quota": pa.array(won, pa.int64()),
    })


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, id_key, text_key for each row.

    `taken` counts the words of selected blocks that lie in the document;
    `copies` is how often the whole document goes into the mix: once for each
    pass in which the block of its first word is selected.
    """
    ship(docs.sparkSession)
    sized = cut(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).alias("size"), *row_key(docs),
    ))
    sources = cut(source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ))
    quotas = sources.select("place", "source_size", "target").repartition(1).mapInArrow(
        _source_quotas, "place int, block long, quota long"
    )
    sources = cut(sources.join(quotas, "place")).withColumn("name", F.coalesce("source", F.lit("")))
    order_key = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    # The name alone is a plain equality; a null source is told apart by the flag.
    placed = (
        sized.withColumn("name", F.coalesce("source", F.lit("")))
        .withColumn("no_source", F.col("source").isNull())
        .join(
            sources.withColumn("no_source", F.col("source").isNull()).drop("source"),
            ["name", "no_source"],
        )
        .withColumn("order_key", order_key)
        .withColumn("shard", F.pmod(F.xxhash64("order_key"), F.ceil(F.col("rows") / SHARD_ROWS).cast("long")))
    )
    shards = placed.groupBy("place", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("quota").alias("quota")
    )
    dealt = shards.groupBy("place").applyInArrow(_shard_quotas, "place int, shard long, shard_quota long")
    in_shard = Window.partitionBy("place", "shard")
    laid = placed.join(dealt, ["place", "shard"]).select(
        "*",
        (
            F.sum("size").over(in_shard.orderBy("order_key", "doc_id", "text_key").rowsBetween(
                Window.unboundedPreceding, 0)) - F.col("size")
        ).alias("start"),
        F.ceil(F.sum("size").over(in_shard) / F.col("block")).cast("long").alias("blocks"),
    )
    return laid.select(
        "doc_id", "size", "source_size", "target",
        _words_taken(0).alias("first_pass"), _words_taken(1).alias("second_pass"),
        (_chosen(_first_block(), 0).cast("int") + _chosen(_first_block(), 1).cast("int")).alias("copies"),
        "id_key", "text_key",
    ).select(
        "doc_id", "size", "source_size", "target",
        (F.col("first_pass") + F.col("second_pass")).alias("taken"), "copies", "id_key", "text_key",
    )


#: Multipliers of the block permutation, all prime and above any number of blocks in a shard's pass.
_PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)


def _rank(block: Column) -> Column:
    """Seeded place of a block in its shard's pass: b * prime + offset modulo the blocks."""
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    offset = F.pmod(F.xxhash64("place", "shard"), blocks)
    prime = F.element_at(F.array(*map(F.lit, _PRIMES)), (F.pmod(F.xxhash64("shard", "place"), F.lit(len(_PRIMES))) + 1).cast("int"))
    return F.pmod(F.pmod(prime.cast("long"), blocks) * block + offset, blocks)


def _chosen(block: Column, turn: int) -> Column:
    return _rank(block) < F.col("shard_quota") - turn * F.col("blocks")


def _first_block() -> Column:
    return F.floor(F.col("start") / F.col("block")).cast("long")


def _words_taken(turn: int) -> Column:
    """Words of this document in the blocks chosen in pass `turn`."""
    end = F.col("start") + F.col("size")
    last = F.floor((end - 1) / F.col("block")).cast("long")
    inside = lambda b: (
        F.least(end, (b + 1) * F.col("block")) - F.greatest(F.col("start"), b * F.col("block"))
    )
    some = F.aggregate(
        F.sequence(_first_block(), F.greatest(last, _first_block())), F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(_chosen(b, turn), F.greatest(inside(b), F.lit(0))).otherwise(0).cast("long"),
    )
    quota = F.col("shard_quota") - turn * F.col("blocks")
    return (
        F.when((quota <= 0) | (F.col("size") == 0), F.lit(0).cast("long"))
        .when(quota >= F.col("blocks"), F.col("size")).otherwise(some)
    )


def mixed_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as its `copies` say; columns unchanged."""
    from .common import free_name

    columns = docs.columns
    a, b, n = (free_name(docs, x) for x in ("id_key", "text_key", "copies"))
    chosen = mix(docs, seed).where("copies > 0").groupBy("id_key", "text_key").agg(F.max("copies").alias("copies"))
    keyed = docs.withColumns(dict(zip((a, b), row_key(docs))))
    joined = keyed.join(chosen.select(F.col("id_key").alias(a), F.col("text_key").alias(b), F.col("copies").alias(n)), [a, b])
    turns = F.explode(F.sequence(F.lit(1), F.col(n)))
    return joined.select(*columns, turns.alias(a)).select(*columns)
