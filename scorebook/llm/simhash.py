"""Near duplicates by SimHash, compared bit-sliced.

Fingerprints within RADIUS bits share one of four 16-bit blocks, and beside that
block one of four 12-bit parts of the rest. So every distinct fingerprint goes to
16 buckets of 28 known bits, and two that are near meet in at least one of them.
In a bucket the fingerprints are stored as 64 bit planes, 64 fingerprints to a
word. A query updates the distances to 64 others at once: each plane's differing
bits go through carry-save adders into a two-bit counter with a sticky overflow,
and a block of 64 is abandoned when all its lanes have overflowed.

Equal fingerprints are reduced to one before anything is compared. Buckets with
more than TILE fingerprints are cut into tiles that are compared two by two in
separate groups, so a large group of near copies spreads over many tasks. A tile
returns a spanning forest of its links, not the links. Components then come from
alternating large-star and small-star steps, each written to the shared folder.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; fewer than three words count as one shingle; repeated rows share their
fingerprint; a null id is never a component's smallest id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, keep_rows, per_batch, row_key, ship

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Most fingerprints of a bucket that are compared in one group.
TILE = 1024
#: Pairs of a query and a word of 64 lanes worked on at once, and planes between checks.
PAIRS_AT_ONCE = 1 << 17
PLANES_PER_CHECK = 8

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hash of every run of `width` words; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([_hash(b" ".join(words))], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter(map(_hash, shingles), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    """Majority bits of the shingles' hashes; bit k of the result is bit k of the hashes."""
    return majority_bits(shingle_hashes(text, SHINGLE))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long), id_key, text_key of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.fromiter(map(fingerprint, bytes_of(batch.column(1))), np.uint64, batch.num_rows)
        return {
            "doc_id": batch.column(0), "fp": found.view(np.int64),
            "id_key": batch.column(2), "text_key": batch.column(3),
        }

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *row_key(docs))
    return per_batch(rows, run, "doc_id long, fp long, id_key long, text_key long")


def _bits(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bucket_keys(fp: Column) -> Column:
    """The 16 buckets of a fingerprint: block i, part j of the other 48 bits, and their 28 bits."""
    keys = []
    for i in range(4):
        block = _bits(fp, 16 * i, 16)
        # The rest, closed up to 48 bits.
        low = _bits(fp, 0, 16 * i) if i else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            part = _bits(rest, 12 * j, 12)
            value = F.shiftleft(block, 12).bitwiseOR(part)
            keys.append(value.bitwiseOR(F.lit((4 * i + j) << 28).cast("long")))
    return F.array(*keys)


def tiles(distinct: DataFrame) -> DataFrame:
    """key, a, b, fp, side: what is compared with what. side 0 asks, 1 is asked, 2 is both."""
    spread = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    counts = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    met = spread.join(counts, "key").select(
        "key", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return met.select("key", "fp", "chunk", others.alias("other")).select(
        "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "fp",
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0)
        .otherwise(1).cast("int").alias("side"),
    )


def near_pairs(
    fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = RADIUS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, lane) of near fingerprints inside each group, some at a time; rows are sorted by group."""
    asked = np.flatnonzero(side >= 1)
    queries = np.flatnonzero(side != 1)
    if not len(asked) or not len(queries):
        return
    # Lanes: up to 64 rows of one group share a word.
    g = group[asked]
    lane = np.arange(len(g)) - np.searchsorted(g, g, "left")
    starts = np.flatnonzero(lane % 64 == 0)
    bit = (lane % 64).astype(np.uint64)
    valid = np.bitwise_or.reduceat(np.uint64(1) << bit, starts)
    values = fps[asked]
    planes = np.stack([
        np.bitwise_or.reduceat(((values >> np.uint64(p)) & np.uint64(1)) << bit, starts) for p in range(64)
    ])
    word_group = g[starts]
    low = np.searchsorted(word_group, group[queries], "left")
    many = np.searchsorted(word_group, group[queries], "right") - low
    ends = np.cumsum(many)
    at = 0
    while at < len(queries):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        q = np.repeat(queries[at:stop], many[at:stop])
        w = np.repeat(low[at:stop] - (ends[at:stop] - many[at:stop] - done), many[at:stop]) + np.arange(len(q))
        near = _compare(fps[q], w, planes, valid, radius)
        some = np.flatnonzero(near)
        bits = np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        left, right = q[some[row]], asked[starts[w[some[row]]] + column]
        other = left != right
        yield left[other], right[other]
        at = stop


def _compare(query: np.ndarray, word: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query, word) pair the lanes within `radius`, as bits; carry-save counters that overflow beyond it."""
    result = np.zeros(len(query), np.uint64)
    alive = np.arange(len(query))
    width = radius.bit_length()
    # The counters start so high that difference radius + 1 is the one that overflows.
    start = (1 << width) - 1 - radius
    counter = [np.full_like(result, _ALL if start >> k & 1 else 0) for k in range(width)]
    over = ~valid[word]
    for p in range(64):
        flip = np.where((query >> np.uint64(p)) & np.uint64(1), _ALL, np.uint64(0))
        carry = planes[p][word] ^ flip
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % PLANES_PER_CHECK == PLANES_PER_CHECK - 1:
            stay = over != _ALL
            if not stay.all():
                alive, query, word = alive[stay], query[stay], word[stay]
                counter, over = [c[stay] for c in counter], over[stay]
                if not len(alive):
                    return result
    result[alive] = ~over
    return result


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions reaches over the pairs."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        # Hook the roots too, then shorten paths.
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (as longs) of batches that are sorted by their first three columns; no group is split."""
    kept: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        # Everything before the last group of the batch is complete.
        same = np.all(rows[:, :3] == rows[-1, :3], axis=1)
        cut_at = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last is not None and cut_at:
            yield np.concatenate([*kept, rows[:cut_at]])
            kept = [rows[cut_at:]]
        elif cut_at:
            yield rows[:cut_at]
            kept = [rows[cut_at:]]
        elif last is not None and (last != rows[0, :3]).any():
            yield np.concatenate(kept)
            kept = [rows]
        else:
            kept.append(rows)
        last = rows[-1, :3]
    if kept:
        yield np.concatenate(kept)


def group_numbers(rows: np.ndarray) -> np.ndarray:
    change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
    return np.concatenate([[0], np.cumsum(change)])


def links(distinct: DataFrame) -> DataFrame:
    """u, v: for each tile a spanning forest of its links; u > v."""
    ship(distinct.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            label = every = np.arange(len(rows))
            fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            for left, right in near_pairs(fps, group_numbers(rows), rows[:, 4]):
                label = forest(len(rows), np.concatenate([every, left]), np.concatenate([label, right]))
            u, v = rows[:, 3], rows[label, 3]
            moved = u != v
            yield pa.RecordBatch.from_pydict({
                "u": pa.array(np.maximum(u, v)[moved], pa.int64()), "v": pa.array(np.minimum(u, v)[moved], pa.int64()),
            })

    dealt = tiles(distinct).select("key", "a", "b", "fp", "side")
    laid = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return laid.mapInArrow(run, "u long, v long").distinct()


def star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step towards stars: links to the least neighbour, of greater neighbours (large) or smaller ones."""
    if large:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node with a link; edges are u > v."""

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = cut(edges)
    seen = mark(pairs)
    while True:
        pairs = cut(star(cut(star(pairs, large=True)), large=False))
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id, id_key, text_key; root is the cluster's smallest fingerprint."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select("fp")))
    rooted = cut(
        distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The corpus with the smallest-id document of each cluster; columns unchanged."""
    found = clusters(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = found.groupBy("root").agg(F.min_by(F.struct("id_key", "text_key"), order).alias("best"))
    return keep_rows(docs, best.select("best.id_key", "best.text_key"))
