"""Near copies for the corpus: five-word shingles, Jaccard similarity of 0.8 or more.

Candidates meet in buckets: BANDS keys of ROWS minima each. A pair of similarity 0.8
shares one with probability 0.9999, a closer one more surely. In a bucket the SimHash
fingerprints are compared bit-sliced within RADIUS, and what is near is confirmed by the
exact similarity of the sets of shingles, kept as sorted 32-bit hashes. (Two different
shingles of a pair of 20,000 words have one hash with a chance of one in twenty.)

The sets move only for documents that share a bucket, and few times:

1. each document goes to one group, that of the smallest document it shares a bucket with,
   then, where a bucket still has documents that are not joined, to that of the greatest;
2. buckets whose documents are still not all joined are compared as they are; of buckets
   with the same documents one is enough.

Large groups are cut into tiles by rows and by shingles, compared two by two in separate
tasks. A tile returns a spanning forest of its confirmed links, at most one row for each
document, and compares no documents that are joined already.

Defined cases: texts are compared in lower case, split at white space; fewer than
five words are one shingle; empty and null texts are copies of each other; a null id
is kept only where all are null; of rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, drop_rows, mix, per_batch, row_key, scratch, ship
from .simhash import forest, majority_bits, near_pairs, shingle_hashes, star

SHINGLE = 5
SIMILAR_PERCENT = 80
#: Of pairs just above the similarity at most one in 5,000 differs in more bits (README).
RADIUS = 20
BANDS, ROWS = 32, 6
#: Shingles whose minima are taken at once.
AT_ONCE = 4096
#: Most documents and shingles of a chunk; a tile compares two chunks.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Words of a tile's table of shared shingles, and pairs confirmed between two looks at what is joined.
TABLE_WORDS, PAIRS = 1 << 23, 4096

_RANDOM = np.random.default_rng(5)
_FLIPS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLACES = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).reshape(BANDS, ROWS)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a set of shingle hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), AT_ONCE):
        part = (short[at : at + AT_ONCE] ^ _FLIPS[:, None]) * _FACTORS[:, None]
        least = np.minimum(least, part.min(axis=1))
    sums = (least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * _PLACES
    return mix(sums.sum(axis=1, dtype=np.uint64))


def marks(docs: DataFrame) -> DataFrame:
    """node (a hash of the text), fp, size (shingles), keys of every text."""

    def run(batch: pa.RecordBatch) -> dict:
        fps, sizes, keys = [], [], []
        for text in bytes_of(batch.column(1)):
            hashes = np.unique(shingle_hashes(text, SHINGLE))
            fps.append(majority_bits(hashes))
            sizes.append(len(hashes))
            keys.append(band_keys(hashes))
        return {
            "node": batch.column(0), "fp": np.array(fps, np.uint64).view(np.int64), "size": sizes,
            "keys": pa.ListArray.from_arrays(
                np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32), np.concatenate(keys).view(np.int64)
            ),
        }

    rows = docs.select(F.xxhash64(docs["text"]).alias("node"), docs["text"].alias("text"))
    return per_batch(rows, run, "node long, fp long, size long, keys array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted 32-bit hashes, packed) of the given nodes."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [
            np.unique(shingle_hashes(text, SHINGLE).astype(np.uint32)).tobytes() for text in bytes_of(batch.column(1))]
        return {"node": batch.column(0), "shingles": found}

    rows = docs.select(F.xxhash64(docs["text"]).alias("node"), docs["text"].alias("text"))
    wanted = rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return per_batch(wanted, run, "node long, shingles binary")


def similar(both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many shingles in common are similar."""
    return 100 * both >= SIMILAR_PERCENT * (left + right - both)


class SharedShingles:
    """Sizes of intersections inside one tile."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self._sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        _, place, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts > 1
        columns = int(shared.sum())
        words = -(-columns // 64)
        self._table = None
        if len(sets) * words <= TABLE_WORDS:
            # A bit for each shingle that two sets share.
            self._table = np.zeros((len(sets), max(1, words)), np.uint64)
            number = np.cumsum(shared) - 1
            row = np.repeat(np.arange(len(sets)), self.sizes)
            used = shared[place]
            row, column = row[used], number[place[used]]
            np.bitwise_or.at(self._table, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self._table is None:
            return np.array([
                len(np.intersect1d(self._sets[a], self._sets[b], assume_unique=True)) for a, b in zip(left, right)
            ], np.int64)
        step = max(1, TABLE_WORDS // self._table.shape[1])
        return np.concatenate([
            np.bitwise_count(self._table[left[k : k + step]] & self._table[right[k : k + step]]).sum(axis=1, dtype=np.int64)
            for k in range(0, len(left), step)])


def tile_links(
    fps: np.ndarray, side: np.ndarray, nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """u, v: a spanning forest of what the tile joins beyond the given roots; u > v."""
    first = np.unique(roots, return_index=True, return_inverse=True)
    start = first[1][first[2]]
    label = start.copy()
    if (label != label[0]).any():
        shingles = SharedShingles(sets)
        sizes = shingles.sizes
        for left, right in near_pairs(fps, np.zeros(len(fps), np.int64), side, RADIUS):
            # A tile that is compared with itself gives each pair twice.
            able = ((side[left] != 2) | (left < right)) & similar(
                np.minimum(sizes[left], sizes[right]), sizes[left], sizes[right])
            left, right = left[able], right[able]
            while len(left):
                apart = label[left] != label[right]
                left, right = left[apart], right[apart]
                now, later = slice(0, PAIRS), slice(PAIRS, None)
                if len(left):
                    a, b = left[now], right[now]
                    good = similar(shingles.common(a, b), sizes[a], sizes[b])
                    if good.any():
                        every = np.arange(len(fps))
                        label = forest(
                            len(fps), np.concatenate([every, a[good]]), np.concatenate([label, b[good]]))
                left, right = left[later], right[later]
    moved = np.unique(start[label != start])
    u, v = nodes[moved], nodes[label[moved]]
    return np.maximum(u, v), np.minimum(u, v)


TILE_COLUMNS = ["key", "a", "b", "side", "node", "root", "fp", "shingles"]


def whole_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, a, b) of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
        for low, high in zip(starts, starts[1:]):
            key = tuple(at[low])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: confirmed links between members (key, node, fp, size, root) of one key; u > v."""
    ship(members.sparkSession)
    counts = cut(members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low < high").select(
        "key", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int").alias("chunks")))
    met = members.join(counts, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("chunk", "other").cast("long").alias("a"), F.greatest("chunk", "other").cast("long").alias("b"),
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0)
        .otherwise(1).cast("long").alias("side"), "node", "root", "fp",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tiles(batches):
            side, node, root, fp = (rows.column(k).to_numpy() for k in range(3, 7))
            sets = [np.frombuffer(s, np.uint32) for s in rows.column(7).to_pylist()]
            u, v = tile_links(fp.view(np.uint64), side, node, root, sets)
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    laid = dealt.join(sets, "node").select(*TILE_COLUMNS).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return laid.mapInArrow(run, "u long, v long").distinct()


def unjoined(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets with more than one root, of those with the same nodes only one."""
    rooted = buckets.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return rooted.join(kept.select("key"), "key", "left_semi")


def one_group(buckets: DataFrame, choose: Callable[[str], Column]) -> DataFrame:
    """Each node in one group: the chosen one of the chosen nodes of its buckets."""
    chosen = buckets.groupBy("key").agg(choose("node").alias("pivot"))
    return buckets.join(chosen, "key").groupBy("node").agg(
        choose("pivot").alias("key"), *(F.first(c).alias(c) for c in ("fp", "size", "root")))


def unsettled(edges: DataFrame) -> bool:
    """Whether some node has two links upwards, or one upwards and one downwards."""
    up, down = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("node"), up.alias("up"), down.alias("down")).union(
        edges.select(F.col("v").alias("node"), down.alias("up"), up.alias("down")))
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).limit(1).count() > 0


def rooted(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node with a link; written edges are u > v, each once.

    Where no node is unsettled, every link leads from a member to the least node of its group:
    the shape ends the rounds, not a round that changes nothing.
    """
    while unsettled(edges):
        edges = cut(star(cut(star(edges, large=True)), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_roots(docs: DataFrame) -> DataFrame:
    """node, root of every text with a near copy; the root is the least node of its group."""
    nodes = cut(marks(docs).dropDuplicates(["node"]))
    spread = nodes.select("node", "fp", "size", F.explode("keys").alias("key"))
    shared = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    buckets = cut(spread.join(shared, "key").withColumn("root", F.col("node")))
    sets = cut(shingle_sets(docs, buckets.select("node").distinct()))
    roots = None
    for choose in (F.min, F.max, None):
        if roots is not None:
            buckets = cut(unjoined(buckets, roots))
        members = buckets if choose is None else cut(one_group(buckets, choose))
        more = links(members, sets)
        if roots is not None:
            # What earlier rounds joined comes in as finished stars.
            more = more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))).distinct()
        roots = rooted(cut(more))
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """The corpus with the smallest-id document of each group of near copies; columns unchanged."""
    with scratch(docs.sparkSession):
        roots = near_roots(docs)
        keyed = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_key(docs)))
        found = keyed.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn(
            "root", F.coalesce("root", "text_key"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
        several = found.groupBy("root").agg(
            F.min_by(F.struct("id_key", "text_key"), order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        losers = found.join(several, "root").where(
            (F.col("id_key") != F.col("best.id_key")) | (F.col("text_key") != F.col("best.text_key"))
        ).select("id_key", "text_key").distinct()
        losers = cut(losers, kept=True)
        repeated = cut(
            keyed.groupBy("id_key", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), kept=True)
    return drop_rows(docs, losers, repeated)
