"""Substring deduplication with fixed-block anchors.

A repeat of WINDOW words contains, in each of its places, one aligned block of
ANCHOR words (ANCHOR + STEP - 1 <= WINDOW). Non-overlapping blocks are the index;
every rolling window of ANCHOR words probes it. A block that some other place
holds is a hit, and the WINDOW-word windows around a hit are what its extension
can reach: they are compared by 64-bit hash, so a hit grows to the maximal run of
words whose windows occur elsewhere, with no pair of places ever written down.

Documents are dealt to bundles of bounded size. A bundle sends, for each range of
hash values, its distinct probes as one sorted, byte-planed array of about three
bytes a probe, with bits for "twice in this bundle" and "is a block here"; back
come only bits for its blocks. A passage in a third of all documents therefore
costs one entry per bundle. The same exchange of documents serves all three
passes.

Defined cases: a null text has no words; documents shorter than WINDOW lose
nothing; repeated rows are repeats of each other; white space inside is not kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, prefix_sums, ship, windows

WINDOW = 35
ANCHOR = 18
STEP = WINDOW - ANCHOR + 1
#: Bytes of text in a bundle and for each hash range, and the least number of both.
BUNDLE_BYTES = 16 << 20
LEAST_BUNDLES = 128
LEAST_RANGES = 256


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Equal parts of the hash space, by the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Bundle:
    """Word hashes of a bundle's documents in one array."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.sums = [
            prefix_sums(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))) for w in self.words
        ]

    def rolling(self) -> tuple[np.ndarray, np.ndarray]:
        """Every rolling anchor window of the bundle, and which of them are blocks."""
        hashes, blocks = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for sums in self.sums:
            h = windows(sums, ANCHOR)
            hashes.append(h)
            blocks.append(np.arange(len(h)) % STEP == 0)
        return np.concatenate(hashes), np.concatenate(blocks)

    def candidates(self, hits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each document the starts of windows whose block is a hit, and their hashes.

        `hits` are the sorted anchor keys of this bundle that occur elsewhere.
        """
        starts, hashes = [], []
        for sums in self.sums:
            whole = windows(sums, WINDOW)
            near = np.empty(0, np.int64)
            if len(whole) and len(hits):
                blocks = windows(sums, ANCHOR)[::STEP]
                hit = hits[np.minimum(np.searchsorted(hits, blocks), len(hits) - 1)] == blocks
                own = -(-np.arange(len(whole)) // STEP)  # the block that the window contains
                near = np.flatnonzero(hit[own])
            starts.append(near)
            hashes.append(whole[near])
        return starts, hashes


def anchor_keys(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range and lower half of an anchor's hash in one integer."""
    return (range_of(hashes, ranges) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def by_range(keys: np.ndarray, where: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of sorted keys that lie in the same range."""
    if not len(keys):
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]])
    return [(int(where[a]), slice(a, b)) for a, b in zip(starts[:-1], starts[1:])]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(keys, return_counts=True)
    return found, counts > 1


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


SENT = "bundle int, part int, n int, keys binary, twice binary, asked binary"
BACK = "bundle int, kind int, part int, n int, found binary"


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bundle", "part", "n", "keys", "twice", "asked"])


def send_anchors(ranges: int):
    def run(docs: pa.Table) -> pa.Table:
        bundle = docs.column("bundle")[0].as_py()
        hashes, blocks = Bundle(bytes_of(docs.column("text"))).rolling()
        keys = anchor_keys(hashes, ranges)
        found, twice = _distinct(keys)
        asked = np.zeros(len(found), bool)
        asked[np.searchsorted(found, keys[blocks])] = True
        where = found >> np.uint64(32)
        low = found.astype(np.uint32)  # the lower half
        return _sent([
            (bundle, part, s.stop - s.start, pack_sorted(low[s]), _bits(twice[s]), _bits(asked[s]))
            for part, s in by_range(found, where)
        ])

    return run


def answer(kind: int, width: type):
    """What a range knows: for each bundle the asked keys that occur in two places."""

    def run(sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        keys = [unpack_sorted(r["keys"], width) for r in rows]
        twice = [_flags(r["twice"], r["n"]) for r in rows]
        asked = [_flags(r["asked"], r["n"]) for r in rows]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        places = np.add.reduceat(1 + np.concatenate(twice)[order].astype(np.int64), starts)
        repeated = np.empty(len(every), bool)
        repeated[order] = np.repeat(places > 1, np.diff(np.concatenate([starts, [len(every)]])))
        out, at = [], 0
        for r, a in zip(rows, asked):
            mine = repeated[at : at + r["n"]][a]
            at += r["n"]
            if mine.any():
                out.append((r["bundle"], kind, r["part"], len(mine), _bits(mine)))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bundle", "kind", "part", "n", "found"])

    return run


def _hit_hashes(bundle: Bundle, back: list[dict], ranges: int) -> np.ndarray:
    """Sorted hashes of the bundle's blocks that occur elsewhere."""
    hashes, blocks = bundle.rolling()
    own = hashes[blocks]
    keys = anchor_keys(own, ranges)
    found = np.unique(keys)
    good = [np.empty(0, np.uint64)]
    parts = {r["part"]: r for r in back if r["kind"] == 1}
    for part, s in by_range(found, found >> np.uint64(32)):
        if part in parts:
            good.append(found[s][_flags(parts[part]["found"], parts[part]["n"])])
    return np.unique(own[np.isin(keys, np.concatenate(good))])


def send_windows(ranges: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows or not back.num_rows:
            return _sent([])
        number = docs.column("bundle")[0].as_py()
        bundle = Bundle(bytes_of(docs.column("text")))
        _, hashes = bundle.candidates(_hit_hashes(bundle, back.to_pylist(), ranges))
        found, twice = _distinct(np.concatenate(hashes))
        return _sent([
            (number, part, s.stop - s.start, pack_sorted(found[s]), _bits(twice[s]), _bits(np.ones(s.stop - s.start, bool)))
            for part, s in by_range(found, range_of(found, ranges))
        ])

    return run


def remove(ranges: int, with_text: bool):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").to_pylist() if docs.num_rows else []
        bundle = Bundle(bytes_of(docs.column("text")) if docs.num_rows else [])
        answers = back.to_pylist()
        starts, hashes = bundle.candidates(_hit_hashes(bundle, answers, ranges) if answers else np.empty(0, np.uint64))
        found = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        parts = {r["part"]: r for r in answers if r["kind"] == 2}
        repeated = [np.empty(0, np.uint64)]
        for part, s in by_range(found, range_of(found, ranges)):
            if part in parts:
                repeated.append(found[s][_flags(parts[part]["found"], parts[part]["n"])])
        repeated = np.concatenate(repeated)
        out: tuple[list, ...] = ([], [], [], [])
        texts = []
        for words, at, h in zip(bundle.words, starts, hashes):
            kept = words
            if len(at) and len(repeated):
                place = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
                at = at[repeated[place] == h]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = [w for w, c in zip(words, covered.tolist()) if not c]
            joined = b" ".join(kept)
            out[1].append(len(words))
            out[2].append(len(words) - len(kept))
            out[3].append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode())
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(out[1], pa.int64()),
            "n_removed": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array(texts, pa.string())
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every document."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = max(LEAST_BUNDLES, total // BUNDLE_BYTES)
    ranges = max(LEAST_RANGES, total // BUNDLE_BYTES)
    dealt = rows.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles)).cast("int"))
    anchors = dealt.groupBy("bundle").applyInArrow(send_anchors(ranges), SENT)
    hits = anchors.groupBy("part").applyInArrow(answer(1, np.uint32), BACK)
    grown = dealt.groupBy("bundle").cogroup(hits.groupBy("bundle")).applyInArrow(send_windows(ranges), SENT)
    repeated = grown.groupBy("part").applyInArrow(answer(2, np.uint64), BACK)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("bundle").cogroup(hits.union(repeated).groupBy("bundle")).applyInArrow(
        remove(ranges, with_text), schema
    )
