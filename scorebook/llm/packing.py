"""Best-fit packing of tokenised documents, improved by swap-based local search.

Tokenising: the vocabulary never joins characters across white space and its
normaliser works inside a run of visible characters, so a text's ids are those
of its white-space separated words in a row. Words are looked up in a table that
each worker keeps; only unseen ones go through the tokenizer.

Packing: pieces are dealt to groups of bounded size by a hash. A group is packed
best-fit decreasing; then the emptiest sequences give up documents by moves,
one-for-one and two-for-one exchanges into fuller ones. Every step raises the sum
of squared fills, so it ends, and a sequence that loses its last document is gone.
A group leaves about one sequence underfull, one in some thousands.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed like any others; only documents longer than a sequence are cut.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, per_batch, ship

CAPACITY = 4096
END_ID = 1
#: Documents per packing group.
GROUP_ROWS = 6000
#: Entries of a worker's word tables; words met later go through the tokenizer again.
WORD_CACHE = 300_000
CORE_CACHE = 750_000
#: Failed tries in a row after which the local search of a group ends.
PATIENCE = 150
#: Most steps of a group's search.
STEPS = 20_000

#: Letters whose lower case and normal form are single letters, then ASCII signs but no apostrophe.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)$")
#: Longer words than this are not kept.
WORD_BYTES = 64


class WordIds:
    """Token ids of words as little-endian unsigned 32-bit bytes, from one vocabulary file."""

    _kept: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, text: str) -> bytes:
        found = self.cores.get(text)
        if found is None:
            found = self.encode(text)
            if len(self.cores) < CORE_CACHE:
                self.cores[text] = found
        return found

    def _missing(self, word: bytes) -> bytes:
        text = word.decode()
        if match := _SIMPLE.match(text):
            found = self._core(match[1].lower())
            if match[2]:
                found += self._core(match[2])
        else:
            found = self.encode(text)
        if len(self.words) < WORD_CACHE and len(word) <= WORD_BYTES:
            self.words[word] = found
        return found

    def of_text(self, text: bytes) -> bytes:
        if b"<|" in text:  # may hold a special token, which is matched before words are
            return self.encode(text.decode())
        get, missing = self.words.get, self._missing
        return b"".join([get(w) or missing(w) for w in text.split()])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document cut at `capacity` tokens."""
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def run(batch: pa.RecordBatch) -> dict:
        encode = WordIds.of(vocabulary).of_text
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
            ids = encode(text) + end
            for k, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), out))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return per_batch(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing over lengths in descending order; bins of positions."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set while some bin has room r
    for i, length in enumerate(lengths):
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
            room -= length
        else:
            b, room = len(bins), capacity - length
            bins.append([i])
        if room:
            open_by_room[room].append(b)
            mask |= 1 << room
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins until the emptiest ones dissolve."""

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)
        self.size = np.asarray(lengths, np.int64)
        self.where = np.empty(len(lengths), np.int64)  # the bin of each document
        for b, inside in enumerate(bins):
            self.where[inside] = b
        self.alive = len(bins)
        self.least = -(-sum(lengths) // capacity)

    def run(self, patience: int = PATIENCE) -> list[list[int]]:
        failures = 0
        stuck: set[int] = set()
        steps = 0
        while self.alive > self.least and failures < patience and steps < STEPS:
            rooms = np.where(self.room < self.capacity, self.room, -1)
            rooms[list(stuck)] = -1
            victim = int(rooms.argmax())
            if rooms[victim] <= 0:
                break
            if self.improve(victim):
                failures = 0
                steps += 1
                stuck.clear()
            else:
                failures += 1
                stuck.add(victim)
        return [b for b in self.bins if b]

    def improve(self, victim: int) -> bool:
        """One step that lowers `victim`'s fill for a bin that is at least as full."""
        documents = sorted(self.bins[victim], key=lambda i: -self.lengths[i])
        targets = np.flatnonzero((self.room > 0) & (self.room <= self.room[victim]))
        targets = targets[targets != victim]
        if not len(targets):
            return False
        for i in documents:  # move
            fits = targets[self.room[targets] >= self.lengths[i]]
            if len(fits):
                self.shift(victim, [i], int(fits[self.room[fits].argmin()]), [])
                return True
        around = self.room[self.where]
        held = np.flatnonzero((around > 0) & (around <= self.room[victim]) & (self.where != victim))
        owners, sizes, rooms = self.where[held], self.size[held], around[held]
        for i in documents:  # one for one
            gain = self.lengths[i] - sizes
            good = np.flatnonzero((gain > 0) & (gain <= rooms))
            if len(good):
                k = int(good[gain[good].argmax()])
                self.shift(victim, [i], int(owners[k]), [int(held[k])])
                return True
        for a in range(len(documents)):  # two for one
            for b in range(a + 1, len(documents)):
                pair = self.lengths[documents[a]] + self.lengths[documents[b]]
                gain = pair - sizes
                good = np.flatnonzero((gain > 0) & (gain <= rooms))
                if len(good):
                    k = int(good[gain[good].argmax()])
                    self.shift(victim, [documents[a], documents[b]], int(owners[k]), [int(held[k])])
                    return True
        return self.one_for_two(victim, documents, targets)

    def one_for_two(self, victim: int, documents: list[int], targets: np.ndarray) -> bool:
        for i in documents:
            size = self.lengths[i]
            for t in targets[np.argsort(-self.room[targets])][:16]:
                inside = sorted((self.lengths[j], j) for j in self.bins[t])
                values = [v for v, _ in inside]
                for x, (v, j) in enumerate(inside):
                    # The largest partner for which the exchange still gains.
                    y = bisect.bisect_left(values, size - v, x + 1) - 1
                    if y > x and size - v - values[y] <= self.room[t]:
                        self.shift(victim, [i], int(t), [j, inside[y][1]])
                        return True
        return False

    def shift(self, source: int, give: list[int], target: int, take: list[int]) -> None:
        gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        self.bins[source] = [i for i in self.bins[source] if i not in give] + take
        self.bins[target] = [i for i in self.bins[target] if i not in take] + give
        self.where[give], self.where[take] = target, source
        self.room[source] += gain
        self.room[target] -= gain
        if not self.bins[source]:
            self.alive -= 1


def pack(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions; lengths in descending order, each at most `capacity`."""
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence it lies in and its offset there."""
    ship(docs.sparkSession)
    cut_up = cut(pieces(docs, vocabulary, capacity))
    groups = max(1, round(cut_up.count() / GROUP_ROWS))
    dealt = cut_up.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([
            ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"),
        ])
        lengths = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, inside in enumerate(pack(lengths, capacity)):
            at = 0
            for i in inside:
                sequence[i], offset[i] = (group << 32) + k, at
                at += lengths[i]
        return table.drop_columns(["group"]).append_column(
            "sequence_id", pa.array(sequence, pa.int64())
        ).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("group").applyInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
