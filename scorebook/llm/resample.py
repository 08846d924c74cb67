"""Importance resampling towards a target: hashed run gains, Gumbel scores, a distributed radix sort.

Every text is cut into words, and every run of 1 to `longest` words falls into one of
`buckets` buckets. The counts of the corpus and of the target give a gain for each
bucket, an array of fixed size that goes to every task; a document's weight is the sum of
the gains of its runs, looked up in that array. A Gumbel number from the document's id
makes the highest scores a draw without replacement. The ranks come from
:func:`radix.radix_sort` by (score descending, id).

Defined cases: a null text has no words; a document without words weighs 0; a null id
draws from the empty text and loses every tie; repeated rows are documents of their own,
which take neighbouring ranks; an empty target makes every gain that of unseen runs; no
documents give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, only, per_batch, ship
from .radix import radix_sort

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Words of the lower-cased text; every byte of a character beyond ASCII belongs to a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text that are cut into words at once.
_SLICE = 1 << 20


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about a megabyte; no word is cut."""
    text = text.lower()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE)
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def run_buckets(text: bytes, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of each slice of the text."""
    tail: list[bytes] = []
    for words in slices(text):
        fresh = len(words)
        words = tail + words
        found = [words[len(tail):]]
        for n in range(2, longest + 1):
            first = max(0, len(tail) - n + 1)
            found.append([b" ".join(words[i : i + n]) for i in range(first, len(words) - n + 1)])
        tail = words[-(longest - 1):] if longest > 1 else []
        sums = [np.fromiter(map(zlib.crc32, part), np.int64, len(part)) for part in found]
        yield fresh, np.concatenate(sums) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Runs in each bucket over all rows of a frame with the one column `text`."""
    ship(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                for _, found in run_buckets(text, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counted = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most `buckets` rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    buckets = len(corpus)
    whole, whole_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * whole / (float(s + 1) * whole_target)))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
            words = features = weight = 0
            for fresh, found in run_buckets(text, buckets, longest):
                words, features, weight = words + fresh, features + len(found), weight + int(gain[found].sum())
            rows.append((doc_id, words, features, weight, weight + gumbel(doc_id, seed)))
        return dict(zip(("doc_id", "n_words", "n_features", "weight", "score"), zip(*rows)))

    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(rows, run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """Every document with its weight, its score and, where it is drawn, its rank from 1.

    `docs` has doc_id and text, `target` has text. Drawn are `percent` of the documents of
    `least_words` words or more, rounded down.
    """
    gain = gains(bucket_counts(only(docs, text="text"), buckets, longest),
                 bucket_counts(only(target, text="text"), buckets, longest))
    rows = cut(scored(docs, gain, longest, seed))
    columns = ["doc_id", "n_features", "weight", "score"]
    # Weight and features only order rows of one score and id, so that reruns agree.
    ranked, n = radix_sort(
        rows.where(F.col("n_words") >= least_words).select(*columns),
        [("score", False), ("doc_id", True), ("weight", True), ("n_features", True)])
    drawn = F.when(F.col("place") < percent * n // 100, F.col("place") + 1)
    short = rows.where(F.col("n_words") < least_words)
    return ranked.select(*columns, drawn.alias("rank")).unionByName(
        short.select(*columns, F.lit(None).cast("long").alias("rank")))
