"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every labelled document: each task returns its counts by
language and bucket, Spark adds them and turns each language into one row of log
probabilities; the rows are a matrix of bounded size that is broadcast. A batch of
documents is scored at once: its n-grams are counted into a sparse matrix (document,
bucket, count) that is multiplied with the log probabilities; a long text is counted
slice by slice.

Defined cases: a null text or one without a letter is `und` with score 0; so is
every text when there is nothing to learn from. Beyond MOST_LANGUAGES labels those
with the most n-grams are learned (ties to the label that comes first by code point)
and every document is given the likeliest of them; no label makes the fit fail.
Repeated rows and repeated ids count as often as they come, each is scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_checksum, mix, per_batch, ship, texts_of

#: Buckets of n-grams of 1 to 3 characters, and languages the matrix may hold.
BUCKETS = 1 << 15
MOST_LANGUAGES = 256
SMOOTHING = 0.5
#: Characters and documents counted at once.
SLICE = 400_000
DOCUMENTS = 64
#: Numbers of the product held at once.
CELLS = 1 << 23
#: Log-odds count as if a text had this many n-grams, so that scores stay apart from 1.
EVIDENCE = 40.0
UNKNOWN = "und"
HELD_OUT_OF, HELD_OUT = 4, 2


def grams(text: str, starts: int | None = None) -> np.ndarray:
    """Buckets of the n-grams of 1 to 3 characters that begin at the first `starts` characters; text is lower case."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [codes[:starts]]
    if len(codes) > 1:
        two = (codes[:-1] << np.uint64(21)) | codes[1:]
        found.append(two[:starts] + np.uint64(1 << 43))
        if len(codes) > 2:
            found.append(((two[:-1] << np.uint64(21)) | codes[2:])[:starts])
    return (mix(np.concatenate(found)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def prepared(text: str) -> str:
    """Lower case, a space for each run of white space, digits and punctuation kept."""
    return f" {' '.join(text.lower().split())} "


def labelled(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from."""
    open_to_learn = id_checksum(docs["doc_id"]) % HELD_OUT_OF != HELD_OUT
    return docs.where(open_to_learn & docs["lang"].isNotNull() & docs["text"].isNotNull())


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents that may be learned from."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += np.bincount(grams(prepared(text)), minlength=BUCKETS)
        for lang, total in totals.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(bucket), pa.string()),
                "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[bucket], pa.int64()),
            })

    ship(docs.sparkSession)
    rows = labelled(docs).select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_rows(docs: DataFrame) -> DataFrame:
    """lang, n (its n-grams), logs (log P(bucket | lang), single precision): one group of at most BUCKETS rows a label."""

    def run(group: pa.Table) -> pa.Table:
        total = np.full(BUCKETS, SMOOTHING)
        total[group.column("bucket").to_numpy()] += group.column("n").to_numpy()
        logs = np.log(total / total.sum()).astype("<f4")
        return pa.table({
            "lang": group.column("lang").slice(0, 1), "n": pa.array([int(group.column("n").to_numpy().sum())]),
            "logs": pa.array([logs.tobytes()], pa.binary()),
        })

    return counts(docs).groupBy("lang").applyInArrow(run, "lang string, n long, logs binary")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix log P(bucket | language); documents weigh alike in the prior."""
    found = log_rows(docs).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    found.sort(key=lambda row: row["lang"])
    rows = [np.frombuffer(bytes(row["logs"]), "<f4") for row in found]
    return [row["lang"] for row in found], np.array(rows, np.float32).reshape(len(rows), BUCKETS)


def sparse_counts(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bucket, count) of the n-grams of (place, text), by place and bucket."""
    found = [grams(text, SLICE) for _, text in parts]
    places = np.repeat(np.array([at for at, _ in parts]), [len(f) for f in found])
    dense = np.bincount(places * BUCKETS + np.concatenate(found))
    cells = np.flatnonzero(dense)
    return cells // BUCKETS, cells % BUCKETS, dense[cells]


def slices(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Parts (number of the text, part) of prepared texts, gathered up to SLICE characters and
    DOCUMENTS parts. A part ends with two characters of the next, so that each n-gram of the
    text begins at the first SLICE characters of one part."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE + 2]
            if held and (size + len(part) > SLICE or len(held) == DOCUMENTS):
                yield held
                held, size = [], 0
            held.append((k, part))
            size += len(part)
    if held:
        yield held


def predict(names: list[str], matrix: np.ndarray, texts: list[str]) -> tuple[list[str], list[float]]:
    """Label and score of each text by the sparse product of a batch's counts and the matrix."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    able = [k for k, text in enumerate(texts) if names and any(map(str.isalpha, text))]
    if not able:
        return labels, scores
    totals, sizes = np.zeros((len(able), len(names))), np.zeros(len(able))
    columns, step = np.ascontiguousarray(matrix.T), max(1, CELLS // len(names))
    for parts in slices([prepared(texts[k]) for k in able]):
        first = parts[0][0]
        place, bucket, n = sparse_counts([(k - first, part) for k, part in parts])
        sizes[first : parts[-1][0] + 1] += np.bincount(place, n)
        for at in range(0, len(n), step):
            cells = slice(at, at + step)
            starts = np.flatnonzero(np.diff(place[cells], prepend=-1))
            product = columns[bucket[cells]] * n[cells, None].astype(float)
            totals[place[cells][starts] + first] += np.add.reduceat(product, starts)
    best = totals.argmax(axis=1)
    top = np.take_along_axis(totals, best[:, None], 1)
    odds = (totals - top) / sizes[:, None] * np.minimum(sizes, EVIDENCE)[:, None]
    for k, label, score in zip(able, best, 1.0 / np.exp(odds).sum(axis=1)):
        labels[k], scores[k] = names[label], float(score)
    return labels, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        labels, scores = predict(*shared.value, texts_of(batch.column(2)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": labels, "score": scores}

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (id_checksum(docs["doc_id"]) % HELD_OUT_OF == HELD_OUT).alias("held_out"),
        docs["text"].alias("text"),
    )
    return per_batch(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
