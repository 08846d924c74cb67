"""Quality rules: fixed rules first, then a hashed n-gram model with fixed thresholds.

The model is logistic regression over hashed word and character n-grams of a
sample of labelled rows (at most SAMPLE of them, the bound of the fit), calibrated
on a part of the sample that the weights never saw. Where a label has more rows than
the sample takes, its rows count for the others too, so the ratio of the labels and
with it the threshold do not move with the input's size. All documents are scored in
Arrow batches against fixed thresholds.

Defined cases: a null or empty text has no words and fails the rules; without
labels of both kinds the rules decide alone; labels that are null are not used.
Repeated rows are each judged alike and are one row of the fit; texts longer than
SAMPLE_CHARS are judged whole and left out of the fit.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fit_in_one_task, free_name, id_checksum, mix, per_batch, prefix_sums, sample_ids, ship, windows
from .learn import SparseRows, logistic, platt, sigmoid

#: Labelled rows the model is fitted on, and the longest text among them in characters.
SAMPLE = 5000
SAMPLE_CHARS = 30_000
SIZE = 1 << 16
#: Words of a repeated window, least words, and the share of repeated words (per cent) that fails.
REPEAT_WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Documents whose calibrated probability of good quality is below this are rejected.
THRESHOLD = 0.5

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that do not start a code point.
_TAILS = bytes(range(0x80, 0xC0))
#: Character classes for the n-grams: letters fold to a, capitals to A, digits to 0.
_SHAPES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_WHITE)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words covered by a window of `width` words that the text holds at least twice."""
    rolled = windows(prefix_sums(hashes), width)
    if len(rolled) < 2:
        return 0
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(rolled), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def rules_of(text: bytes, hashes: np.ndarray, words: list[bytes]) -> tuple[int, int, int, int, int]:
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.translate(None, _TAILS))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    return len(words), chars, symbols, duplicate_lines(text), repeated_words(hashes)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def features(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and shape n-grams of 3 and 5 characters; unit length."""
    parts = [hashes]
    if len(hashes) > 1:
        parts.append(hashes[1:] * np.uint64(0x9E3779B1) ^ hashes[:-1])
    shape = np.frombuffer(text.translate(_SHAPES), np.uint8).astype(np.uint64)
    for width in (3, 5):
        if len(shape) >= width:
            code = np.full(len(shape) - width + 1, np.uint64(width))
            for k in range(width):
                code = code * np.uint64(257) + shape[k : len(shape) - width + 1 + k]
            parts.append(mix(code))
    values = []
    index = []
    for k, part in enumerate(parts):
        bucket, count = np.unique((part >> np.uint64(17)) % np.uint64(SIZE), return_counts=True)
        value = np.log1p(count)
        index.append(bucket.astype(np.int64))
        values.append(value / max(np.sqrt((value**2).sum()), 1e-9))
    return np.concatenate(index), np.concatenate(values) / np.sqrt(len(parts))


def fit(rows: list[dict]) -> dict | None:
    """Weights from four fifths of the rows, calibration from the rest; None without both labels."""
    rows = sorted(
        (r for r in rows if r["text"] is not None),
        key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"]),
    )
    labels = np.array([float(r["label"]) for r in rows])
    counts = np.array([r["stands_for"] for r in rows])
    if len(rows) < 20 or labels.min() == labels.max():
        return None
    made = []
    for r in rows:
        text = r["text"].encode()
        made.append(features(text, word_hashes(text.split())))
    held = np.arange(len(rows)) % 5 == 0
    data = SparseRows([made[i] for i in np.flatnonzero(~held)])
    weights, bias = logistic(data, labels[~held], SIZE, penalty=0.05, steps=200, counts=counts[~held])
    scores = SparseRows([made[i] for i in np.flatnonzero(held)]).dot(weights) + bias
    slope, offset = platt(scores, labels[held], counts=counts[held])
    return {"weights": weights.astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, zeros: int, ones: int, rest_of: int | None = None
) -> DataFrame:
    """doc_id, text, label, stands_for of at most so many rows of each label.

    Repeated rows of a chosen id and label are one row here; of different texts of
    one id the first by code point is taken. `rest_of` leaves out ids whose checksum it divides; stands_for is the number of labelled rows to one of the sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    if rest_of:
        known = known.where(id_checksum(F.col("doc_id")) % rest_of != 0)
    whole = {r["label"]: r["count"] for r in known.where("label in (0, 1)").groupBy("label").count().collect()}

    def some(label: int, limit: int) -> DataFrame:
        times = max(1.0, whole.get(label, 0) / limit)
        return sample_ids(known.where(F.col("label") == label), limit).withColumn("stands_for", F.lit(times))

    chosen = some(0, zeros).union(some(1, ones))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label", "stands_for").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    return fit_in_one_task(labelled_sample(docs, labels, "quality", SAMPLE // 2, SAMPLE // 2), fit)


def verdicts(model: dict | None, texts: list[bytes]) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in (*RULES, "base_failed", "quality", "kept")}
    for text in texts:
        words = text.split()
        hashes = word_hashes(words)
        found = rules_of(text, hashes, words)
        bad = failed(found[0], found[4])
        if model is None or bad:
            good = float(not bad)
        else:
            index, value = features(text, hashes)
            score = float(model["weights"][index] @ value) + model["bias"]
            good = float(sigmoid(model["slope"] * score + model["offset"]))
        for name, v in zip(out, (*found, bad, good, not bad and good >= THRESHOLD)):
            out[name].append(v)
    return out


def assess(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the five counts, base_failed, quality (probability), kept for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0)} | verdicts(shared.value, bytes_of(batch.column(1)))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    counts = ", ".join(f"{name} long" for name in RULES)
    return per_batch(rows, run, f"doc_id long, {counts}, base_failed boolean, quality double, kept boolean")


def passes(text: Column, model: dict | None, spark) -> Column:
    """Whether the rules and the model keep a text, as a column over Arrow batches."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(column: pa.Array) -> pa.Array:
        return pa.array(verdicts(shared.value, bytes_of(column))["kept"], pa.bool_())

    return kept(text)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules and the model keep; columns unchanged."""
    columns = docs.columns
    flag = free_name(docs, "kept")
    model = train(docs, labels)
    return docs.withColumn(flag, passes(docs["text"], model, docs.sparkSession)).where(flag).select(*columns)
