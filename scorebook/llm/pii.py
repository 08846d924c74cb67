"""Personal data by candidate gradient boosting.

Fixed base patterns (emails, IPv4 addresses, card numbers, phone numbers) always
count. Beside them high-recall generators propose looser, overlapping spans:
written-out addresses, numbers in other formats, IPv6 addresses. Boosted trees see
a candidate's format and the words around it; a probability calibrated on rows the
trees never saw selects a candidate from THRESHOLD on, best first, and none that
overlaps a base span.

The trees learn from a bounded sample of documents: base matches there are
positive, also rewritten into the looser formats; other candidates of the sample
and rewritten look-alikes (dates, versions, ranges, amounts) are negative.

Defined cases: a null or empty text has no spans; positions count code points,
ends are exclusive; a sample without candidates leaves the base patterns alone, as an
empty table does, whose result is empty. A null id stays null; repeated rows are each
searched and one row of the fit.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_one_task, per_batch, texts_of
from .learn import BoostedTrees, platt, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Bound of the fit: documents that hold a digit or an at sign, none longer than this.
SAMPLE = 3000
SAMPLE_CHARS = 20_000
#: Calibrated probability from which a candidate is personal data.
THRESHOLD = 0.9
CONTEXT = 24

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number part ends where its digits end, so a run of digits is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]|[aA][tT][\\])]")

_WRITTEN = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:[\[(] ?at ?[\])]|@) ?[A-Za-z0-9-]{1,64}"
    r"(?: ?(?:\.|[\[(] ?(?:dot|\.) ?[\])]) ?[A-Za-z0-9-]{1,64}){1,6}", re.I,
)
_NUMBER = re.compile(r"(?<![0-9])[(+]?[0-9][0-9 ().\-/]{7,28}[0-9](?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# Words that stand near personal data, by kind.
NEAR = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "fon", "móvil", "appel"),
}

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, domain.end()))
            free = domain.end()
        else:
            free = at + 1  # no address reaches over an at sign
        at = text.find("@", free)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Loose spans of every kind; they may overlap each other and the base spans."""
    found = [(m.start(), 0, m.end()) for m in _WRITTEN.finditer(text)] if "@" in text or "at" in text.lower() else []
    found += [(m.start(), 1, m.end()) for m in _IP6.finditer(text)] if text.count(":") >= 5 else []
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if 9 <= n <= 15:
            found.append((m.start(), 3, m.end()))
        if 13 <= n <= 19:
            found.append((m.start(), 2, m.end()))
    return found


def describe(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, kind, end = span
    inside = text[start:end]
    digits = _digits(inside)
    groups = [len(g) for g in re.findall("[0-9]+", inside)] or [0]
    before = text[max(0, start - CONTEXT) : start].lower()
    left, right = text[start - 1 : start], text[end : end + 1]
    last = re.split(r"[^A-Za-z]+", inside)[-1]
    return [
        kind, len(inside), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        inside.count(" "), inside.count("-"), inside.count("."), inside.count("/"), inside.count(":"),
        inside.count("(") - 2.0 * (inside.count("(") != inside.count(")")), inside[:1] == "+",
        luhn(digits) if kind == 2 else -1.0, int(digits[:4] or 0) if 1900 <= int(digits[:4] or 0) < 2100 else 0,
        len(set(re.findall(r"[ ./-]+", inside))), left.isalnum(), right.isalnum(), right in ("%", "$", "€", "°"),
        any(w in before for w in NEAR[KINDS[kind]]), "[" in inside or "(at" in inside.lower(), len(last),
        sum(c.isdigit() for c in before), len(set(digits)),
    ]


def _rewritten(text: str, span: Span, turn: int) -> tuple[str, Span] | None:
    """The text with one base span in a looser format, and the span there."""
    start, kind, end = span
    inside = text[start:end]
    if kind == 0:
        local, _, domain = inside.partition("@")
        new = (f"{local} [at] {domain}", f"{local}(at){domain.replace('.', '(dot)')}", f"{local} @ {domain}")[turn % 3]
    elif kind == 1:
        parts = [f"{int(p):x}" for p in inside.split(".")]
        new = ":".join(["2001", "db8", *parts, "0", "1"])
    elif kind == 2:
        d = _digits(inside)
        new = (d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4)))[turn % 3]
    else:
        d = _digits(inside)[-10:]
        new = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[turn % 3]
    return text[:start] + new + text[end:], (start, kind, start + len(new))


def _look_alikes(text: str, span: Span, turn: int) -> tuple[str, list[Span]]:
    """The text with an innocent number in a base span's place, and its candidates."""
    start, _, end = span
    a = xxhash.xxh64_intdigest(text[start:end], turn)
    new = (
        f"{1990 + a % 40}-{1 + a % 12:02d}-{1 + a % 28:02d} {a % 24:02d}", f"{a % 10**6}.{a % 10**7}",
        f"{a % 3000} - {a % 3000 + 99} / {a % 7777}", f"{a % 9}.{a % 99}.{a % 999}.{a % 9999}.{a % 99}",
        f"{a % 10**12:012d}", f"{a % 10**16:016d}", f"{a % 900 + 100} {a // 900 % 900 + 100} {a % 800 + 100} {a % 99}",
        f"{1 + a % 28:02d}/{1 + a % 12:02d}/{1990 + a % 40} {a % 24:02d}",
    )[turn % 8]
    changed = text[:start] + new + text[end:]
    return changed, [c for c in candidates(changed) if c[0] < start + len(new) and c[2] > start]


def training_rows(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample's candidates, rewritten positives and look-alikes."""
    x, y = [], []
    for row in rows:
        text = row["text"] or ""
        base = base_spans(text)
        taken = [(s, e) for s, _, e in base]
        for c in candidates(text):
            if not any(s < c[2] and c[0] < e for s, e in taken):
                x.append(describe(text, c))
                y.append(0.0)
        for k, span in enumerate(base):
            turn = xxhash.xxh32_intdigest(f"{row['doc_id']}:{k}")
            x.append(describe(text, span))
            y.append(1.0)
            changed, new = _rewritten(text, span, turn)
            x.append(describe(changed, new))
            y.append(1.0)
            for extra in range(3):
                changed, found = _look_alikes(text, span, turn + extra)
                x.extend(describe(changed, c) for c in found)
                y.extend([0.0] * len(found))
    return np.array(x, float), np.array(y)


def fit(rows: list[dict]) -> dict | None:
    """Trees from four fifths of the examples, calibration from the rest."""
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"] or ""))
    x, y = training_rows(rows)
    held = np.arange(len(y)) % 5 == 0
    if len(y) < 50 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        return None
    trees = BoostedTrees(rounds=60, depth=4).fit(x[~held], y[~held])
    slope, offset = platt(trees.score(x[held]), y[held])
    return {"trees": trees, "slope": slope, "offset": offset}


def train(docs: DataFrame) -> dict | None:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    able = rows.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    chosen = able.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).orderBy("key").limit(SAMPLE)
    keyed = able.withColumn("key", F.xxhash64("doc_id", "text"))
    # Repeated rows share a key; one of each enters the fit, however many there are.
    rows = keyed.join(F.broadcast(chosen.select("key")), "key", "left_semi").dropDuplicates(["key"])
    return fit_in_one_task(rows.select("doc_id", "text"), fit)


def spans_of(text: str, model: dict | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the selected candidates; both by start, kind and end."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, base
    # Base spans of different kinds may overlap; their union decides what is taken.
    starts, ends = [], []
    for start, _, end in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    free = lambda s, e: (k := bisect.bisect_left(starts, e) - 1) < 0 or ends[k] <= s
    open_ = [c for c in candidates(text) if free(c[0], c[2])]
    if not open_:
        return base, base
    x = np.array([describe(text, c) for c in open_], float)
    p = sigmoid(model["slope"] * model["trees"].score(x) + model["offset"])
    chosen: list[Span] = []
    for i in sorted(np.flatnonzero(p >= THRESHOLD), key=lambda i: (-p[i], open_[i])):
        start, kind, end = open_[i]
        if free(start, end):
            chosen.append(open_[i])
            k = bisect.bisect_left(starts, start)
            starts.insert(k, start)
            ends.insert(k, end)
    return base, sorted(base + chosen)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: dict | None, with_text: bool = True) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and, if asked for, redacted_text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counts = [f"n_{k}" for k in KINDS]

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in (*counts, "base_sha256", "spans", "redacted_text")}
        for text in texts_of(batch.column(1)):
            base, every = spans_of(text, shared.value)
            for k, name in enumerate(counts):
                out[name].append(sum(1 for s in base if s[1] == k))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
            if with_text:
                out["redacted_text"].append(redact(text, every))
        return {"doc_id": batch.column(0)} | out

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return per_batch(rows, run, schema + ", redacted_text string" * with_text)
