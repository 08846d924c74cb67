"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult and threat terms with weights, targets, negation
and reporting words. Small transducers over these classes are tables that read a
symbol and write one: negation, reported speech and target add signs to the words in
their reach, insult and threat turn a term with its signs into a mark. They are
composed (each reads what the one before writes) to one table that runs over a clause
from its start, after one that runs from its end and signs targets ahead, so a clause
takes time linear in its words. The marks give the weights of a clause's matches,
lowered inside the reach of a negation or a reported clause and raised when a target
stands beside them. What is scored is the matched clause, never a word alone.

The insult terms are learned from labelled rows: whole words and word beginnings
whose contexts (the words around them) are many and lie in toxic documents only,
so that a sentence copied into many documents counts once. Weights of the grammar's
outputs and their calibration come from the same bounded sample.

Defined cases: a null, empty or wordless text scores the model's base rate; without
labels of both kinds the seed terms decide with fixed weights; repeated rows get
equal scores and count once in the fit; very long texts and clauses are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_one_task, id_checksum, per_batch, texts_of
from .learn import SparseRows, logistic, sigmoid
from .quality import labelled_sample

HELD_OUT_OF = 5
#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6, 7, 8)
#: A beginning must stand for so many different words, none of them with half of its uses.
STEM_WORDS = 3
#: A term's documents are toxic at this rate; it is kept when that explains its documents
#: better than chance by this log-likelihood (a million terms are tested); the most terms kept.
PURITY = 0.99
EVIDENCE = math.log(1e6)
MOST_TERMS = 4000
#: Bound of the fit: toxic and other labelled rows.
TOXIC_ROWS, OTHER_ROWS = 1500, 6000
#: Words after a negation or reporting word that it reaches.
NEGATION_REACH = 3
REPORT_REACH = 8

# Seed words of the grammar in the four languages of the corpus.
INSULTS = "idiot moron stupid imbecile scum loser trash worthless pathetic disgusting dumb jerk bastard".split() + (
    "dumm trottel abschaum idioten crétin connard ordure imbécile estúpido basura escoria".split()
)
THREATS = "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = (
    "you your yourself they them he she du dich dein ihr euch sie tu toi ton vous votre tú tu usted ustedes ellos".split()
)
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás".split()
REPORTS = (
    "said says say called quoted quote reported wrote according sagte sagt nannte laut dit appelle selon dijo dice según".split()
)

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
OUTPUTS = ("plain", "negated", "reported", "targeted", "threat", "strongest", "clauses")


class Lexicon:
    """Class and weight of a word: whole words first, then the longest known beginning."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        self.classes = {w: THREAT for w in THREATS} | {w: TARGET for w in TARGETS}
        self.classes |= {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.terms, self.stems

    def __setstate__(self, state):
        self.__init__(*state)

    def trigger(self, word: str) -> float:
        """Weight of an insult term, 0 for any other word."""
        weight = self.terms.get(word)
        if weight is None:
            weight = next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems), 0.0)
        return weight

    def read(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            weight = self.trigger(word)
            found = (INSULT, weight) if weight else (self.classes.get(word, OTHER), 0.0)
            if len(self.known) < 200_000:
                self.known[word] = found
        return found


# Signs that transducers add to a word's class, and marks that they write in its place.
AHEAD, CLOSE, BESIDE, NEGATED, REPORTED = (8 << k for k in range(5))
MARK = 8 << 5
PLAIN_MARK, NEGATED_MARK, REPORTED_MARK, THREAT_MARK, TARGETED_MARK = MARK, MARK + 1, MARK + 2, MARK + 3, 4
ALPHABET = MARK + 8
#: Words beside an insult, and after a threat, among which a target counts.
TARGET_REACH, THREAT_REACH = 4, 3


class Transducer:
    """A finite machine as two tables: follow[state][symbol] and write[state][symbol]; it starts in state 0."""

    def __init__(self, follow: list[list[int]], write: list[list[int]]):
        self.follow, self.write = follow, write

    @classmethod
    def of(cls, states: int, step) -> Transducer:
        """`step(state, symbol)` gives (next state, written symbol)."""
        cells = [[step(q, x) for x in range(ALPHABET)] for q in range(states)]
        return cls([[c[0] for c in row] for row in cells], [[c[1] for c in row] for row in cells])

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this machine writes. States are the reachable pairs."""
        number, pairs, follow, write = {(0, 0): 0}, [(0, 0)], [], []
        for p, q in pairs:
            row, out = [], []
            for after, between in zip(self.follow[p], self.write[p]):
                pair = (after, other.follow[q][between])
                if pair not in number:
                    number[pair] = len(pairs)
                    pairs.append(pair)
                row.append(number[pair])
                out.append(other.write[q][between])
            follow.append(row)
            write.append(out)
        return Transducer(follow, write)

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for x in symbols:
            out.append(self.write[state][x])
            state = self.follow[state][x]
        return out


def _kind(symbol: int) -> int:
    return symbol & 7 if symbol < MARK else OTHER


def _fading(opens: int, stays: int | None, reach: int, sign: int) -> Transducer:
    """Adds `sign` to the `reach` words after one of class `opens`; class `stays` takes no place in it."""

    def step(left: int, symbol: int) -> tuple[int, int]:
        kind = _kind(symbol)
        if kind == opens:
            return reach, symbol
        if kind == stays:
            return left, symbol
        return max(0, left - 1), symbol | sign if left and symbol < MARK else symbol

    return Transducer.of(reach + 1, step)


def _insult(_: int, symbol: int) -> tuple[int, int]:
    if _kind(symbol) != INSULT:
        return 0, symbol
    mark = NEGATED_MARK if symbol & NEGATED else REPORTED_MARK if symbol & REPORTED else PLAIN_MARK
    return 0, mark | (TARGETED_MARK if symbol & (AHEAD | BESIDE) else 0)


def _threat(_: int, symbol: int) -> tuple[int, int]:
    """The last machine: a threat before a near target is marked, words without a mark become silence."""
    if _kind(symbol) == THREAT and symbol & CLOSE and not symbol & NEGATED:
        return 0, THREAT_MARK
    return 0, symbol if symbol >= MARK else OTHER


#: Targets ahead, read from the end of the clause; then what stands before a word and the patterns themselves.
BACKWARD = _fading(TARGET, None, TARGET_REACH, AHEAD).then(_fading(TARGET, None, THREAT_REACH, CLOSE))
FORWARD = (
    _fading(NEGATION, REPORT, NEGATION_REACH, NEGATED)
    .then(_fading(REPORT, NEGATION, REPORT_REACH, REPORTED))
    .then(_fading(TARGET, None, TARGET_REACH, BESIDE))
    .then(Transducer.of(1, _insult))
    .then(Transducer.of(1, _threat))
)


class Machine:
    """The grammar over clauses: both composed transducers, weighted by the terms that they mark."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def clause(self, words: list[str]) -> dict[str, float] | None:
        """Outputs of one clause, or None when no insult or threat with a target matches."""
        read = self.lexicon.read
        symbols = [read(w) for w in words]
        if not any(s in (INSULT, THREAT) for s, _ in symbols):
            return None
        signed = BACKWARD.run(s for s, _ in reversed(symbols))
        out = dict.fromkeys(OUTPUTS, 0.0)
        for mark, (_, weight) in zip(FORWARD.run(reversed(signed)), symbols):
            if mark < MARK:
                continue
            if mark == THREAT_MARK:
                out["threat"] += 1.0
                continue
            kind = mark & ~TARGETED_MARK
            out["negated" if kind == NEGATED_MARK else "reported" if kind == REPORTED_MARK else "plain"] += weight
            if kind != NEGATED_MARK:
                out["strongest"] = max(out["strongest"], weight)
            if mark & TARGETED_MARK:
                out["targeted"] += weight
        if not any(out.values()):
            return None
        out["clauses"] = 1.0
        return out

    def outputs(self, text: str) -> np.ndarray:
        """Summed outputs of a text's matched clauses, damped so that long texts do not grow without end."""
        total = dict.fromkeys(OUTPUTS, 0.0)
        text = text.lower()
        read = self.lexicon.read
        # Most texts hold no term at all; the machine runs over the others.
        if any(read(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(text))):
            for part in _CLAUSE.split(text):
                if found := self.clause(_WORD.findall(part)):
                    for name, value in found.items():
                        total[name] = max(total[name], value) if name == "strongest" else total[name] + value
        return np.array([math.log1p(total[n]) if n != "strongest" else total[n] for n in OUTPUTS])


def _terms(words: set[str]) -> set[str]:
    """Whole words, marked by a sign no word holds, and beginnings."""
    found = {"=" + w for w in words}
    for k in STEMS:
        found.update(w[:k] for w in words if len(w) > k)
    return found


def learn_lexicon(rows: list[dict]) -> Lexicon:
    """Terms that toxic documents hold and others do not, beyond chance.

    A term's evidence is the smaller of its toxic documents and its distinct
    contexts there, so copies of one sentence count once.
    """
    words = [_WORD.findall(r["text"].lower()) for r in rows]
    # Rows that are not toxic stand for more or fewer of the input than toxic ones do.
    stands = [[r.get("stands_for", 1.0) for r in rows if bool(r["label"]) == kind] for kind in (False, True)]
    times = np.mean(stands[0] or 1.0) / np.mean(stands[1] or 1.0)
    toxic_rows = [w for w, r in zip(words, rows) if r["label"]]
    other_rows = [w for w, r in zip(words, rows) if not r["label"]]
    mass = sum(map(len, toxic_rows))
    share = min(0.5, max(0.02, mass / max(1, mass + times * sum(map(len, other_rows)))))
    gain, loss = math.log(PURITY / share), math.log((1 - PURITY) / (1 - share))
    toxic: Counter[str] = Counter()
    for w in toxic_rows:
        toxic.update(_terms(set(w)))
    toxic = {t: n for t, n in toxic.items() if n * gain >= EVIDENCE}
    seen: Counter[str] = Counter()
    for w in other_rows:
        seen.update(t for t in _terms(set(w)) if t in toxic)
    other = Counter({t: n * times for t, n in seen.items()})
    toxic = {t: n for t, n in toxic.items() if n * gain + other[t] * loss >= EVIDENCE}
    contexts: dict[str, set] = defaultdict(set)
    covered: dict[str, Counter] = defaultdict(Counter)
    for w in toxic_rows:
        for i, word in enumerate(w):
            for term in _terms({word}):
                if term in toxic:
                    covered[term][word] += 1
                    contexts[term].add((w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
    good = []
    for term, n in toxic.items():
        n = min(n, len(contexts[term]))
        by_word = covered[term]
        spread = term.startswith("=") or (
            len(by_word) >= STEM_WORDS and 2 * max(by_word.values()) <= sum(by_word.values())
        )
        if spread and n * gain + other[term] * loss >= EVIDENCE:
            good.append((n, term))
    # Of nested beginnings with about the same documents the longest says most.
    kept = {t: n for n, t in good if not t.startswith("=")}
    good = [
        (n, t) for n, t in good
        if t.startswith("=") or not any(o != t and o.startswith(t) and 10 * m >= 9 * n for o, m in kept.items())
    ]
    good.sort(key=lambda x: (-x[0], x[1]))
    terms, stems = {w: 1.0 for w in INSULTS}, {}
    for n, term in good[:MOST_TERMS]:
        weight = min(2.0, 0.5 + math.log10(1 + n))
        if term.startswith("="):
            terms[term[1:]] = weight
        else:
            stems[term] = weight
    return Lexicon(terms, stems)


def fit(rows: list[dict]) -> dict:
    """Lexicon from one half, weights of the outputs from the other half, then terms from all."""
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["doc_id"], r["text"]))
    labels = np.array([float(r["label"]) for r in rows])
    counts = np.array([r["stands_for"] for r in rows])
    fallback = np.array([1.5, 0.2, 0.8, 0.8, 1.5, 0.5, 0.3])
    if len(rows) < 20 or labels.min() == labels.max():
        return {"lexicon": Lexicon({w: 1.0 for w in INSULTS}, {}), "weights": fallback, "bias": -2.0}
    half = np.arange(len(rows)) % 2 == 0
    machine = Machine(learn_lexicon([r for r, h in zip(rows, half) if h]))
    made = [machine.outputs(r["text"]) for r, h in zip(rows, half) if not h]
    data = SparseRows([(np.arange(len(OUTPUTS)), m) for m in made])
    weights, bias = logistic(data, labels[~half], len(OUTPUTS), penalty=0.02, steps=4000, counts=counts[~half])
    return {"lexicon": learn_lexicon(rows), "weights": np.maximum(weights, 0.0), "bias": bias}


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit_in_one_task(labelled_sample(docs, labels, "toxic", OTHER_ROWS, TOXIC_ROWS, rest_of=HELD_OUT_OF), fit)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        model = shared.value
        machine = Machine(model["lexicon"])
        scores = [
            float(sigmoid(machine.outputs(t) @ model["weights"] + model["bias"])) for t in texts_of(batch.column(2))
        ]
        return {
            "doc_id": batch.column(0), "held_out": batch.column(1), "score": scores,
            "predicted": [int(s >= 0.5) for s in scores],
        }

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (id_checksum(docs["doc_id"]) % HELD_OUT_OF == 0).alias("held_out"), docs["text"].alias("text"),
    )
    return per_batch(rows, run, "doc_id long, held_out boolean, score double, predicted int")
