"""Language, toxicity and quality: held-out accuracy, fixed counts against brute force, odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from scorebook.llm import language, learn, quality, toxicity

SYLLABLES = {"en": "th er on an re ing".split(), "de": "sch ung ein ich ver keit".split(), "fr": "eau tion que ai oux".split()}


def words(rng, lang, n):
    return [("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def checksum(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def spoken(make):
    rng = random.Random(1)
    rows = []
    for k in range(1, 500):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, " ".join(words(rng, lang, rng.randint(3, 60))), lang, "a"))
    return make(rows)


def test_language(spoken, odd, none):
    docs = spoken.union(odd.where("doc_id <= 3"))
    found = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    for i in truth:
        if i > 3:
            assert found[i].held_out == (checksum(i) % 4 == 2) and 0 <= found[i].score <= 1
    held = [i for i in truth if i > 3 and found[i].held_out]
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.97
    assert language.identify(none, language.train(none)).count() == 0


def test_language_of_nothing(odd):
    model = language.train(odd)
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert {found[i].lang_pred for i in (1, 2, 3)} == {"und"} and found[1].score == 0
    assert language.predict([], np.zeros((0, language.BUCKETS)), ["some text"]) == (["und"], [0.0])
    assert language.predict(["x"], np.zeros((1, language.BUCKETS), np.float32), ["123 !?", "é"])[0] == ["und", "x"]


def test_language_counts_leave_held_out_documents_alone(make):
    held = next(i for i in range(100) if checksum(i) % 4 == 2)
    other = next(i for i in range(100) if checksum(i) % 4 != 2)
    docs = make([(held, "secret words", "xx", None), (other, "plain words", "yy", None)])
    assert language.train(docs)[0] == ["yy"]


def brute_language(rows, texts):
    """Counts in dictionaries, one n-gram at a time; label and score of each text."""
    grams = lambda text: [
        int(language.grams(text[i : i + k])[-1]) for k in (1, 2, 3) for i in range(len(text) - k + 1)
    ]
    totals = {}
    for text, lang in rows:
        for g in grams(language.prepared(text)):
            totals.setdefault(lang, Counter())[g] += 1
    out = []
    for text in texts:
        found = grams(language.prepared(text))
        logs = {}
        for lang, n in sorted(totals.items()):
            mass = sum(n.values()) + language.SMOOTHING * language.BUCKETS
            logs[lang] = sum(math.log((n[g] + language.SMOOTHING) / mass) for g in found)
        best = max(logs, key=logs.get)
        scale = min(len(found), language.EVIDENCE) / len(found)
        out.append((best, 1 / sum(math.exp((v - logs[best]) * scale) for v in logs.values())))
    return out


@pytest.mark.parametrize("size", [None, 7, 50])
def test_language_against_brute_force(make, monkeypatch, size):
    rng = random.Random(5)
    rows = [
        (k, " ".join(words(rng, lang, rng.randint(1, 12))) + rng.choice(["", " É 𝔘 ß", "\n\n x"]), lang, "a")
        for k in range(60) for lang in [rng.choice(list(SYLLABLES))]
    ]
    docs = make(rows + rows[:5])
    learned = [(t, lang) for i, t, lang, _ in rows + rows[:5] if checksum(i) % 4 != 2]
    model = language.train(docs)
    if size:
        monkeypatch.setattr(language, "SLICE", size)
        monkeypatch.setattr(language, "CELLS", size)
    texts = [t for _, t, _, _ in rows]
    labels, scores = language.predict(*model, texts)
    expected = brute_language(learned, texts)
    assert labels == [label for label, _ in expected]
    assert np.allclose(scores, [score for _, score in expected], atol=1e-4)
    assert language.predict(*model, ["12", *texts[:3], ""])[0] == ["und", *labels[:3], "und"]


def test_more_labels_than_the_matrix_holds(make, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    ids = [i for i in range(100) if checksum(i) % 4 != 2]
    docs = make([(ids[0], "some words here", "cc", None), (ids[1], "other", "bb", None), (ids[2], "andre", "aa", None)])
    model = language.train(docs)
    assert model[0] == ["aa", "cc"]
    assert {r.lang_pred for r in language.identify(docs, model).collect()} <= {"aa", "cc"}


def brute_rules(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    n = len(found)
    return (
        n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_quality_rules_against_brute_force():
    rng = random.Random(4)
    texts = ["", None, "a b " * 30, "x\ny\nx\n \n \nx ", "é ß𝔘 #a|b&<>*"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "bé", "\n", " ", "\t", "#", " c d e f g h i j ", "𝔘"]) for _ in range(rng.randint(0, 90))))
    out = quality.verdicts(None, [(t or "").encode() for t in texts])
    for k, t in enumerate(texts):
        assert tuple(out[c][k] for c in (*quality.RULES, "base_failed")) == brute_rules(t), t


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good, toxic = rng.random() < 0.6, rng.random() < 0.35
        w = words(rng, "en", 60)
        if not good:
            w = [x + rng.choice(["$$$", "***", "###"]) for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["zorgo", "zorgly", "zorgs", "zorgish", "blatz"]))
        rows.append((k, " ".join(w).capitalize() + ".", "en", "a"))
        labels.append((k, int(good), int(toxic)))
    labels += [(10_000, None, None), (None, 1, 1)]
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model(labelled, odd):
    docs, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect()}
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    found = {r.doc_id: r for r in quality.assess(docs, model).collect()}
    rest = [i for i in found if i % 2]
    assert np.mean([found[i].kept == bool(truth[i]) for i in rest]) > 0.95
    kept = quality.keep_good(docs, labels.where("doc_id % 2 = 0"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in found if found[i].kept}
    rows = quality.assess(odd, model).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))


def test_quality_without_labels(labelled, none):
    docs, labels = labelled
    assert quality.train(docs, labels.where("quality = 1")) is None
    rows = quality.assess(docs, None).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.keep_good(none, labels).count() == 0


def test_toxicity_model(labelled, odd, none):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in found if found[i].held_out]
    assert all(found[i].held_out == (checksum(i) % 5 == 0) for i in found)
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.95
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in found.values())
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and not any(r.predicted for r in rows)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_grammar_scores_clauses():
    machine = toxicity.Machine(toxicity.Lexicon({"idiot": 1.0}, {"zorg": 2.0}))
    plain = machine.clause("you are an idiot".split())
    assert plain["plain"] == 1 and plain["targeted"] == 1
    assert machine.clause("you are not an idiot".split())["negated"] == 1
    assert machine.clause("the paper said he was an idiot".split())["reported"] == 1
    assert machine.clause("i will kill you".split())["threat"] == 1
    assert machine.clause("they kill weeds".split()) is None and machine.clause("a fine day".split()) is None
    assert machine.clause(["zorgling"])["plain"] == 2
    # A negation ends with its clause.
    apart, inside = machine.outputs("Never. You idiot."), machine.outputs("You never idiot.")
    assert apart[0] > 0 and inside[0] == 0


def simulated(symbols):
    """Outputs of a clause of (class, weight), by looking at the words around each term."""
    out = dict.fromkeys(toxicity.OUTPUTS, 0.0)

    def reached(i, opens, stays, reach):
        gap = 0
        for kind, _ in reversed(symbols[:i]):
            if kind == opens:
                return gap < reach
            gap += kind != stays
        return False

    for i, (kind, weight) in enumerate(symbols):
        negated = reached(i, toxicity.NEGATION, toxicity.REPORT, 3)
        reported = reached(i, toxicity.REPORT, toxicity.NEGATION, 8)
        gaps = [k - i for k, (other, _) in enumerate(symbols) if other == toxicity.TARGET]
        if kind == toxicity.INSULT:
            out["negated" if negated else "reported" if reported else "plain"] += weight
            out["strongest"] = max(out["strongest"], 0.0 if negated else weight)
            out["targeted"] += weight * any(abs(g) <= 4 for g in gaps)
        if kind == toxicity.THREAT and not negated and any(0 < g <= 3 for g in gaps):
            out["threat"] += 1
    out["clauses"] = float(any(out.values()))
    return out if out["clauses"] else None


def test_composed_transducers_against_direct_simulation():
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"idiot": 1.0, "scum": 0.5}, {})
    machine, seen = toxicity.Machine(lexicon), 0
    for _ in range(4000):
        share = rng.random()
        clause = [
            rng.choice("idiot scum kill you not said he".split()) if rng.random() < share else "w"
            for _ in range(rng.randint(0, 25))
        ]
        expected = simulated([lexicon.read(w) for w in clause])
        assert machine.clause(clause) == expected, clause
        seen += expected is not None
    assert seen > 1000
    # All reachable states of the parts together: 3 + 1, 8 + 1 and 4 + 1 at most.
    assert len(toxicity.FORWARD.follow) <= 4 * 9 * 5 and len(toxicity.BACKWARD.follow) <= 5 * 4


def test_composition_is_running_one_after_the_other():
    rng = random.Random(9)
    make_one = lambda: toxicity.Transducer.of(
        5, lambda q, x: (rng.randrange(5), rng.randrange(toxicity.ALPHABET))
    )
    a, b = make_one(), make_one()
    symbols = [rng.randrange(toxicity.ALPHABET) for _ in range(3000)]
    assert a.then(b).run(symbols) == b.run(a.run(symbols))


def test_a_long_clause_takes_linear_time():
    machine = toxicity.Machine(toxicity.Lexicon({"idiot": 1.0}, {}))
    times = []
    for n in (20_000, 200_000):
        words_ = "you idiot not a".split() * (n // 4)
        started = time.perf_counter()
        assert machine.clause(words_)["targeted"] == n / 4
        times.append(time.perf_counter() - started)
    assert times[1] < 40 * times[0]


def test_copies_of_a_sentence_are_no_evidence():
    rng = random.Random(3)
    clean = [{"doc_id": k, "label": 0, "text": " ".join(words(rng, "en", 50))} for k in range(200)]
    copied = [{"doc_id": 1000 + k, "label": 1, "text": "same strange sentence idiot " + " ".join(words(rng, "en", 40))} for k in range(40)]
    lexicon = toxicity.learn_lexicon(clean + copied)
    assert not lexicon.trigger("strange") and lexicon.trigger("idiot")


def test_logistic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = learn.BoostedTrees(rounds=40, depth=3).fit(x[:600], y[:600])
    assert np.mean((trees.score(x[600:]) > 0) == y[600:]) > 0.85
    y = (x[:, 0] > 0.2).astype(float)
    weights, bias = learn.logistic(learn.SparseRows([(np.arange(3), r) for r in x]), y, 3, penalty=0.1, steps=500)
    assert np.mean((x @ weights + bias > 0) == y) > 0.97
    slope, offset = learn.platt(x @ weights + bias, y)
    assert slope > 0 and abs(learn.sigmoid(slope * (x @ weights + bias) + offset).mean() - y.mean()) < 0.02


def test_threshold_stays_when_the_caps_bind(spark, make, monkeypatch):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(1500):
        # A third of the texts are mixed: 70 % of them good, 30 % of them toxic.
        mixed = k % 3 == 0
        good, toxic = (rng.random() < 0.7, rng.random() < 0.3) if mixed else (k % 30 > 1, k % 30 == 1)
        w = words(rng, "en", 40) + (["umbra"] * 6 if mixed else ["zorgo"] if toxic else ["***"] * 6 if not good else [])
        rows.append((k, " ".join(w), "en", "a"))
        labels.append((k, int(good), int(toxic)))
    docs, labels = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = quality.train(docs, labels), toxicity.train(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE", 300)
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 120)
    monkeypatch.setattr(toxicity, "OTHER_ROWS", 240)
    sample = quality.labelled_sample(docs, labels, "quality", 150, 150).collect()
    assert len(sample) == 300 and sum(r.stands_for for r in sample) == pytest.approx(1500)
    capped = quality.train(docs, labels), toxicity.train(docs, labels)
    texts = [t for _, t, _, _ in rows[::3]]
    kept = [np.mean(quality.verdicts(m[0], [t.encode() for t in texts])["kept"]) for m in (whole, capped)]
    flat = quality.fit([r.asDict() | {"stands_for": 1.0} for r in sample])
    kept.append(np.mean(quality.verdicts(flat, [t.encode() for t in texts])["kept"]))
    # Without the counts the capped sample turns most mixed texts away.
    assert kept[0] > 0.7 and kept[1] > 0.7 and kept[2] < 0.3
    base = [learn.sigmoid(m[1]["bias"]) for m in (whole, capped)]
    assert abs(base[0] - base[1]) < 0.05


def test_repeated_rows_are_one_row_of_the_fit(spark, make, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    docs = make([(k, f"text {k}", "en", "a") for k in range(50)] + [(7, "text 7", "en", "a")] * 400 + [(8, "a text", "en", "a")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)] + [(7, 1, 0)] * 30, "doc_id long, quality int, toxic int")
    sample = quality.labelled_sample(docs, labels, "quality", 100, 100).collect()
    assert sorted((r.doc_id, r.text) for r in sample) == sorted((k, "a text" if k == 8 else f"text {k}") for k in range(50))
    assert quality.labelled_sample(docs, labels, "quality", 10, 10).count() <= 20
