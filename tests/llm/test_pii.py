import hashlib
import random
import re

import pytest

from scorebook.llm import pii


def brute(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["a@.1 2-3+45().Zé_%\n60", "1234567890 -", "a.@-b", "0.12.255.3 "])
def test_base_spans_against_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(8000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(1)
    rows = []
    for k in range(500):
        card = f"4{rng.randrange(10**14):014d}"
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        thing = (
            f"user{k}@mail{k % 7}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.10.{rng.randrange(256)}",
            card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}", f"built in {1900 + k % 120}", "version 2.0",
        )[k % 6]
        rows.append({"doc_id": k, "text": f"some words before {thing} and after it, item {k} of 12-34 or 2024-03-{k % 28 + 1:02d} 1234"})
    return rows


def test_trees_find_other_formats_and_leave_numbers_alone(documents):
    model = pii.fit(documents)
    for text in ("please call (528) 555-2987 now", "phone 528-555-2987 here", "write to joe [at] example.com today"):
        base, every = pii.spans_of(text, model)
        assert not base and every, text
    for text in ("on 2024-03-05 12 we met", "from 1200 - 1299 / 77 to", "order 000123456789 came", "Apache License, Version 2.0."):
        assert pii.spans_of(text, model) == ([], []), text
    clean = sum(len(pii.spans_of(r["text"], model)[1]) - len(pii.spans_of(r["text"], model)[0]) for r in documents)
    assert clean <= 2


def test_long_runs_are_linear(documents):
    model = pii.fit(documents)
    for text in ("1" * 10**5, "a" * 10**5, "@" * 10**5, "+1 " * 30_000, "1.1." * 25_000, "a@" * 50_000, "a@b." * 25_000):
        pii.spans_of(text, model)


def test_redaction():
    text = "mail a@b.cc or +1 (528) 555-2987."
    assert pii.redact(text, pii.base_spans(text)) == "mail <EMAIL> or <PHONE>."


def test_documents(spark, odd, make, documents, none):
    docs = odd.union(make([(1000 + r["doc_id"], r["text"], None, None) for r in documents]))
    found = {(r.doc_id, r.redacted_text): r for r in pii.find(docs, pii.train(docs)).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    by_id = {k[0]: r for k, r in found.items()}
    for i, text in texts:
        base = brute(text)
        r = by_id[i]
        if i != 9:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(1 for s in base if s[1] == k) for k in range(4)]
            assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
            assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
    assert pii.find(none, pii.train(none)).count() == 0


def test_repeated_rows_are_one_row_of_the_fit(make, monkeypatch):
    docs = make([(k, f"call 555-010-{k}", "en", "a") for k in range(30)] + [(7, "call 555-010-7", "en", "a")] * 500)
    seen = []
    monkeypatch.setattr(pii, "fit_in_one_task", lambda rows, fit: seen.extend(r.doc_id for r in rows.collect()))
    pii.train(docs)
    assert sorted(seen) == list(range(30))
