import hashlib
import random
from collections import Counter

import pytest

from scorebook.llm import repeats


def brute(texts, width=repeats.WINDOW):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.choice([34, 35, 36, 52, 53, 90, 200]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice([0, 5, 34, 35, 60, 300]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 10)
            at = rng.randint(0, len(w))
            w[at:at] = p[cut:] if rng.random() < 0.5 else p
        texts.append((" ", "\n", "\t ")[rng.randrange(3)].join(w))
    texts += [texts[3], texts[3], "a b " * 100, "q " * 34, "q " * 35, "r " * 36]
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(make, seed):
    texts = texts_with_repeats(seed)
    found = {r.doc_id: r for r in repeats.remove_repeats(make([(k, t, None, None) for k, t in enumerate(texts)], 5)).collect()}
    assert len(found) == len(texts)
    for k, expected in enumerate(brute(texts)):
        assert (found[k].n_words, found[k].n_removed, found[k].kept_sha256) == expected, k
        assert hashlib.sha256(found[k].kept_text.encode()).hexdigest() == expected[2]


def test_a_passage_in_every_document(make):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"own{k} {passage} end{k}" for k in range(500)]
    found = repeats.remove_repeats(make([(k, t, None, None) for k, t in enumerate(texts)]), with_text=False).collect()
    assert {(r.n_words, r.n_removed) for r in found} == {(62, 60)}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    expected = sorted((str(i), *e) for (i, _), e in zip(rows, brute([t for _, t in rows])))
    found = repeats.remove_repeats(odd, with_text=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected
    assert repeats.remove_repeats(none).count() == 0


def test_packed_arrays_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64):
        values = np.unique(rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind))
        assert (repeats.unpack_sorted(repeats.pack_sorted(values), kind) == values).all()
