import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scorebook.llm import packing
from scorebook.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(vocabulary())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_words_in_a_row_are_the_text(tokenizer):
    rng = random.Random(5)
    alphabet = "aAbÉéßİıΣς'd's 12  ́éñ.,;!?)(<|endoftext|>\n\t \x1c\u0085𝔘日本"
    words = packing.WordIds(vocabulary())
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert words.of_text(text.encode()) == np.array(ids(tokenizer, text)[:-1], "<u4").tobytes(), text
    for text in ("<|endoftext|> a <|startoftext|>b", "x" * 5000, "Don't WE'LL I'D", "Word, word. WORD!? (word)"):
        assert words.of_text(text.encode()) == np.array(ids(tokenizer, text)[:-1], "<u4").tobytes()


@pytest.mark.parametrize("shape", ["uniform", "third", "small", "long"])
def test_packing_is_valid_and_tight(shape):
    rng = np.random.default_rng(1)
    lengths = {
        "uniform": rng.integers(1, 4097, 900), "third": rng.integers(1200, 1500, 900),
        "small": rng.integers(1, 300, 900), "long": rng.integers(2000, 4097, 900),
    }[shape]
    lengths = sorted(map(int, lengths), reverse=True)
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(900))
    assert max(sum(lengths[i] for i in b) for b in bins) <= packing.CAPACITY
    assert len(bins) <= len(packing.best_fit(lengths))
    big = sum(1 for x in lengths if 2 * x > packing.CAPACITY)
    assert len(bins) <= 1.05 * max(big, -(-sum(lengths) // packing.CAPACITY)) + 1


def test_local_search_empties_bins():
    # Best fit leaves three bins; one exchange between the two fuller ones makes room.
    lengths = [44, 44, 37, 37, 19, 19]
    assert len(packing.best_fit(lengths, 100)) == 3 and len(packing.pack(lengths, 100)) == 2
    # Two for one, and one for two.
    for lengths in ([60, 52, 30, 30, 28], [62, 58, 40, 22, 18], [70, 40, 35, 30, 25]):
        assert len(packing.pack(lengths, 100)) <= len(packing.best_fit(lengths, 100))


def test_pieces_give_the_documents_back(odd, make, tokenizer):
    docs = odd.union(make([(k, "The cat sat. " * (k - 99), None, None) for k in range(100, 140)]))
    found = packing.packed(docs, vocabulary()).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = []
    for i, text in texts:
        all_ids = ids(tokenizer, text)
        for k, at in enumerate(range(0, len(all_ids), packing.CAPACITY)):
            part = np.array(all_ids[at : at + packing.CAPACITY], "<u4")
            expected.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(expected, key=key)
    inside = defaultdict(list)
    for r in found:
        inside[r.sequence_id].append((r.offset, r.length))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_no_rows(none):
    assert packing.packed(none, vocabulary()).count() == 0
