import random

import numpy as np

import corpus_pipeline

from scorebook.llm import near


def brute_kept(rows):
    """Ids that stay when the smallest of each component of pairs with similarity 0.8 or more is kept."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return sorted({rows[find(i)][0] for i in range(len(rows))}), pairs


def planted(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.getrandbits(40)}"
    return words


def test_planted_copies_are_found(spark, make):
    rng = random.Random(8)
    rows = []
    for n in (30, 60, 120, 400):
        for _ in range(25):
            base = [f"w{rng.getrandbits(40)}" for _ in range(n)]
            # From one word in 45 up: similarities on both sides of 0.8.
            rows += [" ".join(planted(rng, base, k)) for k in (0, max(1, n // 90), max(1, n // 60), n // 28)]
    hub = [f"hub{k}" for k in range(150)]
    rows += [" ".join(planted(rng, hub, rng.choice([1, 1, 2, 3]))) for _ in range(120)]
    rows += ["", " ", "one two", "ONE  two", "three words here", None]
    numbered = sorted(enumerate(rows))
    expected, pairs = brute_kept(numbered)
    kept = corpus_pipeline.near_dedup(spark, make([(k, t, "en", "s") for k, t in numbered]), "")
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert pairs > 1000 and len(expected) < len(rows) / 2


def test_copies_in_many_tiles(make, monkeypatch):
    monkeypatch.setattr(near, "TILE", 8)
    rng = random.Random(9)
    rows, words = [], [f"c{k}" for k in range(100)]
    for k in range(80):  # a chain: each is near the one before it, the ends are far apart
        words = planted(rng, words, 1)
        rows.append((k, " ".join(words)))
    expected, _ = brute_kept(rows)
    assert sorted(r.doc_id for r in near.keep_one(make([(k, t, "en", "s") for k, t in rows])).collect()) == expected


def test_odd_documents(odd, none):
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == [1, 5, 6, 7, 8, 9, 9, None]
    assert near.keep_one(none).count() == 0


def test_repeated_rows_and_groups_that_are_not_joined(make, monkeypatch):
    """Copies of one base with more and more changes: many share buckets and are not similar."""
    monkeypatch.setattr(near, "TILE", 16)
    monkeypatch.setattr(near, "TILE_SHINGLES", 4096)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(140)]
    rows = [(k, " ".join(planted(rng, base, 1 + k % 9))) for k in range(150)]
    expected, _ = brute_kept(rows)
    twice = rows + rows[:40]
    kept = near.keep_one(make([(k, t, "en", "s") for k, t in twice]))
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_sizes_of_intersections(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200)).astype(np.uint32)) for _ in range(30)]
    left, right = np.divmod(np.arange(900), 30)
    expected = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(left, right)]
    table = near.SharedShingles(sets)
    assert table.common(left[left != right], right[left != right]).tolist() == [e for e, a, b in zip(expected, left, right) if a != b]
    monkeypatch.setattr(near, "TABLE_WORDS", 0)
    assert near.SharedShingles(sets).common(left, right).tolist() == expected


def test_a_tile_returns_at_most_a_row_for_each_document():
    rng = np.random.default_rng(4)
    one = np.sort(rng.choice(10_000, 200, replace=False)).astype(np.uint32)
    sets = [one] * 100
    fps, nodes = np.zeros(100, np.uint64), np.arange(100) + 5
    u, v = near.tile_links(fps, np.full(100, 2), nodes, nodes, sets)
    assert len(u) == 99 and (v == 5).all()
    u, v = near.tile_links(fps, np.full(100, 2), nodes, np.full(100, 5), sets)
    assert len(u) == 0
