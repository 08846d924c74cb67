import random

import numpy as np
import pytest
import xxhash

from scorebook.llm import simhash


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def brute_components(fps, radius=3):
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "one", "One TWO", "É a b c É", "a b c " * 50, "x" * 1000, "a\x1cb c\x85d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def flipped(rng, fp, bits):
    for k in rng.sample(range(64), bits):
        fp ^= 1 << k
    return fp


def test_every_near_pair_meets_in_a_bucket(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        a = rng.getrandbits(64)
        rows.append((k, a, flipped(rng, a, rng.randint(1, 3))))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    frame = spark.createDataFrame([(k, signed(a), signed(b)) for k, a, b in rows], "k long, a long, b long")
    keyed = frame.select("k", simhash.bucket_keys(frame.a).alias("x"), simhash.bucket_keys(frame.b).alias("y")).collect()
    assert all(set(r.x) & set(r.y) for r in keyed)
    assert all(len(set(r.x)) == 16 for r in keyed)


@pytest.mark.parametrize("tile", [4, 64, 1024])
def test_bit_sliced_links_and_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:4]:  # dense groups and chains
        for _ in range(60):
            fps.add(flipped(rng, centre, rng.randint(1, 5)))
            centre = flipped(rng, centre, rng.randint(0, 2))
            fps.add(centre)
    fps |= {0, 1, (1 << 64) - 1}
    signed = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    found = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    expected = brute_components([x % (1 << 64) for x in signed])
    assert [found.get(x, x) for x in signed] == [signed[i] for i in expected]


def test_carry_save_counters_against_bit_counts():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    fps[350:] = fps[:350] ^ (np.uint64(1) << rng.integers(0, 63, 350).astype(np.uint64))
    order = np.argsort(np.arange(700) % 5, kind="stable")
    fps, group = fps[order], np.sort(np.arange(700) % 5)
    side = rng.integers(0, 3, 700)
    found = {(int(a), int(b)) for left, right in simhash.near_pairs(fps, group, side) for a, b in zip(left, right)}
    expected = {
        (i, j) for i in range(700) for j in range(700)
        if i != j and group[i] == group[j] and side[i] != 1 and side[j] >= 1 and int(fps[i] ^ fps[j]).bit_count() <= 3
    }
    assert found == expected and found


def test_documents(odd, make, none):
    base = " ".join(f"word{i}" for i in range(400))
    docs = odd.union(make([(k, base + f" tail{k}", None, None) for k in range(50, 90)] + [(200, base.upper(), None, None)]))
    found = simhash.clusters(docs).collect()
    rows = [(r.doc_id, r.fp % (1 << 64)) for r in found]
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert sorted(f for _, f in rows) == sorted(brute_fingerprint(t) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    labels = brute_components([f for _, f in rows])
    for r, label in zip(found, labels):
        ids = [rows[k][0] for k in range(len(rows)) if labels[k] == label and rows[k][0] is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(labels))
    assert len(texts) >= kept.count() and simhash.keep_one(none).count() == 0 and simhash.clusters(none).count() == 0
