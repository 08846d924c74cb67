import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.llm import radix, resample


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, buckets, longest):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        np.add.at(s, features(text, buckets, longest), 1)
    for text in target:
        np.add.at(t, features(text, buckets, longest), 1)
    out = []
    for i, text in rows:
        found = features(text, buckets, longest)
        weight = sum(
            math.floor(1000 * math.log(float(t[b] + 1) * float(s.sum() + buckets) / (float(s[b] + 1) * float(t.sum() + buckets))))
            for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(words_of(text)) >= least, None])
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[5] = rank
    return sorted((tuple(r[:4] + r[5:]) for r in out), key=str)


def answers(found):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows(odd, make):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["ÄÖ", "Éa1", "数", "don't", "A-B"]
    more = make([(k, " ".join(rng.choices(vocabulary, k=rng.randrange(60))), "en", "a") for k in range(400, 900)]
                + [(k, "hot " * 25, "en", "a") for k in range(2000, 2300)])
    return odd.union(more)


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, rows, longest):
    target = spark.createDataFrame([("w1 w2 w3 hot",), (None,), ("",), ("W4 ÄÖ don't",)], "text string")
    found = resample.resample(rows, target, longest=longest, buckets=500)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    expected = brute(plain, ["w1 w2 w3 hot", None, "", "W4 ÄÖ don't"], buckets=500, longest=longest)
    assert answers(found) == expected


def test_a_long_text_is_cut_between_words(monkeypatch):
    text = ("ab cd,efg " * 999 + "é" * 3000 + " Zz").encode()
    whole = [np.sort(np.concatenate([b for _, b in resample.run_buckets(text, 1000, n)])) for n in (1, 2, 3)]
    monkeypatch.setattr(resample, "_SLICE", 50)
    assert len(list(resample.slices(text))) > 10
    for n in (1, 2, 3):
        assert np.array_equal(whole[n - 1], np.sort(np.concatenate([b for _, b in resample.run_buckets(text, 1000, n)])))


def test_empty_tables(spark, none, make):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(none, target).count() == 0
    assert answers(resample.resample(make([(1, "a b", None, None)]), target))[0][-1] is None


def test_radix_sort(spark, monkeypatch):
    monkeypatch.setattr(radix, "DIGIT", 5)
    monkeypatch.setattr(radix, "BLOCK", 4)
    monkeypatch.setattr(radix, "SPAN", 2)
    rng = random.Random(4)
    data = [(rng.choice([None, 5, -3, rng.randrange(-(10**6), 10**6)]), rng.choice([-(2**63), 2**63 - 1, 0, 7, None]), k)
            for k in range(900)]
    data += [(77, 8, k) for k in range(900, 1500)]  # a hot key
    frame = spark.createDataFrame(data, "a long, place long, digit long").repartition(5)
    found, n = radix.radix_sort(frame, [("a", False), ("place", True), ("digit", True)], "at")
    got = [(r.a, r.place, r.digit) for r in sorted(found.collect(), key=lambda r: r["at"])]
    assert n == 1500 and sorted(r["at"] for r in found.collect()) == list(range(1500))
    assert got == sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))


def test_radix_passes_are_stable_and_few(spark):
    frame = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("key"), F.lit(4).alias("same"))
    parts, n = radix.key_parts(frame, [("key", True), ("same", True)])
    assert n == 5000 and [bits for _, bits in parts] == [2] and len(radix.digits(parts)) == 1
    found, _ = radix.radix_sort(frame.coalesce(1), [("key", True)])
    got = [r.id for r in found.orderBy("place").collect()]
    assert got == sorted(range(5000), key=lambda i: (i % 3, i))
    empty, n = radix.radix_sort(frame.limit(0), [("key", True)])
    assert n == 0 and empty.count() == 0
