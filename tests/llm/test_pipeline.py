"""The corpus pipeline against brute force, stage by stage."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_near import brute_kept

from scorebook.llm import mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(frame):
    return [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality(stages, spark, sf_dir):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before = rows(stages[0])
    kept = quality.verdicts(model, [t.encode() for _, t in before])["kept"]
    assert sorted(rows(stages[1])) == sorted(r for r, k in zip(before, kept) if k)
    assert 0 < stages[1].count() < stages[0].count()


def test_exact(stages):
    best = {}
    for i, t in rows(stages[1]):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0, "")), (-len(t), i, t))
    assert sorted(rows(stages[2])) == sorted((i, t) for _, i, t in best.values())


def test_near(stages):
    """The stage's own rule: five-word shingles, similarity of 0.8 or more."""
    before = sorted(rows(stages[2]))
    kept, _ = brute_kept(before)
    assert sorted(i for i, _ in rows(stages[3])) == kept
    assert set(rows(stages[3])) <= set(before)


def test_mixing(stages):
    before, after = rows(stages[3]), Counter(i for i, _ in rows(stages[4]))
    source = {r.doc_id: r.source for r in stages[3].collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in before}
    assert set(after) <= set(size) and max(after.values()) <= 2
    wanted = {source[r.doc_id]: r.target for r in mixing.mix(stages[3]).collect()}
    got, most = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        got[source[i]] += n * after[i]
        most[source[i]] = max(most[source[i]], n)
    # Whole documents: off by a document and the words a block's first word stands for.
    assert all(abs(got[s] - t) <= 2 * most[s] + 0.15 * t for s, t in wanted.items())


def test_packing(stages):
    lengths, ids = defaultdict(int), Counter()
    for r in stages[5].collect():
        lengths[r.sequence_id] += r.length
        ids[r.doc_id] += r.piece == 0
    assert max(lengths.values()) <= 4096 and ids == Counter(i for i, _ in rows(stages[4]))
    assert len(lengths) <= 1.05 * sum(lengths.values()) / 4096 + 1


def test_run_is_the_stages(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, stages[5].select(*columns).collect()))
