import hashlib
import re
import uuid

from scorebook.llm import exact


def index(spark):
    return exact.DigestIndex(spark, f"test_digests_{uuid.uuid4().hex[:8]}", buckets=8)


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        out.append((i, min(groups[key])[2], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd, make):
    docs = odd.union(make([(k, "a hot text " * (1 + k % 3), "en", "a") for k in range(100, 700)]))
    idx = index(spark)
    found = exact.deduplicate(docs, idx).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    for r in found:
        assert not r.kept or r.keep_id == r.doc_id
    idx.clear()


def test_later_batches_meet_the_index(spark, make):
    idx = index(spark)
    exact.deduplicate(make([(1, "first text", None, None), (2, "other", None, None)]), idx).collect()
    again = {r.doc_id: r for r in exact.deduplicate(
        make([(5, "first  text", None, None), (6, "new", None, None), (7, "new", None, None)]), idx).collect()}
    assert (again[5].keep_id, again[5].kept) == (1, False)
    assert (again[6].kept, again[7].kept, again[7].keep_id) == (True, False, 6)
    assert idx.read().count() == 3
    idx.clear()


def test_the_index_side_is_not_shuffled(spark, make):
    idx = index(spark)
    exact.deduplicate(make([(k, f"text {k}", None, None) for k in range(50)]), idx).collect()
    plan = idx.fresh(exact.candidates(exact.digests(make([(1, "a", None, None)]))))._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    index_side = join[join.index("FileScan") - 200:]
    assert "Bucketed: true" in index_side and join.count("Exchange hashpartitioning") == 1
    idx.clear()


def test_one_row_for_each_text_with_all_columns(odd):
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    # Null, empty and blank are one text; the repeated row is one row.
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([3, 5, 6, 7, 8, 9, 9, None], key=str)


def test_no_rows(spark, none):
    idx = index(spark)
    assert exact.deduplicate(none, idx).count() == 0 and exact.keep_first(none).count() == 0
    idx.clear()


def test_batches_give_the_rows_of_one(spark, odd, make):
    docs = odd.union(make([(k, f"text {k % 70}" + " " * (k % 3), "en", "a") for k in range(100, 500)]))
    one, many = index(spark), index(spark)
    expected = sorted(exact.deduplicate(docs, one).collect(), key=str)
    found = exact.deduplicate(docs, many, batches=3)
    assert many.read().count() == one.read().count()
    many.clear()  # the rows no longer need the index
    assert sorted(found.collect(), key=str) == expected
    one.clear()
