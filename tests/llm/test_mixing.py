import random
from collections import defaultdict

import pytest

from scorebook.llm import mixing


def one_by_one(values, seats, most):
    won = [0] * len(values)
    for _ in range(min(seats, sum(most))):
        k = max((i for i in range(len(values)) if won[i] < most[i]), key=lambda i: (values[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("seed", range(40))
def test_highest_quotients_seat_by_seat(seed):
    rng = random.Random(seed)
    values = [rng.random() * rng.choice([1, 10, 100]) + 0.01 for _ in range(rng.randint(1, 9))]
    seats = rng.randint(0, 80)
    most = [rng.choice([10**6, rng.randint(0, 30)]) for _ in values]
    if all(m == 10**6 for m in most):
        assert mixing.highest_quotients(values, seats, most) == one_by_one(values, seats, most)
    else:
        found = mixing.highest_quotients(values, seats, most)
        assert sum(found) == min(seats, sum(most)) and all(f <= m for f, m in zip(found, most))


def targets_by_rounds(sizes):
    """Share, cap, share the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_words(make, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "Z", "é", "zz", "hot"]
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 40, 700])), None, "hot" if k % 3 == 0 else rng.choice(names)) for k in range(900)]
    docs = make(rows)
    found = mixing.mix(docs).collect()
    source = {i: s for i, _, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    wanted = targets_by_rounds(sizes)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s])
    block = max(1, min(mixing.BLOCK_WORDS, sum(sizes.values()) // mixing.BLOCK_PART))
    for s in sizes:
        shards = 1 + sum(1 for x in source.values() if x == s) // mixing.SHARD_ROWS
        assert abs(taken[s] - wanted[s]) <= 2 * block * (shards + 1) + 1
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in found}


def test_whole_documents_come_near_the_targets(make):
    rows = [(k, " ".join(["w"] * (20 + k % 60)), None, f"s{k % 5}") for k in range(3000)]
    docs = make(rows)
    size = {i: len(t.split()) for i, t, _, _ in rows}
    kept = defaultdict(int)
    times = defaultdict(int)
    for r in mixing.mixed_rows(docs).collect():
        kept[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
    wanted = targets_by_rounds({f"s{k}": sum(size[i] for i in range(k, 3000, 5)) for k in range(5)})
    for s, target in wanted.items():
        assert abs(kept[s] - target) <= 0.05 * target + 200
    assert max(times.values()) <= 2 and mixing.mixed_rows(docs).columns == docs.columns


def test_odd_rows(odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert {r.size for r in found if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_no_words(make):
    docs = make([(1, None, None, "a"), (2, "", None, None)])
    assert [(r.taken, r.target) for r in mixing.mix(docs).collect()] == [(0, 0.0)] * 2
