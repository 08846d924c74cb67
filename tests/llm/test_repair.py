import hashlib
import itertools
import random
import zlib

import pytest

from scorebook.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind string, copies string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(parts)


def legal(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))


def every_repair(symbols, most_inserts):
    """(cost, audit) of every edit sequence that ends legal; symbols as in edited_row."""
    found = []
    gaps = [g for n in range(most_inserts + 1) for g in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*(("D",) if s == "D" else ("D", "K", "Ru", "Ra") for s in symbols)):
        for inserts in itertools.product(gaps, repeat=len(symbols) + 1):
            if sum(map(len, inserts)) > most_inserts:
                continue
            cost, audit, out = 0, "", ""
            for k, s in enumerate([*symbols, ""]):
                cost, audit, out = cost + 3 * len(inserts[k]), audit + "I" * len(inserts[k]), out + "".join(inserts[k])
                if not s:
                    break
                edit = edits[k]
                audit += edit[0]
                cost += {"K": 0, "R": 3, "D": 4}[edit[0]] + (3 if edit[0] != "D" and s.isupper() else 0)
                out += "" if edit == "D" else s.lower() if edit == "K" else edit[1]
            if legal(out):
                found.append((cost, audit))
    return found


def test_cells_against_every_edit_sequence():
    for n in range(1, 4):
        for symbols in itertools.product("suaxUD", repeat=n):
            assert repair.cheapest(repair.span("".join(symbols))) == min(every_repair(symbols, 2)), symbols


def backwards(symbols):
    """Least (cost, audit) by a walk from the last row to the first."""
    inf = (10**9, "")
    steps = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    def closed(best):
        for _ in range(4):
            best = {p: min([best[p], *((best[steps[p, i]][0] + 3, "I" + best[steps[p, i]][1]) for i in "ua" if (p, i) in steps)])
                    for p in best}
        return best

    best = closed({"0": (0, ""), "1": inf, "2": inf, "3": (0, "")})
    for s in reversed(symbols):
        new = {}
        for p in best:
            choices = [(best[p][0] + 4, "D" + best[p][1])]
            if s != "D":
                extra = 3 if s.isupper() else 0
                if (p, s.lower()) in steps:
                    q = best[steps[p, s.lower()]]
                    choices.append((q[0] + extra, "K" + q[1]))
                choices += [(q[0] + 3 + extra, "R" + q[1]) for i in "ua" if (p, i) in steps for q in [best[steps[p, i]]]]
            new[p] = min(choices)
        best = closed(new)
    return best["0"]


def test_long_spans_against_a_walk_over_rows():
    rng = random.Random(3)
    for n in (1, 7, 8, 9, 40, 333):
        for _ in range(20):
            symbols = "".join(rng.choices("suaxSUAXD", [1, 9, 9, 1, 1, 2, 2, 1, 2], k=n))
            assert repair.cheapest(repair.span(symbols)) == backwards(symbols)


def test_a_span_may_be_cut_anywhere():
    symbols = "uuaDaxUAsu"
    for k in range(1, len(symbols)):
        joined = repair.combine(repair.span(symbols[:k]), repair.span(symbols[k:]))
        assert joined == repair.span(symbols)


def brute(rows, originals):
    out = {}
    by_conv = {c: [] for c in originals}
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] and role[:1] in "sua" else "x"
            symbols += "D" if fault in (0, 1) else initial.upper() if fault == 2 else initial
            if fault is not None:
                counts[fault] += 1
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = backwards(symbols)
        length, lines, k = len(audit.replace("D", "")), [], 0
        order = (["system"] if length % 2 else []) + ["user", "assistant"] * (length // 2)
        for op in audit:
            row = None if op == "I" else own[k]
            k += op != "I"
            if op != "D":
                role = row[1] if op == "K" else order[len(lines)]
                lines.append(f"{role}:{row[2] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def answers(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in found.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["One.", "Two!", "three", " ", "", None, "Four? ", "five\n", "é…", "Six.\x0b"]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, 3, None]),
                         rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)))
    # One conversation holds a third of all rows; one row of it comes very often.
    rows += [(7, k // 2, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(300)] + [(7, 5, "user", "hot text")] * 200
    rows += [(8, 1, "user", "word " * 100_000)]
    return rows


def test_conversations_against_brute_force(spark, rows):
    found = answers(repair.assessed(frame(spark, rows, 7)))
    assert found == brute(rows, {r[0] for r in rows})


def test_long_conversations_are_spread_over_tasks(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = repair.runs(repair.faults(repair.cleaned(frame(spark, rows)))).where("conv_id = 7").count()
        assert spread > 1
        assert answers(repair.assessed(frame(spark, rows))) == brute(rows, {r[0] for r in rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage(spark, rows):
    table = frame(spark, rows)
    expected = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        expected += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = [tuple(r) for r in repair.damaged(table).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    found = answers(repair.assessed(table, repair.damaged(table)))
    assert found == brute(expected, {r[0] for r in rows})


def test_repaired_rows_are_legal(spark, rows):
    out = {}
    for r in repair.repaired(frame(spark, rows)).collect():
        out.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.edit, r.turn))
    for conv, own in out.items():
        own.sort()
        assert [r[0] for r in own] == list(range(len(own)))
        assert legal("".join(r[1][:1] for r in own)), conv
        assert all(r[2] == "" and r[4] is None for r in own if r[3] == "I")


def test_no_rows(spark):
    none = frame(spark, [], 1)
    assert repair.assessed(none).count() == 0 and repair.repaired(none).count() == 0
