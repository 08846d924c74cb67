import gzip
import hashlib
import json
import os
import uuid
import zlib

import pytest

from scorebook.llm import warc
from scorebook.llm.common import checkpoint_dir

SCHEMA = "page_id long, url string, html string, payload string, payload_digest string, first_id string, archive string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture()
def folder(spark):
    base = checkpoint_dir(spark).removeprefix("file://")
    path = f"{base}/warc-test-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


LONG = "<p>same page</p>" * 20
ROWS = [
    (1, "http://a.example/1", LONG), (2, "http://a.example/2", LONG), (3, None, LONG), (None, "http://n.example/", LONG),
    (4, "http://b.example/\r\nX-Bad: 1", "short"), (5, "http://b.example/", "short"), (6, "u", None), (7, "", ""),
    (8, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (9, "u", "line\r" * 40), (10, "u", "line\r\r\n" * 40),
    (11, "u", "ends so\r" * 20), (12, "u", "é𝔘 ß" * 50_000), (-13, "u", "x" * 3_000_000), (14, "u", "y" * 99), (15, "u", "y" * 99),
    (16, "u", "z" * 100), (17, "u", "z" * 100), (18, "u", "w" * 200), (18, "u", "w" * 200), (19, "u", "w" * 200),
]


def brute(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            old = first.get(body, "none")
            first[body] = i if old in ("none", None) else old if i is None else min(old, i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = body in first and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def answers(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=str)


def test_round_trip(spark):
    rows = ROWS + [(1000 + k, "http://hot.example/", "hot page " * 30) for k in range(300)]
    back = warc.round_trip(frame(spark, rows), with_payload=True).cache()
    assert answers(back) == brute(rows)
    read = back.collect()
    assert all(r.intact for r in read)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in read:
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    urls = {r.page_id: r.url for r in read}
    assert urls[3] is None and urls[4] == "http://b.example/%0D%0AX-Bad: 1"
    back.unpersist()


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [], 1)).count() == 0


def parts(folder, end):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(end))


def test_written_streams_are_one_member_and_normalised_ones_many(spark, folder):
    warc.write_archives(frame(spark, ROWS, 1), f"{folder}/in", archive_records=8)
    streams = parts(f"{folder}/in", ".gz")
    assert len(streams) >= len(ROWS) // 8
    for path in streams:
        inflater = zlib.decompressobj(31)
        inflater.decompress(open(path, "rb").read())
        assert inflater.eof and not inflater.unused_data
    counts = warc.normalise(spark, f"{folder}/in", f"{folder}/out")
    assert counts["records"] == len(ROWS) and counts["damaged"] == 0 and counts["archives"] == len(streams)
    plain = b"".join(gzip.open(p).read() for p in streams)
    archives = parts(f"{folder}/out", warc.ARCHIVE)
    assert sorted(b"".join(gzip.open(p).read() for p in archives)) == sorted(plain)
    assert counts["bytes"] == sum(os.path.getsize(p) for p in archives)
    for path in archives:  # each entry is one whole member, and they follow each other
        at = 0
        for line in open(path.removesuffix(warc.ARCHIVE) + warc.SIDECAR):
            entry = json.loads(line)
            assert entry["offset"] == at
            inflater = zlib.decompressobj(31)
            record = inflater.decompress(open(path, "rb").read()[at : at + entry["length"]])
            assert inflater.eof and not inflater.unused_data and record.startswith(b"WARC/1.1\r\n")
            at += entry["length"]
        assert at == os.path.getsize(path)


def test_a_second_attempt_writes_the_same(spark, folder):
    warc.write_archives(frame(spark, ROWS, 2), f"{folder}/in")
    seen = []
    for _ in range(2):
        warc.normalise(spark, f"{folder}/in", f"{folder}/out")
        seen.append({p: open(p, "rb").read() for p in parts(f"{folder}/out", "")})
    assert seen[0] == seen[1]


def test_foreign_archives(spark, folder):
    def made(body, length=None, kind=b"resource"):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %s\r\n\r\n" % (kind, b"%d" % len(body) if length is None else length) + body + b"\r\n\r\n"

    bodies = [b"", bytes(range(256)) * 30, b"\r", b"\r\n", b"\r\n\r\n", b"a\r\nb", b"\r\r\n\r"]
    whole = b"".join(map(made, bodies))
    os.makedirs(f"{folder}/in")
    with gzip.open(f"{folder}/in/good.warc.gz", "wb") as f:
        f.write(whole)
    with open(f"{folder}/in/members.warc.gz", "wb") as f:
        for body in bodies:
            f.write(gzip.compress(made(body)))
    with gzip.open(f"{folder}/in/bad.warc.gz", "wb") as f:
        f.write(made(b"first") + made(b"wrong length", b"5") + made(b"no length", b"") + made(b"last") + made(b"cut off", b"500"))
    counts = warc.normalise(spark, f"file://{folder}/in", f"file://{folder}/out")
    assert counts["archives"] == 3 and counts["records"] == 2 * len(bodies) + 2
    out = {os.path.basename(p).split("-")[0]: gzip.open(p).read() for p in parts(f"{folder}/out", warc.ARCHIVE)}
    assert out["good"] == out["members"] == whole
    assert out["bad"] == made(b"first") + made(b"last")
