"""Live jobs: order and repetition of balls, ends of innings, published folders."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import Row

from scorebook.operators import inplay
from scorebook.session import ensure_checkpoint_dir, list_folders
from scorebook.streaming import chase, live


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/streaming-{uuid.uuid4().hex}"


def ball(innings_no, seq, runs, out=False, legal=True):
    sides = ("A", "B") if innings_no == 1 else ("B", "A")
    return Row(match_id=1, innings_no=innings_no, ball_seq=seq, over_no=(seq - 1) // 6 + 1, batting_team=sides[0],
               bowling_team=sides[1], total_runs=runs, is_legal=legal, is_wicket=out)


def walked(balls, target):
    """The last open state by a plain walk."""
    runs, wickets, legal, totals, last = 0, 0, 0, [], None
    for b in balls:
        runs, wickets, legal = runs + b.total_runs, wickets + b.is_wicket, legal + b.is_legal
        if runs >= target or wickets >= 10:
            break
        totals.append((runs, wickets))
        first = totals[max(0, len(totals) - 31)]
        last = (b.ball_seq, runs, wickets, legal, runs - first[0], wickets - first[1])
    return last


def test_order_and_repetition_do_not_matter():
    rng = random.Random(1)
    for _ in range(50):
        first = [ball(1, k, rng.choice([0, 1, 2, 4])) for k in range(1, rng.randrange(2, 40))]
        second = [ball(2, k, rng.choice([0, 1, 2, 4]), rng.random() < 0.1, rng.random() < 0.95) for k in range(1, rng.randrange(2, 80))]
        sent = [*first, *second, *rng.choices(first + second, k=30)]
        rng.shuffle(sent)
        stored = None
        for at in range(0, len(sent), 7):  # the state passes through its stored form between batches
            innings = chase.Innings(stored)
            for b in sent[at : at + 7]:
                innings.add(b)
            stored = innings.stored()
        target = sum(b.total_runs for b in first) + 1
        row = chase.Innings(stored).last_open(1, False)
        expected = walked(second, target)
        if expected is None:
            assert row.ball_seq is None
        else:
            assert (row.ball_seq, row.current_runs, row.wickets_fallen, row.balls_bowled, row.runs_last_5_overs,
                    row.wickets_last_5_overs) == expected and row.target == target


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, chase.STORE)
    yield
    spark.conf.set(name, before)


def test_silent_innings_end_and_stragglers_are_dropped(spark, events, contests, rocksdb):
    """Contest 1 falls silent when contest 2 goes on two days later; balls of contest 1 that
    come after that change nothing."""
    root = folder(spark)
    start = datetime.datetime(2023, 4, 1, 12)
    rows = [r.asDict() for r in events.where("match_id <= 2").collect()]
    for r in rows:
        r["event_time"] = start + datetime.timedelta(days=2 * (r["match_id"] - 1), hours=r["innings_no"], seconds=30 * r["ball_seq"])
    schema = events.schema.add("event_time", "timestamp")
    names = [f.name for f in schema]

    def arrive(some):
        spark.createDataFrame([tuple(r[n] for n in names) for r in some], schema).coalesce(1).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
        states = chase.chase_states(stream, "event_time", "1 hour", datetime.timedelta(hours=6))
        live.publish(states, root + "/out", root + "/checkpoint", keys=["match_id"]).awaitTermination(120)
        return {r.match_id: r for r in live.latest(spark, root + "/out", ["match_id"]).collect()}

    one, two = ([r for r in rows if r["match_id"] == m] for m in (1, 2))
    cut = len(one) - 40
    assert not arrive(one[:cut])[1].is_ended
    found = arrive(two)
    assert found[1].is_ended and not found[2].is_ended
    late = arrive(one[cut:])
    assert late[1] == found[1]
    rows_of = {r.match_id: r for r in chase.live_features(live.latest(spark, root + "/out", ["match_id"]), contests).collect()}
    expected = [r for r in inplay.chase_features(events, contests).where("match_id = 2").collect()]
    last = max(expected, key=lambda r: r.ball_seq)
    assert {c: rows_of[2][c] for c in rows_of[2].asDict()} == {c: last[c] for c in rows_of[2].asDict()}


def test_published_folders_stay_few(spark):
    root = folder(spark)
    for k in range(12):
        rows = spark.createDataFrame([(k % 5, 1, k), (k % 5, 2, 100 + k)], "match_id long, innings_no int, runs int")
        live.add_batch(rows, root, k, most_folders=3)
        live.add_batch(rows, root, k, most_folders=3)  # the batch is replayed
        assert len(live.published_folders(spark, root)) <= 3
    stored = [f for f in list_folders(spark, root) if "delta=" in f or "snapshot=" in f]
    assert len(stored) <= 6 and len(list_folders(spark, f"{root}/{live.POINTERS}")) == 2
    found = {(r.match_id, r.innings_no): r.runs for r in live.latest(spark, root).collect()}
    assert found == {(k % 5, i): k + (0 if i == 1 else 100) for k in range(7, 12) for i in (1, 2)}


def test_nothing_published(spark):
    with pytest.raises(ValueError):
        live.latest(spark, folder(spark))


def test_a_part_of_the_arrivals_has_files_by_its_rows(spark, sf_dir, monkeypatch):
    from oracles import stream_queries

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 2000)
    monkeypatch.setattr(stream_queries, "_folder", lambda _, root=folder(spark): root)
    few = {(r.match_id, r.innings_no): tuple(r) for r in live.scoreboard(stream_queries.td.events(spark, sf_dir).where("match_date IS NOT NULL")).collect()}
    found = {(r.match_id, r.innings_no): tuple(r) for r in stream_queries._z2(spark, sf_dir).collect()}
    files = spark.read.parquet(stream_queries._folder(spark) + "/arrivals").inputFiles()
    assert len(files) > 8 and found == few


class _Kept:
    """A value of the state, or its handle with timers, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        assert not any(isinstance(v, (list, tuple)) for v in value)  # each list would be converted value by value
        self.value = value

    def getValueState(self, *_):
        return self

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_balls_and_states_are_one_text_each():
    import json

    import pandas as pd

    kept, processor = _Kept(), chase.LiveChase(1000, "event_time", 0)
    processor.init(kept)
    first = [ball(1, k, 2) for k in range(1, 31)]
    second = [ball(2, k, None if k == 4 else k % 2, k == 7) for k in range(1, 21)]
    sent = [*second[10:], *first, *second[:10], *second[5:15]]

    def frames(some, at):
        texts = [json.dumps({**b.asDict(), chase.HEARD: at + i}) for i, b in enumerate(some)]
        return iter([pd.DataFrame({"match_id": 1, chase.BALL_TEXT: texts[k : k + 9]}) for k in range(0, len(texts), 9)])

    found = [json.loads(f["state"][0]) for f in processor.handleInputRows((1,), frames(sent[:25], 100), None)]
    assert kept.timers == {1124} and len(found) == 1
    found = [json.loads(f["state"][0]) for f in processor.handleInputRows((1,), frames(sent[25:], 500), None)]
    assert kept.timers == {1534} and len(found) == 1
    expected = walked([Row(**{**b.asDict(), "total_runs": b.total_runs or 0}) for b in second], 61)
    state = found[0]
    assert (state["ball_seq"], state["current_runs"], state["wickets_fallen"], state["balls_bowled"],
            state["runs_last_5_overs"], state["wickets_last_5_overs"]) == expected
    assert (state["match_id"], state["target"], state["batting_team"], state["is_ended"]) == (1, 61, "B", False)
    assert [*processor.handleInputRows((1,), frames(sent, 200), None)] == [] and kept.timers == {1534}


def test_the_keys_of_the_scoreboard_stay_on_disk(spark, monkeypatch):
    from oracles import stream_queries

    names = [f"spark.sql.streaming.stateStore.{name}" for name in ("providerClass", "rocksdb.boundedMemoryUsage")]
    before, seen = [spark.conf.get(name, None) for name in names], []

    class Query:
        def awaitTermination(self):
            seen.append([spark.conf.get(name, None) for name in names])

    monkeypatch.setattr(stream_queries, "_arrivals", lambda *_: None)
    monkeypatch.setattr(stream_queries.live, "scoreboard", lambda *_: None)
    monkeypatch.setattr(stream_queries.live, "publish", lambda *_: Query())
    monkeypatch.setattr(stream_queries.live, "latest", lambda *_: None)
    stream_queries._z2(spark, "")
    assert seen == [[chase.STORE, "true"]]
    assert [spark.conf.get(name, None) for name in names] == before
