"""Live state of chases: arbitrary state per contest, balls in any order, innings that end.

The state of a contest holds what its two innings have delivered: the balls seen and the
runs of the first, and a compact entry for each ball of the second. An innings is bounded
by the rules of the contest, so the state is too. Keeping the entries rather than totals
makes the result independent of the order of arrival: a late ball moves the target or the
totals behind it, and a ball that comes again changes nothing.

Between the engine and the processor a ball, the kept balls and a state are one JSON text
each: decoding them value by value costs more than everything that is done with them.

A contest that has been silent for ``idle`` is closed by a timer: its last state is emitted
as ended, its balls are forgotten, and a mark that expires on its own keeps stragglers from
opening it again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorebook import constants as k
from scorebook.operators.inplay import CHASE_CATEGORICAL, CHASE_NUMERIC, RECENT_BALLS, decided, state_columns
from scorebook.session import ship_package

if TYPE_CHECKING:
    import pandas as pd

BALL = [
    "match_id", "innings_no", "ball_seq", "over_no", "batting_team", "bowling_team", "total_runs",
    "is_legal", "is_wicket",
]
#: The balls are lists of seq, over, runs, legal, wicket, in JSON as the seqs of the first innings are.
STATE = "first_seen string, first_runs long, balls string, batting_team string, bowling_team string"
OUTPUT = (
    "match_id long, ball_seq int, over_no int, batting_team string, bowling_team string, target long, "
    "current_runs long, wickets_fallen long, balls_bowled long, runs_last_5_overs long, "
    "wickets_last_5_overs long, is_ended boolean"
)
NAMES = [column.split()[0] for column in OUTPUT.split(", ")]
#: A state as the processor returns it, and a ball as it gets it: JSON of OUTPUT and of BALL.
RETURNED, BALL_TEXT, HEARD = "match_id long, state string", "ball", "heard_ms"
#: State store that arbitrary state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Innings:
    """Both innings of one contest as the state keeps them."""

    def __init__(self, stored: tuple | None) -> None:
        seen, self.first_runs, balls, self.batting, self.bowling = stored or ("[]", 0, "[]", None, None)
        self.first_seen = set(json.loads(seen))
        self.balls = {seq: tuple(ball) for seq, *ball in json.loads(balls)}
        self._earliest = min(self.balls, default=None)

    def add(self, row: Row | dict) -> bool:
        """Whether the ball is new."""
        seq = row["ball_seq"]
        if row["innings_no"] == 1:
            if seq in self.first_seen:
                return False
            self.first_seen.add(seq)
            self.first_runs += row["total_runs"] or 0
            return True
        if row["innings_no"] != 2 or seq in self.balls:
            return False
        if not self.balls or seq < self._earliest:
            self._earliest, self.batting, self.bowling = seq, row["batting_team"], row["bowling_team"]
        self.balls[seq] = (row["over_no"], row["total_runs"] or 0, int(bool(row["is_legal"])), int(bool(row["is_wicket"])))
        return True

    def stored(self) -> tuple:
        balls = [(seq, *ball) for seq, ball in sorted(self.balls.items())]
        return (json.dumps(sorted(self.first_seen)), self.first_runs, json.dumps(balls), self.batting, self.bowling)

    def last_open(self, match_id: int, ended: bool) -> Row:
        """The state after the last ball at which the chase is open; without one all is null."""
        row: list = [None] * 10
        target = self.first_runs + 1
        if self.first_seen and self.batting is not None:
            runs = wickets = legal = 0
            totals: list[tuple[int, int]] = []
            for seq, (over, scored, counts, out) in sorted(self.balls.items()):
                runs, wickets, legal = runs + scored, wickets + out, legal + counts
                if runs >= target or wickets >= k.MAX_WICKETS:
                    break
                totals.append((runs, wickets))
                # Up to RECENT_BALLS balls before this one, the first ball being the earliest.
                base = totals[max(0, len(totals) - 1 - RECENT_BALLS)]
                row = [seq, over, self.batting, self.bowling, target, runs, wickets, legal, runs - base[0], wickets - base[1]]
        return Row(**dict(zip(NAMES, (match_id, *row, ended))))


def returned(row: Row) -> pd.DataFrame:
    """A state as one row of RETURNED."""
    import pandas as pd

    return pd.DataFrame({"match_id": [row["match_id"]], "state": [json.dumps(row.asDict())]})


class LiveChase(StatefulProcessor):
    """State handling of one contest; ``idle_ms`` of silence ends it."""

    def __init__(self, idle_ms: int, event_time: str | None, remembered_ms: int) -> None:
        self._idle_ms, self._event_time, self._remembered_ms = idle_ms, event_time, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("innings", STATE)
        # A lifetime is only for processing time; with event time the watermark drops stragglers.
        self._ended = None if self._event_time else handle.getValueState("ended", "ended boolean", self._remembered_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._ended is not None and self._ended.exists():
            return
        innings = Innings(self._state.get() if self._state.exists() else None)
        changed, heard = False, 0
        for some in rows:
            for ball in json.loads(f"[{','.join(some[BALL_TEXT].tolist())}]"):
                changed |= innings.add(ball)
                if self._event_time:
                    heard = max(heard, ball[HEARD])
        if changed:
            self._state.update(innings.stored())
            yield returned(innings.last_open(int(key[0]), False))
        end = self._idle_ms + (heard if self._event_time else timerValues.getCurrentProcessingTimeInMs())
        timers = list(self._handle.listTimers())
        if all(timer < end for timer in timers):
            for timer in timers:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._state.exists():
            yield returned(Innings(self._state.get()).last_open(int(key[0]), True))
            self._state.clear()
        if self._ended is not None:
            self._ended.update((True,))

    def close(self) -> None:
        pass


def chase_states(
    events: DataFrame, event_time: str | None = None, late: str = "1 day",
    idle: timedelta = timedelta(hours=12), remembered: timedelta = timedelta(days=7),
) -> DataFrame:
    """A stream of the states of chases, one row for each contest that a batch changes.

    With an event time, silence is measured by the watermark, ``late`` behind the newest
    event; without one, by the clock. By the clock a query always has a next batch, in
    which timers may end, so it is for jobs that run on and not for one pass over files.
    """
    spark = events.sparkSession
    ship_package(spark)
    # The engine drops late balls by the event time itself, so it stays a column.
    known = events.where(F.col("match_id").isNotNull())
    timed, heard = [], []
    if event_time:
        known = known.where(F.col(event_time).isNotNull())
        timed, heard = [event_time], [F.unix_millis(event_time).alias(HEARD)]
    text = F.to_json(F.struct(*BALL[1:], *heard), {"ignoreNullFields": "false"})
    balls = known.select(F.col("match_id").cast("long").alias("match_id"), *timed, text.alias(BALL_TEXT))
    if event_time:
        balls = balls.withWatermark(event_time, late)
    processor = LiveChase(
        int(idle.total_seconds() * 1000), event_time, int(remembered.total_seconds() * 1000))
    states = balls.groupBy("match_id").transformWithStateInPandas(
        processor, RETURNED, "Update", "EventTime" if event_time else "ProcessingTime")
    return states.select(F.from_json("state", OUTPUT).alias("state")).select("state.*")


def live_features(states: DataFrame, contests: DataFrame, digits: int | None = 3) -> DataFrame:
    """The feature rows of published states, as :func:`inplay.chase_features` has them after the same ball."""
    known = states.where(F.col("ball_seq").isNotNull())
    return state_columns(known.join(decided(contests), "match_id"), digits).select(
        "match_id", "ball_seq", "season", "match_date", *CHASE_CATEGORICAL, *CHASE_NUMERIC)
