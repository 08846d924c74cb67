"""Repair of conversation structure by weighted CYK interval parsing.

A conversation is legal if the initials of its roles spell `(s?(ua)+)?`. Rows may be kept,
given another role, deleted, and empty rows may be inserted anywhere, each at a cost. The
grammar is in Chomsky normal form: a nonterminal [p,q] stands for all that leads the legal
order from state p to state q, its rules are

    [p,q] -> [p,r] [r,q]        and        [p,q] -> one edited row.

The insertion closure lets every nonterminal also derive rows that are not there: it stands
before each row and at the end. The cell of a span and a nonterminal is its least (cost,
audit), audit being the initials of the edits. Cells are combined bottom-up, spans of one row
first, then twice as long each time. Every derivation of [p,q] passes some state at every
point of its span, so that one point a span, with all states there, is enough.

Two audits of one cell and cost are never prefixes of each other (the rows of the span are
the same and each further insertion costs), so the least audits of two halves make the least
audit of the whole.

Conversations of any length are spread over tasks: rows are sorted by (conversation, turn)
over range partitions, each task reduces the run of a conversation that it holds to its
cells, and the cells of the runs are combined. Texts take part only as digests until the
audit is known; then they are read in order, one at a time, and carried into the output.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn
are ordered by role, then by the digest of their text, so that equal rows are neighbours; a
role of another initial than s, u, a can only be changed or deleted; rows without a
conversation id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: States of the legal order: 0 nothing yet, then the initial of the last row.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
LEGAL_PAIRS = {"su", "ua", "au"}
#: Spans up to this length are remembered by their rows.
REMEMBERED = 8

Cell = dict[tuple[int, int], tuple[int, str]]
ORDER = ["turn", "role", "digest"]


def lesser(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """The cells of two neighbouring spans as one: [p,q] -> [p,r] [r,q]."""
    found: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (r, q) in right:
                more, rest = right[r, q]
                lesser(found, (p, q), (cost + more, audit + rest))
    return found


def insertion_closure() -> Cell:
    """The cheapest insertions that lead from state to state over no row at all."""
    found: Cell = {(p, p): (0, "") for p in STATES}
    one: Cell = {(p, q): (INSERT, "I") for (p, initial), q in STEPS.items() if initial in ROLES}
    for _ in STATES:
        longer = combine(found, one)
        for key, value in longer.items():
            lesser(found, key, value)
    return found


CLOSURE = insertion_closure()


def edited_row(symbol: str) -> Cell:
    """A row's edits. Symbols: s u a x (another initial), upper case if truncated, D to be deleted."""
    found: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if symbol == "D":
        return found
    extra = TRUNCATED if symbol.isupper() else 0
    for (p, initial), q in STEPS.items():
        if initial == symbol.lower():
            lesser(found, (p, q), (KEEP + extra, "K"))
        if initial in ROLES:
            lesser(found, (p, q), (REROLE + extra, "R"))
    return found


@lru_cache(1 << 14)
def short_span(symbols: str) -> Cell:
    if len(symbols) == 1:
        return combine(CLOSURE, edited_row(symbols))
    half = len(symbols) // 2
    return combine(short_span(symbols[:half]), short_span(symbols[half:]))


def span(symbols: str) -> Cell:
    """The cell of a run of rows, from spans of REMEMBERED rows upwards."""
    cells = [short_span(symbols[i : i + REMEMBERED]) for i in range(0, len(symbols), REMEMBERED)]
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the repaired conversation whose rows have this cell."""
    whole = combine(cell, CLOSURE)
    return min(whole[0, q] for q in FINAL if (0, q) in whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that crc32 of `conv_id:turn` modulo 20 names."""
    rows = cleaned(conversations)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = (F.crc32(name.cast("binary")) % 20).alias("code")
    return (
        rows.select("*", code).where("code != 0")
        .select(
            "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def cleaned(conversations: DataFrame) -> DataFrame:
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """One short row for each different (conversation, turn, role, text).

    `copies` counts its equal rows, `first` says whether the role and text come here for the first time.
    """
    stripped = F.rtrim("text", F.lit(WHITE))
    narrow = cut(
        rows.select(
            "conv_id", "turn", "role", text_digest(F.col("text")).alias("digest"), (stripped == "").alias("blank"),
            (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        ).groupBy("conv_id", *ORDER, "blank", "truncated").agg(F.count(F.lit(1)).alias("copies")))
    key = ["conv_id", "role", "digest"]
    # Only what occurs at several turns has a later occurrence.
    several = cut(
        narrow.groupBy(*key).agg(
            F.count(F.lit(1)).alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("start"))
        .where("turns > 1").select(*(F.col(c).alias(f"{c}_") for c in key), F.col("start.turn").alias("start_turn")))
    same = [narrow[c].eqNullSafe(several[f"{c}_"]) for c in key]
    first = F.col("digest_").isNull() | F.col("turn").eqNullSafe(F.col("start_turn"))
    return narrow.join(several, same, "left").select(*narrow.columns, first.alias("first"))


class Run:
    """What a task knows of the rows of one conversation that it has read in order."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.last = None
        self.symbols: list[str] = []

    def add(self, turn: int | None, role: str, blank: bool, truncated: bool, copies: int, first: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.last is None:
            self.head = initial
        else:
            self.illegal += self.last + initial not in LEGAL_PAIRS
        self.illegal += copies - 1
        self.last = initial
        if blank or not first:
            self.symbols.append("D" * copies)
            self.blank += copies if blank else 0
            self.duplicate += 0 if blank else copies
            return
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append((symbol.upper() if truncated else symbol) + "D" * (copies - 1))
        self.truncated += truncated
        self.duplicate += copies - 1

    def join(self, row: dict) -> None:
        """Counts of the run behind this one."""
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + row[name])
        if self.last is not None:
            self.illegal += self.last + row["head"] not in LEGAL_PAIRS
        self.last = row["last"]


def batches_of(columns: dict[str, pa.DataType], batches: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Dicts of one row each as batches of a thousand rows."""
    rows: list[dict] = []
    for row in batches:
        rows.append(row)
        if len(rows) == 1000:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(columns.items()))
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema(columns.items()))


COUNTS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]
RUN_ARROW = {
    "conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "digest": pa.binary(),
    **{c: pa.int64() for c in COUNTS}, "head": pa.string(), "last": pa.string(),
    "spans": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()),
}
RUN_SCHEMA = (
    "conv_id long, turn long, role string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS)
    + ", head string, last string, spans array<int>, costs array<long>, audits array<string>"
)


def runs(found: DataFrame) -> DataFrame:
    """The cells of each run of a conversation's rows that one task holds, under the run's first row."""
    ship(found.sparkSession)
    keys = ["conv_id", *ORDER]
    laid = found.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *keys, "blank", "truncated", "copies", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            start, now = None, Run()
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns)):
                    if start is None or start[0] != row[0]:
                        if start is not None:
                            yield closed(start, now)
                        start, now = row[:4], Run()
                    now.add(row[1], row[2], *row[4:])
            if start is not None:
                yield closed(start, now)

        yield from batches_of(RUN_ARROW, made())

    def closed(start: tuple, now: Run) -> dict:
        cell = span("".join(now.symbols))
        costs, audits = zip(*cell.values())
        return dict(zip(keys, start)) | {c: getattr(now, c) for c in (*COUNTS, "head", "last")} | {
            "spans": [4 * p + q for p, q in cell], "costs": costs, "audits": audits}

    return laid.mapInArrow(run, RUN_SCHEMA)


VERDICT_ARROW = {"conv_id": pa.int64(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
                 "audit": pa.string()}
VERDICT_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                  "audit string")


def verdicts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of `rows`."""
    keys = ["conv_id", *ORDER]
    laid = cut(runs(faults(rows))).repartition("conv_id").sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, cells, now = None, [], Run()
            for batch in batches:
                for row in batch.to_pylist():
                    if cells and conv != row["conv_id"]:
                        yield closed(conv, cells, now)
                        cells, now = [], Run()
                    conv = row["conv_id"]
                    now.join(row)
                    cells.append({
                        divmod(at, 4): (cost, audit)
                        for at, cost, audit in zip(row["spans"], row["costs"], row["audits"])})
            if cells:
                yield closed(conv, cells, now)

        yield from batches_of(VERDICT_ARROW, made())

    def closed(conv: int | None, cells: list[Cell], now: Run) -> dict:
        while len(cells) > 1:
            pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
            cells = pairs + cells[len(pairs) * 2 :]
        cost, audit = cheapest(cells[0])
        gaps = 0 if now.low is None else min(now.high - now.low + 1 - now.turns, (1 << 63) - 1)
        return {"conv_id": conv, "gaps": gaps, "cost": cost, "audit": audit} | {
            c: getattr(now, c) for c in ("blank", "duplicate", "truncated", "illegal")}

    return laid.mapInArrow(run, VERDICT_SCHEMA)


def legal_role(place: int, length: int) -> str:
    """The initial of a row of a legal conversation of `length` rows."""
    place -= length % 2
    return "s" if place < 0 else "ua"[place % 2]


def repaired_rows(audit: str, rows: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple[int | None, str, str, str]]:
    """turn, role, text, edit of the repaired conversation; reads one row at a time."""
    length = len(audit) - audit.count("D")
    place = 0
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[legal_role(place, length)]
        place += 1
        yield turn, role, text, edit


#: What stands before the texts of a conversation: that it exists, then its verdict.
EXISTS, VERDICT, TEXT = 0, 1, 2


def read_in_order(
    conversations: DataFrame, rows: DataFrame, found: DataFrame,
    emit: Callable[[int | None, dict | None, Iterator], Iterator[dict]], arrow: dict[str, pa.DataType], schema: str,
) -> DataFrame:
    """`emit` for every conversation: id, verdict (None if no row is left) and its rows in order."""
    ship(rows.sparkSession)
    names = [c for c in VERDICT_ARROW if c != "conv_id"]
    exists = only(conversations, conv_id="conv_id").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    texts = rows.select("conv_id", F.lit(TEXT).alias("kind"), "turn", "role", text_digest(F.col("text")).alias("digest"), "text")
    every = texts.unionByName(exists.withColumn("kind", F.lit(EXISTS)), allowMissingColumns=True).unionByName(
        found.withColumn("kind", F.lit(VERDICT)), allowMissingColumns=True)
    laid = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select(
        "conv_id", "kind", "turn", "role", "text", *names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        def made() -> Iterator[dict]:
            rows = flat()
            held = next(rows, None)

            def texts() -> Iterator[tuple]:
                nonlocal held
                while held is not None and held[1] == TEXT:
                    row, held = held, next(rows, None)
                    yield row[2:5]

            while held is not None:
                conv, verdict = held[0], None
                held = next(rows, None)
                if held is not None and held[1] == VERDICT:
                    verdict, held = dict(zip(names, held[5:])), next(rows, None)
                own = texts()
                yield from emit(conv, verdict, own)
                for _ in own:  # rows behind the last edit that was read
                    pass

        yield from batches_of(arrow, made())

    return laid.mapInArrow(run, schema)


def repaired(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), turn (null: inserted), role, text, edit of the repaired conversations.

    `rows` are the rows to repair if they are not those of `conversations`.
    """
    rows = cleaned(conversations) if rows is None else rows

    def emit(conv: int | None, verdict: dict | None, texts: Iterator) -> Iterator[dict]:
        if verdict is not None:
            for place, (turn, role, text, edit) in enumerate(repaired_rows(verdict["audit"], texts)):
                yield {"conv_id": conv, "place": place, "turn": turn, "role": role, "text": text, "edit": edit}

    arrow = {"conv_id": pa.int64(), "place": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(),
             "edit": pa.string()}
    return read_in_order(conversations, rows, verdicts(rows), emit, arrow,
                         "conv_id long, place long, turn long, role string, text string, edit string")


def assessed(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The verdict of every conversation with the digest of its repaired `role:text` lines.

    A conversation of which `rows` has none gets zeros, an empty audit and the empty text's digest.
    """
    rows = cleaned(conversations) if rows is None else rows
    empty = {c: 0 for c in VERDICT_ARROW} | {"audit": ""}

    def emit(conv: int | None, verdict: dict | None, texts: Iterator) -> Iterator[dict]:
        verdict = verdict or empty
        sha = hashlib.sha256()
        for place, (_, role, text, _) in enumerate(repaired_rows(verdict["audit"], texts)):
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield verdict | {"conv_id": conv, "repaired_sha256": sha.hexdigest()}

    return read_in_order(conversations, rows, verdicts(rows), emit, VERDICT_ARROW | {"repaired_sha256": pa.string()},
                         VERDICT_SCHEMA + ", repaired_sha256 string")
