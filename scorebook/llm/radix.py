"""Least-significant-digit radix sort of rows that Spark holds in many partitions.

The key is composed of integer columns. Its bits are cut into digits of at most DIGIT
bits, and each pass is a stable counting sort by one digit, least significant first:

* rows stand at places; BLOCK consecutive places are a block;
* a count for each (block, digit) and its exclusive prefix sum over all (digit, block)
  gives the first place of the block's rows of that digit;
* a row's new place is that plus its rank among the rows of its block and digit.

No group grows with the input: a block's rows of a digit are at most BLOCK, prefix sums
run over SPAN blocks, then over the spans of a digit, then over the digits. A digit that
all rows share is spread over its blocks. Each pass writes its rows to the shared
checkpoint folder, so a lost executor repeats one pass.

Defined cases: null keys stand last; rows of equal keys keep the order they had; no rows
give no rows; a key that is equal everywhere needs no pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

#: Most bits of a digit, bits of a place inside its block, and bits of a block inside its span.
DIGIT, BLOCK, SPAN = 12, 16, 12
SIGN = -(1 << 63)


def key_parts(rows: DataFrame, order: list[tuple[str, bool]]) -> tuple[list[tuple[Column, int]], int]:
    """(unsigned value, bits) of each key column, least significant first, and the number of rows.

    `order` lists (column, ascending), most significant first.
    """
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(f(F.col(c)).alias(f"{stem}{i}") for i, (c, _) in enumerate(order)
          for stem, f in (("low", F.min), ("high", F.max), ("some", F.count))),
    ).first()
    parts: list[tuple[Column, int]] = []
    for i, (name, ascending) in reversed(list(enumerate(order))):
        low, high = seen[f"low{i}"], seen[f"high{i}"]
        if low is None:
            continue
        value = F.col(name).cast("long")
        if high - low < 1 << 63:
            value, bits = value - F.lit(low) if ascending else F.lit(high) - value, (high - low).bit_length()
        else:
            value, bits = value.bitwiseXOR(F.lit(SIGN)), 64
            value = value if ascending else F.bitwise_not(value)
        parts.append((F.coalesce(value, F.lit(0)), bits))
        if seen[f"some{i}"] < seen["n"]:
            parts.append((F.col(name).isNull().cast("long"), 1))
    return [part for part in parts if part[1]], seen["n"]


def digits(parts: list[tuple[Column, int]]) -> list[Column]:
    """The digits of the composed key, least significant first, as few and as narrow as DIGIT allows."""
    total = sum(bits for _, bits in parts)
    passes = -(-total // DIGIT)
    found = []
    for k in range(passes):
        start, end = k * total // passes, (k + 1) * total // passes
        digit, at = F.lit(0).cast("long"), 0
        for value, bits in parts:
            low, high = max(start, at), min(end, at + bits)
            if low < high:
                piece = F.shiftrightunsigned(value, low - at).bitwiseAND(F.lit((1 << (high - low)) - 1))
                digit = digit.bitwiseOR(F.shiftleft(piece, low - start))
            at += bits
        found.append(digit.cast("int"))
    return found


def first_places(counts: DataFrame) -> DataFrame:
    """block, digit, first: the place where the rows of each (block, digit) begin."""

    def before(group: list[str], order: str, what: str) -> Column:
        window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(window), F.lit(0))

    spanned = counts.withColumn("span", F.shiftright("block", SPAN))
    spans = spanned.groupBy("digit", "span").agg(F.sum("n").alias("n"))
    # At most 2**DIGIT rows.
    totals = spans.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", before([], "digit", "n").alias("of_digit"))
    of_spans = spans.select("digit", "span", before(["digit"], "span", "n").alias("of_span"))
    of_blocks = spanned.select("digit", "span", "block", before(["digit", "span"], "block", "n").alias("of_block"))
    return of_blocks.join(of_spans, ["digit", "span"]).join(totals, "digit").select(
        "block", "digit", (F.col("of_digit") + F.col("of_span") + F.col("of_block")).alias("first"))


def counting_pass(rows: DataFrame, place: str, digit: Column) -> DataFrame:
    """The rows with the places that a stable sort by `digit` gives them."""
    columns = [c for c in rows.columns if c != place]
    # Own names, so that the caller's columns cannot clash.
    kept = F.struct(*(rows[c].alias(f"c{i}") for i, c in enumerate(columns))).alias("kept")
    laid = rows.select(F.col(place).alias("place"), digit.alias("digit"), F.shiftright(place, BLOCK).alias("block"), kept)
    rank = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    ranked = laid.select("block", "digit", "kept", rank.alias("rank"))
    firsts = first_places(laid.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))
    return ranked.join(firsts, ["block", "digit"]).select(
        *(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(columns)), (F.col("first") + F.col("rank")).alias(place))


def radix_sort(rows: DataFrame, order: list[tuple[str, bool]], place: str = "place") -> tuple[DataFrame, int]:
    """The rows with their 0-based place in the order, and their number.

    `order` lists integer columns as (name, ascending), most significant first.
    """
    place_ = free_name(rows, "place")
    # Written once, so that the first places are the same for every later reader.
    current = cut(rows.withColumn(place_, F.monotonically_increasing_id()))
    parts, n = key_parts(current, order)
    # A pass by a constant digit still turns the first places into 0, 1, 2 ...
    for digit in digits(parts) or [F.lit(0)]:
        current = cut(counting_pass(current, place_, digit))
    return current.withColumnRenamed(place_, place), n
