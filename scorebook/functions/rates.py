"""Column expressions shared by the aggregations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, scale: int | float = 1) -> Column:
    """``numerator * scale / denominator`` as a double, null unless positive."""
    return F.when(
        denominator > 0,
        (numerator * F.lit(scale)).cast("double") / denominator.cast("double"),
    )


def rounded(value: Column, digits: int | None) -> Column:
    """Half-even rounding when ``digits`` is given, otherwise the exact value."""
    return value if digits is None else F.bround(value, digits)


def mean_of(value: Column) -> Column:
    """Mean of an integer column from its exact sum, so order cannot matter."""
    return ratio(F.sum(value), F.count(value))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_where(condition: Column) -> Column:
    return F.sum(flag(condition)).cast("long")


def phase_of(over_no: Column, powerplay: int, death_from: int) -> Column:
    return (
        F.when(over_no <= powerplay, F.lit("powerplay"))
        .when(over_no < death_from, F.lit("middle"))
        .otherwise(F.lit("death"))
    )


def over_notation(balls: Column, per_over: int = 6) -> Column:
    """Ball count as displayed overs: 118 -> 19.4."""
    balls = balls.cast("long")
    whole = F.floor(balls / F.lit(per_over)).cast("long")
    return ((whole * 10 + balls % per_over).cast("double") / F.lit(10.0))
