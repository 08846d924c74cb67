"""Running state over unbounded histories without one task per history.

A side, a place or the whole league can own a large share of all rows, so a
plain ``Window.partitionBy(entity)`` would put that share into one task. The
order used everywhere is (day, id), which splits each history into days:

1. partial sums per (entity, day) - map-side combined, tiny after the shuffle;
2. a running total over the *days* of an entity (at most one row per calendar
   day, so the window is bounded by the calendar and not by the data);
3. a running total inside each (entity, day), added to the carried total.

Rolling "last n" frames use the position of a row in its history, cut into
fixed-size chunks, with the last n rows of a chunk copied into the next one.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorebook.session import ensure_checkpoint_dir

# Rows of one history handled by one window group.
CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Running:
    """Running values of one history: ``keys`` may be empty for "everything"."""

    keys: list[str]
    sums: dict[str, Column] = field(default_factory=dict)
    maxes: dict[str, Column] = field(default_factory=dict)


def shared(df: DataFrame) -> DataFrame:
    """Materialise a frame that one job reads several times.

    The rows go to Parquet in the checkpoint folder the cluster names, so they survive
    lost executors, are computed once, the plans built on top stay small, and each of
    them reads only its columns. What Parquet has no form for is checkpointed as rows.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if not _fits_parquet(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fits_parquet(schema: StructType) -> bool:
    """Whether columns have names of their own and types that Parquet stores."""
    names = [name.lower() for name in schema.names]
    return 0 < len(names) == len(set(names)) and not re.search(r"\b(void|interval)\b", schema.simpleString())


def running(
    df: DataFrame,
    specs: list[Running],
    day: str = "match_date",
    order: tuple[str, ...] = ("match_id",),
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums and maxima over (day, order), strictly before each row
    (or up to and including it).

    All carried totals are computed from ``df`` itself, never from the widened
    frame, so ``df`` is read once per spec plus once: pass a :func:`shared` frame
    unless it is a plain scan.
    """
    end = 0 if inclusive else -1
    out = df
    for index, spec in enumerate(specs):
        names = list(spec.sums) + list(spec.maxes)
        carried = {name: f"__carry_{index}_{name}" for name in names}
        key_aliases = [f"__key_{index}_{i}" for i in range(len(spec.keys))]
        day_alias = f"__day_{index}"
        per_day = df.groupBy(
            *[F.col(k).alias(a) for k, a in zip(spec.keys, key_aliases)],
            F.col(day).alias(day_alias),
        ).agg(
            *[F.sum(c).alias(n) for n, c in spec.sums.items()],
            *[F.max(c).alias(n) for n, c in spec.maxes.items()],
        )
        days = (
            Window.partitionBy(*key_aliases)
            .orderBy(day_alias)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_day.select(
            *key_aliases,
            day_alias,
            *[F.sum(n).over(days).alias(carried[n]) for n in spec.sums],
            *[F.max(n).over(days).alias(carried[n]) for n in spec.maxes],
        )
        condition = reduce(
            lambda left, right: left & right,
            [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(spec.keys, key_aliases)],
            F.col(day).eqNullSafe(F.col(day_alias)),
        )
        inside = (
            Window.partitionBy(*spec.keys, day)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, end)
        )
        out = out.join(carry, condition, "left")
        out = out.withColumns(
            {
                **{
                    n: F.coalesce(F.col(carried[n]), F.lit(0))
                    + F.coalesce(F.sum(c).over(inside), F.lit(0))
                    for n, c in spec.sums.items()
                },
                **{
                    n: F.greatest(F.col(carried[n]), F.max(c).over(inside))
                    for n, c in spec.maxes.items()
                },
            }
        ).drop(*key_aliases, day_alias, *carried.values())
    return out


def in_order(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    split_rows: int | None = None,
) -> DataFrame:
    """Running sums up to and including each row of a group ordered by a dense
    integer.

    A group that is small by its nature (an innings) is one window, which reuses
    the partitioning of its key. ``split_rows`` is for feeds where nothing bounds
    a group: it is then cut into runs of that many rows and totals are carried
    from run to run, so the largest group is spread over the cluster.
    """
    if split_rows is None:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    run = F.floor(F.col(order) / F.lit(split_rows)).cast("long")
    return running(
        shared(df.withColumn("__run", run)), [Running(keys, sums)], day="__run", order=(order,),
        inclusive=True,
    ).drop("__run")


def rolling_before(
    df: DataFrame,
    keys: list[str],
    position: str,
    frames: dict[str, tuple[Column, int]],
    chunk_rows: int = CHUNK_ROWS,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``<name>_sum`` and ``<name>_n`` over the last n entries of a history.

    ``position`` counts the entries before a row; an entry carries a non-null
    value and a row that is no entry carries null. The result depends on the
    position alone, so rows are first reduced to one per (keys, position): a
    history with any number of rows that are no entries still has windows of at
    most ``chunk_rows`` plus n rows. The states then join back by position.
    """
    widest = max(n for _, n in frames.values())
    if widest >= chunk_rows:
        raise ValueError("a rolling frame must be shorter than a chunk")
    chunk = F.floor(F.col("__place") / F.lit(chunk_rows)).cast("long")
    near_end = F.col("__place") % chunk_rows >= chunk_rows - widest
    aliases = [f"__key_{i}" for i in range(len(keys))]
    steps = df.groupBy(
        *[F.col(c).alias(a) for c, a in zip(keys, aliases)], F.col(position).cast("long").alias("__place")
    ).agg(
        *[F.sum(value).alias(f"__sum_{name}") for name, (value, _) in frames.items()],
        *[F.count(value).alias(f"__n_{name}") for name, (value, _) in frames.items()],
    )
    spread = steps.withColumn(
        "__chunk",
        F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
    ).withColumn("__copied", F.col("__chunk") != chunk)
    columns = {}
    for name, (_, n) in frames.items():
        lower, upper = (-(n - 1), 0) if inclusive else (-n, -1)
        frame = Window.partitionBy(*aliases, "__chunk").orderBy("__place").rangeBetween(lower, upper)
        columns[f"{name}_sum"] = F.sum(f"__sum_{name}").over(frame)
        columns[f"{name}_n"] = F.coalesce(F.sum(f"__n_{name}").over(frame), F.lit(0))
    states = spread.withColumns(columns).where(~F.col("__copied")).select(*aliases, "__place", *columns)
    condition = reduce(
        lambda left, right: left & right,
        [F.col(c).eqNullSafe(F.col(a)) for c, a in zip(keys, aliases)],
        F.col(position).cast("long") == F.col("__place"),
    )
    return df.join(states, condition, "left").drop(*aliases, "__place")
