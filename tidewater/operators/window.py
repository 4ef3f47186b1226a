"""Per-row sliding windows over event time, with exact order among equal times.

A row's frame holds the rows of its key from ``length`` before its time
(inclusive) up to the row itself in the order of (time, sequence): of rows at
one time, later ones are not seen. Spark's RANGE frames include all peers, so
rows are ordered by one whole number made of the time in microseconds and the
rank among peers; twice the room that ranks take keeps all peers at the far edge
in, and all rows a microsecond earlier out. The number is a decimal of 38 digits:
any timestamp and 10**12 peers fit, and frames over it cost what they cost over
a long.

All windows of one call share one shuffle by key and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import NAMES, WINDOW_AGGREGATES, expression

#: Peers of a row, and what a microsecond counts in the order number.
MAX_TIES = 10**12
UNIT = 2 * MAX_TIES
CURSOR, SLICE = "__cursor", "__slice"


@dataclass(frozen=True)
class Feature:
    """``function`` of the SQL expressions ``args`` over the last ``length_us`` microseconds."""

    name: str
    function: str
    args: tuple[str, ...]
    length_us: int


def micros(time: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (read as UTC), or a number of milliseconds."""
    if kind in ("bigint", "int"):
        return time.cast("long") * 1000
    if kind == "timestamp_ntz":
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), time).cast("timestamp"))
    return F.unix_micros(time)


def with_cursor(df: DataFrame, keys: list[str], time: str, sequence: str | None, name: str = CURSOR) -> DataFrame:
    """``df``, dealt by ``keys``, with the order number ``name``; ``sequence`` None: times are unique within a key."""
    stamp = micros(F.col(time), dict(df.dtypes)[time])
    dealt = df.repartition(*keys) if keys else df
    if sequence is None:
        return dealt.withColumn(name, order_number(stamp, F.lit(0)))
    tie = F.row_number().over(Window.partitionBy(*keys, time).orderBy(sequence)) - 1
    return dealt.withColumn(name, order_number(stamp, tie))


def order_number(stamp: Column, tie: Column) -> Column:
    return (stamp.cast("decimal(20,0)") * F.lit(Decimal(UNIT)) + tie.cast("decimal(13,0)")).cast("decimal(38,0)")


def reach_text(length_us: int) -> str:
    """The frame's reach in order numbers: all peers at its far edge, nothing before them."""
    return f"CAST({length_us * UNIT + MAX_TIES - 1} AS DECIMAL(38,0))"


def frame_text(keys: list[str], length_us: int) -> str:
    by = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return f"({by}ORDER BY `{CURSOR}` RANGE BETWEEN {reach_text(length_us)} PRECEDING AND CURRENT ROW)"


def aggregate_text(function: str, args: list[str], over: str) -> str:
    if function in NAMES:
        return expression(function, args, over)
    if function not in WINDOW_AGGREGATES:
        raise ValueError(f"unsupported window aggregate {function!r}")
    return f"{function}({', '.join(args) or '*'}) OVER {over}"


def window_features(df: DataFrame, keys: list[str], time: str, features: list[Feature], sequence: str | None = None, slice_us: int | None = None) -> DataFrame:
    """All input columns, then one column per feature, one row per input row.

    A null time has no place in any frame: such rows are left out.

    With ``slice_us``, at least the longest window, a key is cut into slices of
    time that different tasks take: each row goes to its own slice and, as
    history only, to the next. Rows are shuffled twice for that, and a key that
    holds a third of all rows no longer lands in one task.
    """
    rows = df.where(F.col(time).isNotNull())
    by = list(keys)
    if slice_us is not None:
        if slice_us < max(f.length_us for f in features):
            raise ValueError("a slice is shorter than the longest window")
        own = F.floor(micros(F.col(time), dict(df.dtypes)[time]) / slice_us)
        rows = rows.withColumn("__own", own).withColumn(SLICE, F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
        by.append(SLICE)
    placed = with_cursor(rows, by, time, sequence)
    columns = [F.expr(aggregate_text(f.function, list(f.args), frame_text(by, f.length_us))).alias(f.name) for f in features]
    out = placed.select("*", *columns)
    return (out.where(F.col(SLICE) == F.col("__own")) if slice_us is not None else out).drop(CURSOR, SLICE, "__own")
