"""Filters, projections, grouping, running reductions, key distribution, upserts and joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import BASES, NAMES, expression, text


def project(df: DataFrame, *expressions: str) -> DataFrame:
    return df.selectExpr(*expressions)


def keep(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is true; null drops a row."""
    return df.where(predicate)


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function over column batches; a narrow step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)


def key_by(df: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """Rows of a key in one partition; grouping and windows by the same keys then need no other shuffle."""
    if not keys:
        raise ValueError("key_by needs a key")
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def distribute(df: DataFrame, how: str, partitions: int, *keys: str) -> DataFrame:
    """hash, round_robin, broadcast or forward."""
    if how == "hash":
        return key_by(df, *keys, partitions=partitions)
    if how == "round_robin":
        return df.repartition(partitions)
    if how == "broadcast":
        return F.broadcast(df)
    if how == "forward":
        return df
    raise ValueError(f"unknown distribution {how!r}")


def aggregate(df: DataFrame, keys: list[str], **features: tuple) -> DataFrame:
    """GROUP BY with standard and custom aggregates: name=(function, arg, ...).

    Custom aggregates are worked out by category (or value) first and then by
    key, so that no task holds the rows of a group: memory grows with the
    categories of a key. Each is joined to the others by key.
    """
    plain = {n: f for n, f in features.items() if f[0] not in NAMES or ("cate" not in f[0] and f[0].endswith("_where"))}
    columns = []
    for name, (function, *args) in plain.items():
        sql = expression(function, args) if function in NAMES else f"{function}({', '.join(args) or '*'})"
        columns.append(F.expr(sql).alias(name))
    out = df.groupBy(*keys).agg(*(columns or [F.count(F.lit(1)).alias("__all")]))
    for name, (function, *args) in features.items():
        if name in plain:
            continue
        part = _by_category(df, keys, function, args).withColumnsRenamed({k: f"__{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        empty = F.lit(0.0) if function == "top1_ratio" else F.lit("")
        out = out.join(part, same, "left").withColumn(name, F.coalesce("__f", empty)).drop("__f", *(f"__{k}" for k in keys))
    return out.select(*keys, *features)


def _by_category(df: DataFrame, keys: list[str], function: str, args: list[str]) -> DataFrame:
    """(keys, __f): the aggregate ``function`` in two stages."""
    named = [F.col(k) for k in keys]
    if function == "top":
        value, n = args
        rows = df.select(*named, F.expr(value).alias("__v")).where("__v IS NOT NULL")
        first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__v")))).where(f"__r <= CAST({n} AS INT)")
        listed = F.sort_array(F.collect_list("__v"), asc=False)
        return first.groupBy(*keys).agg(listed.alias("__l")).select(*named, F.expr(f"array_join(transform(__l, x -> {text('x')}), ',')").alias("__f"))
    if function in ("topn_frequency", "top1_ratio"):
        counted = df.select(*named, F.expr(args[0]).alias("d")).where("d IS NOT NULL").groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("c"))
        ranked = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("c", "d")), asc=False).alias("__l"), F.sum("c").alias("__n"))
        made = "CAST(__l[0].c AS DOUBLE) / __n" if function == "top1_ratio" else f"array_join(transform(slice(__l, 1, CAST({args[1]} AS INT)), x -> {text('x.d')}), ',')"
        return ranked.select(*named, F.expr(made).alias("__f"))
    ratio, top = function.endswith("ratio_cate"), function.startswith("top_n_")
    base = next(b for b in ("ratio", *BASES) if b in function.split("_"))
    value, cond, cate = (args[0], "true", args[1]) if function == f"{base}_cate" else args[:3]
    rows = df.select(*named, F.expr(value).alias("__v"), F.coalesce(F.expr(cond), F.lit(False)).alias("__c"), F.expr(cate).alias("k")).where("k IS NOT NULL")
    rows = rows.where("__v IS NOT NULL") if ratio else rows.where("__c")
    metric = F.avg(F.col("__c").cast("double")) if ratio else F.expr(f"{base}(__v)")
    pairs = rows.groupBy(*keys, "k").agg(metric.alias("m")).where("m IS NOT NULL")
    pair = f"concat({text('p.k')}, ':', {text('p.m')})"
    if not top:
        return pairs.groupBy(*keys).agg(F.collect_list(F.struct("k", "m")).alias("__l")).select(*named, F.expr(f"array_join(array_sort(transform(__l, p -> {pair})), ',')").alias("__f"))
    order = F.struct("m", "k") if "_value_" in function else F.struct("k", "m")
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(order), asc=False).alias("__l")).select(*named, F.expr(f"array_join(transform(slice(__l, 1, CAST({args[3]} AS INT)), p -> {pair}), ',')").alias("__f"))


REDUCTIONS = ("min", "max", "sum", "count", "average")


def reduce_by(df: DataFrame, keys: list[str], value: str, results: tuple[str, ...] = REDUCTIONS) -> DataFrame:
    """min, max, sum, count and average of a column as a double; count counts all rows, average of none is 0.

    A value that is no number counts as a row only. On a stream, write in update
    mode to see the running results.
    """
    number = F.expr(f"try_cast({value} AS DOUBLE)")
    made = {
        "min": F.coalesce(F.min(number), F.lit(float("inf"))),
        "max": F.coalesce(F.max(number), F.lit(float("-inf"))),
        "sum": F.coalesce(F.sum(number), F.lit(0.0)),
        "count": F.count(F.lit(1)),
        "average": F.coalesce(F.sum(number), F.lit(0.0)) / F.count(F.lit(1)),
    }
    return df.groupBy(*keys).agg(*(made[r].alias(r) for r in results))


def upsert_latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in ``order``: a keyed upsert of a bounded input, pre-aggregated before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before_s: int, how: str = "inner") -> DataFrame:
    """Rows of ``right`` at most ``before_s`` seconds before those of ``left``; works on two watermarked streams as well."""
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    on = (F.col(left_time) >= F.col(f"r_{right_time}")) & (F.col(left_time) <= F.col(f"r_{right_time}") + F.expr(f"INTERVAL {before_s} SECONDS"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return left.join(other, on, how)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the latest ``values`` of ``right`` at or before its time: one shuffle, one sort, no pairs."""
    a = left.select("*", *(F.lit(None).cast(dict(right.dtypes)[v]).alias(f"_{v}") for v in values), F.lit(1).alias("_side"))
    b = right.select(*(F.col(c) if c in (*keys, time) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), *(F.col(v).alias(f"_{v}") for v in values), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    carried = F.last(F.when(F.col("_side") == 0, F.struct(*(f"_{v}" for v in values))), ignorenulls=True).over(w)
    return both.withColumn("_r", carried).where("_side = 1").select(*left.columns, *(F.col(f"_r._{v}").alias(f"asof_{v}") for v in values))


def late_split(df: DataFrame, arrival: str, time: str, out_of_orderness_us: int) -> DataFrame:
    """``df`` with ``accepted``: what a watermark of the largest time so far less ``out_of_orderness_us`` lets in.

    A replay of arrival order: rows of one ``arrival`` number are one batch, and
    a batch meets the watermark that the batches before it left. Batches are
    reduced to one row each before the running maximum.
    """
    from .window import micros

    stamp = micros(F.col(time), dict(df.dtypes)[time])
    batches = df.groupBy(arrival).agg(F.max(stamp).alias("_max"))
    before = Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    marks = batches.select(arrival, (F.max("_max").over(before) - out_of_orderness_us).alias("_wm"))
    return df.join(marks, arrival).withColumn("accepted", F.coalesce(stamp > F.col("_wm"), F.lit(True))).drop("_wm")
