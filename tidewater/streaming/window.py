"""Per-row sliding windows on a stream: a row is emitted once the watermark reaches its time.

Rows of a key are kept by (time in microseconds, sequence) in a map state, with
the features' arguments and the columns to carry along, the latter as text. A row
whose time is not past the watermark is late and dropped.
Timers at the rows' times wake a key; the first that is due emits all rows the
watermark has passed, in order, each over the rows from ``length`` before it up
to itself, so that a key's state is read once a batch. State older than the
longest window and ``lateness`` behind the watermark is removed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.registry import NAMES, WINDOW_AGGREGATES
from ..operators.window import micros
from .evaluate import evaluate, result_type


@dataclass(frozen=True)
class StreamFeature:
    """``function`` of the columns ``args`` over the last ``length_ms``."""

    name: str
    function: str
    args: tuple[str, ...]
    length_ms: int


class SlidingWindows(StatefulProcessor):
    def __init__(self, keys: int, features: list[StreamFeature], values: dict[str, str], lateness_ms: int):
        self.features, self.values = features, values
        # Names of its own: those of the columns may be any, and a leading underscore is lost on the way to Python.
        self.names = [*(f"k{n}" for n in range(keys)), "tw_us", *(f"v{n}" for n in range(len(values))), *(f"f{n}" for n in range(len(features)))]
        self.reach_us = 1000 * (max(f.length_ms for f in features) + lateness_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "ts bigint, seq bigint", ", ".join(["present boolean", *(f"v{n} {t}" for n, t in enumerate(self.values.values()))]))
        self.next = handle.getValueState("next", "n bigint, emitted bigint")

    def _native(self, x, kind: str):
        if x is None or pd.isna(x):
            return None
        return {"double": float, "float": float, "bigint": int, "int": int, "boolean": bool}.get(kind, str)(x)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        n, emitted = self.next.get() or (0, -1)
        times = set()
        for pdf in rows:
            for ts, *values in pdf[["tw_us", *(f"v{n}" for n in range(len(self.values)))]].itertuples(index=False):
                if ts <= watermark:
                    continue
                self.rows.updateValue((int(ts), n), (True, *(self._native(v, t) for v, t in zip(values, self.values.values()))))
                times.add(int(ts))
                n += 1
        self.next.update((n, emitted))
        for ms in {-(-ts // 1000) for ts in times}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        n, emitted = self.next.get() or (0, -1)
        if 1000 * expiredTimerInfo.getExpiryTimeInMs() <= emitted:
            return
        held = sorted(((k[0], k[1]), v[1:]) for k, v in self.rows.iterator())
        times = [k[0] for k, _ in held]
        places = {c: k for k, c in enumerate(self.values)}
        out = []
        for at, ((ts, _), values) in enumerate(held):
            if not emitted < ts <= watermark:
                continue
            row = [*key, ts, *values]
            for f in self.features:
                frame = held[bisect_left(times, ts - 1000 * f.length_ms) : at + 1]
                row.append(evaluate(f.function, [tuple(v[places[a]] for a in f.args) for _, v in frame]))
            out.append(row)
        self.next.update((n, watermark))
        floor = watermark - self.reach_us
        for k, _ in held:
            if k[0] < floor:
                self.rows.removeKey(k)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def sliding_windows(stream: DataFrame, keys: str | list[str], time: str, features: list[StreamFeature], out_of_orderness_ms: int = 0, lateness_ms: int = 0, carried: tuple[str, ...] = ()) -> DataFrame:
    """A stream of keys, time, arguments, ``carried`` columns and features; needs the RocksDB state store.

    ``time`` is a timestamp with or without zone or a number of milliseconds, as in ``operators.window``.
    """
    by, kinds = [keys] if isinstance(keys, str) else list(keys), dict(stream.dtypes)
    unknown = [f.function for f in features if f.function not in NAMES and f.function not in WINDOW_AGGREGATES]
    if unknown:
        raise ValueError(f"unsupported window aggregates {unknown}")
    args = {a: kinds[a] for a in dict.fromkeys(a for f in features for a in f.args)}
    also = [c for c in dict.fromkeys(carried) if c not in args and c not in by and c != time]
    if nested := [c for c in also if kinds[c].startswith(("array", "map", "struct", "binary"))]:
        raise ValueError(f"a streaming window carries no nested or binary columns: {nested}")
    stamp = micros(F.col(time), kinds[time])
    values = args | dict.fromkeys(also, "string")
    taken = [F.col(v) if v in args else _as_text(v, kinds[v]) for v in values]
    slim = stream.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(by)), stamp.alias("tw_us"), F.timestamp_micros(stamp).alias("tw_time"), *(v.alias(f"v{n}") for n, v in enumerate(taken)))
    marked = slim.withWatermark("tw_time", f"{out_of_orderness_ms} milliseconds")
    processor = SlidingWindows(len(by), features, values, lateness_ms)
    types = [*(kinds[k] for k in by), "bigint", *values.values(), *(result_type(f.function, args[f.args[0]] if f.args else None) for f in features)]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(processor.names, types))
    out = marked.groupBy(*processor.names[: len(by)]).transformWithStateInPandas(processor, schema, "append", "EventTime")
    back = [F.col(f"v{n}").alias(v) if v in args else _from_text(f"v{n}", kinds[v]).alias(v) for n, v in enumerate(values)]
    return out.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(by)), _time(F.col("tw_us"), kinds[time]).alias(time), *back, *(F.col(f"f{n}").alias(f.name) for n, f in enumerate(features)))


def _time(us: Column, kind: str) -> Column:
    """The inverse of ``micros``."""
    if kind in ("bigint", "int"):
        return F.floor(us / 1000).cast(kind)
    stamp = F.timestamp_micros(us)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz")) if kind == "timestamp_ntz" else stamp


def _as_text(name: str, kind: str) -> Column:
    """Text that ``_from_text`` reads back exactly."""
    return (micros(F.col(name), kind) if kind.startswith("timestamp") else F.col(name)).cast("string")


def _from_text(name: str, kind: str) -> Column:
    return _time(F.col(name).cast("bigint"), kind) if kind.startswith("timestamp") else F.col(name).cast(kind)
