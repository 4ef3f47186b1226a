"""From a specification to a DataFrame, a streaming query or a request function."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.request import request_features_joined
from ..operators.tiling import tiled_features
from ..operators.window import Feature, with_cursor
from ..schema import struct_from_json
from ..sinks.writers import CountStore, MemoryStore, count_rows, write_parquet
from ..sources import datagen, files
from ..streaming.window import StreamFeature, sliding_windows
from .features import parse
from .spec import PipelineSpec, SourceSpec
from .sqlrewrite import cursor_name, exact_frames, rewrite


def load(spark: SparkSession, source: SourceSpec, streaming: bool) -> DataFrame:
    o, schema = source.options, struct_from_json(source.schema) if source.schema else None
    if source.kind == "datagen":
        fields = {k: datagen.Generator(**{**g, "values": tuple(g.get("values", ()))}) for k, g in o["fields"].items()}
        spec = datagen.Datagen(fields, **{k: v for k, v in o.items() if k != "fields"})
        return datagen.stream(spark, spec) if streaming else datagen.batch(spark, spec)
    if source.kind == "parquet":
        return files.parquet(spark, o["path"], schema, o.get("regex"), streaming)
    if source.kind == "kafka":
        return files.kafka(spark, o["servers"], o["topic"], schema, o.get("offsets", "earliest"), o.get("options"), streaming)
    return o["data"] if isinstance(o["data"], DataFrame) else datagen.vector(spark, o["data"], o["types"])


def compile_query(spark: SparkSession, spec: PipelineSpec, streaming: bool = False) -> DataFrame:
    """The DataFrame of the specification's SQL over its sources.

    Interval frames of a statement that reads one source directly end at the
    current row, not at its last peer (``exact_ties``); a RANGE frame that can't be
    made so is refused. Over joins, frames are SQL's. Ties are ordered by
    ``sequence``, without one in the order they are read.
    """
    if spec.tiles_ms and not streaming:
        return tiled(spark, spec)
    frames = {s.name: load(spark, s, streaming) for s in spec.sources}
    sql, cursors = exact_frames(spec.sql) if spec.exact_ties and not streaming else (spec.sql, [])
    kinds = {s.name: s.kind for s in spec.sources}
    # Windows over joined or derived tables order their own rows, which no cursor of a source can.
    direct = [n for n, df in frames.items() if cursors and all({*keys, time} <= set(df.columns) for keys, time in cursors)]
    if cursors and (len(direct) != 1 or _derived(spec.sql)):
        sql, cursors = spec.sql, []
    for name, df in frames.items():
        if cursors and name == direct[0]:
            order = spec.sequence or "__order"
            df = df if spec.sequence else df.withColumn(order, _read_order(kinds[name]))
            for n, (keys, time) in enumerate(cursors):
                df = with_cursor(df, keys, time, order, cursor_name(n))
            df = df if spec.sequence else df.drop(order)
        if streaming:
            df = _watermarked(df, spec)
        df.createOrReplaceTempView(name)
    out = spark.sql(rewrite(sql)).drop(*(cursor_name(n) for n in range(len(cursors))))
    return out.repartition(spec.parallelism) if spec.parallelism and not streaming else out


def _read_order(kind: str) -> Column:
    """The order rows are read in: place in the files, which no split or retry changes, or in the task where there are none."""
    return F.struct("_metadata.file_path", "_metadata.row_index") if kind == "parquet" else F.monotonically_increasing_id()


def _derived(sql: str) -> bool:
    return bool(re.search(r"\bJOIN\b", sql, re.IGNORECASE))


def tiled(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    """A statement of sums, counts, averages, minima and maxima over tiles of ``tiles_ms``; the answer is that without tiles.

    Streams and requests accept tiles and answer without them.
    """
    parts = parse(spec.sql)
    if wrong := [f.function for f in parts.features if f.function not in ("sum", "count", "avg", "min", "max")]:
        raise ValueError(f"no tiles for {wrong}")
    source = next(s for s in spec.sources if s.name == parts.source)
    rows = load(spark, source, False)
    order = spec.sequence or "__order"
    rows = rows if spec.sequence else rows.withColumn(order, _read_order(source.kind))
    rows = rows.alias(parts.alias or parts.source)
    rows = rows.where(parts.where) if parts.where else rows
    args = {f: f"__arg{n}" for n, f in enumerate(parts.features)}
    rows = rows.withColumns({name: F.expr(f.args[0] if f.args else "1") for f, name in args.items()})
    names = {}
    for n, (f, arg) in enumerate(args.items()):
        names[f] = f"__w{n}"
        rows = tiled_features(rows, list(parts.keys), parts.time, arg, f.length_us, order, tuple(1000 * t for t in spec.tiles_ms), (f.function,), f"__w{n}_").withColumnRenamed(f"__w{n}_{f.function}", f"__w{n}")
    plain = [c for c in load(spark, source, False).columns]
    chosen = []
    for item in parts.items:
        if isinstance(item, Feature):
            chosen.append(F.col(names[item]).alias(item.name))
        elif item == "*":
            chosen += [F.col(c) for c in plain]
        else:
            chosen.append(F.expr(re.sub(rf"\b{re.escape(parts.alias or parts.source)}\.", "", item)))
    return rows.select(*chosen)


def _watermarked(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    time = next((c for c, t in df.dtypes if t == "timestamp"), None)
    return df.withWatermark(time, f"{spec.event_time.watermark.out_of_orderness_ms} milliseconds") if time else df


def compile_stream(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    """A streaming statement: per-row windows become a stateful processor, all else is Spark's own streaming plan.

    Columns come out as the batch has them, in the statement's order. The watermark
    is put on the column that the frames order by, at its source.
    """
    if not re.search(r"\bOVER\b", re.sub(r"'(?:[^'\\]|\\.)*'", "", spec.sql), re.IGNORECASE):
        return compile_query(spark, spec, streaming=True)
    parts = parse(spec.sql)
    source = next(s for s in spec.sources if s.name == parts.source)
    rows = load(spark, source, True).alias(parts.alias or parts.source)
    rows = rows.where(parts.where) if parts.where else rows
    plain = set(rows.columns)
    arguments = {a: f"__arg{n}" for n, a in enumerate(dict.fromkeys(a for f in parts.features for a in f.args))}
    made = [StreamFeature(f"__f{n}", f.function, tuple(arguments[a] for a in f.args), f.length_us // 1000) for n, f in enumerate(parts.features)]
    # Selected columns, in the statement's order: those of the source as they are, expressions under a name of their own.
    selected, names, expressions = [], iter(made), {}
    for item in parts.items:
        if isinstance(item, Feature):
            selected.append((next(names).name, item.name))
            continue
        for name in rows.selectExpr(item).columns:
            own = name if item in ("*", name) and name in plain else f"__c{len(expressions)}"
            if own != name:
                expressions[own] = item
            selected.append((own, name))
    rows = rows.withColumns({name: F.expr(a) for a, name in arguments.items()} | {own: F.expr(item) for own, item in expressions.items()})
    out = sliding_windows(rows, list(parts.keys), parts.time, made, spec.event_time.watermark.out_of_orderness_ms, spec.event_time.allowed_lateness_ms, tuple(own for own, _ in selected if own in rows.columns))
    return out.select(*(F.col(own).alias(name) for own, name in selected))


def compile_request(spark: SparkSession, spec: PipelineSpec) -> Callable[[DataFrame], DataFrame]:
    """The statement's features as of requests: a function from requests to answers."""
    parts = parse(spec.sql)
    events = load(spark, next(s for s in spec.sources if s.name == parts.source), False)
    events = events.where(parts.where) if parts.where else events
    return request_function(events, list(parts.keys), parts.time, list(parts.features), bool((spec.request or {}).get("exclude_current_row")))


def run(spark: SparkSession, spec: PipelineSpec) -> DataFrame | StreamingQuery | MemoryStore | CountStore | int | Callable[[DataFrame], DataFrame] | None:
    """Runs a batch or streaming specification into its sink; a request specification gives its answering function."""
    if spec.mode == "request":
        return compile_request(spark, spec)
    streaming = spec.mode == "streaming"
    if streaming and spec.checkpoint.interval_ms:
        spark.conf.set("spark.sql.streaming.minBatchesToRetain", str(max(2, spec.checkpoint.retained)))
    df = compile_stream(spark, spec) if streaming else compile_query(spark, spec)
    sink = spec.sink
    if sink is None:
        return df
    o = dict(sink.options)
    if sink.kind == "parquet":
        return write_parquet(df, **o, **({"checkpoint": spec.checkpoint.location, "trigger_ms": spec.checkpoint.interval_ms} if streaming else {}))
    if sink.kind == "count":
        if not streaming:
            return count_rows(df)
        counted = CountStore()
        counted.query = counted.stream(df, spec.checkpoint.location, spec.checkpoint.interval_ms)
        return counted
    store = o.get("store") or MemoryStore(o.get("keys"))
    if streaming:
        store.query = store.stream(df, spec.checkpoint.location, o.get("order"), spec.checkpoint.interval_ms)
    else:
        store.write(df, o.get("order"))
    return store


def request_function(events: DataFrame, keys: list[str], time: str, features: list[Feature], exclude_current_row: bool = False) -> Callable[[DataFrame], DataFrame]:
    """What a request server needs: requests in, the same rows with the features of their time out."""
    return lambda requests: request_features_joined(events, requests, keys, time, features, exclude_current_row)
