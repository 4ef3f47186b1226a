"""Point-in-time features: the windows of ``window.py`` as of the time of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from ..functions.registry import NAMES, expression
from .window import WINDOW_AGGREGATES, Feature, micros

#: Requests of a key and bucket that one task takes where the key has fewer events than requests there.
PART = 4096


def request_features(
    events: DataFrame, requests: DataFrame, keys: list[str], time: str, features: list[Feature], exclude_current_row: bool = False, bucket_us: int | None = None, part: int = PART
) -> DataFrame:
    """``requests`` with one column per feature: rows of the key from ``length`` before the request up to its time, all peers included.

    Unless ``exclude_current_row``, the request's own values are one more row of
    its frame; ``requests`` then needs the columns that the features read. A
    request without history keeps its row. Requests are never dropped or late.

    Events and requests are dealt once, by (key, time bucket), and sorted once; a
    frame is read where its rows lie, and only the request with its answers goes
    on, so what is shuffled grows with the rows and not with the pairs. A request
    lies in one bucket, an event in every bucket whose requests can see it, so a
    hot key is cut by time. Requests of a bucket are rows of its frames, too, if
    masked ones: more than ``part`` of them, and more than its events, are dealt to
    parts with all events each.
    """
    reach = max(f.length_us for f in features)
    width = bucket_us or max(1, reach)
    # Without their own row, requests may hold keys and time only.
    read = [c for c in dict.fromkeys([*keys, *events.columns]) if c != time and (exclude_current_row or c in requests.columns)]
    own = [f"__k{n}" for n in range(len(keys))]
    same = [F.col(k).alias(o) for k, o in zip(keys, own)]
    complete = F.col(time).isNotNull()
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    ts = micros(F.col(time), dict(events.dtypes)[time])
    history = events.where(complete).select(*same, ts.alias("__ts"), F.lit(True).alias("__event"), *read)
    history = history.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__ts") / width), F.floor((F.col("__ts") + reach) / width))))
    at = micros(F.col(time), dict(requests.dtypes)[time])
    row = [F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in requests.dtypes]
    kept = {c: f"__r{n}" for n, c in enumerate(requests.columns)}
    values = [] if exclude_current_row else read
    asked = requests.select(
        *same,
        F.when(complete, at).alias("__ts"),
        F.lit(False).alias("__event"),
        complete.alias("__known"),
        F.col(time).isNotNull().alias("__timed"),
        F.floor(F.when(complete, at) / width).alias("__bucket"),
        # Deals equal rows of different input partitions apart; a retry gives the same.
        F.when(complete, F.xxhash64(F.spark_partition_id(), at)).otherwise(F.xxhash64(F.spark_partition_id(), *row)).alias("__deal"),
        *values,
        *(F.col(c).alias(r) for c, r in kept.items()),
    )
    by = [*own, "__bucket"]
    hot = _hot(history, asked, by, part)
    met = [F.col(b) == F.col(f"__h{n}") for n, b in enumerate(by)]
    parts = [f"__h{n}" for n in range(len(by))]
    # What can't be answered from history meets nobody: each such request is a partition of its own.
    asked = asked.join(F.broadcast(hot), met, "left").withColumn("__part", F.when(F.col("__known"), F.pmod("__deal", F.coalesce("__parts", F.lit(1)))).otherwise(F.col("__deal"))).drop(*parts, "__parts", "__deal", "__known")
    history = history.join(F.broadcast(hot), met, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))).drop(*parts, "__parts")
    rows = history.unionByName(asked, allowMissingColumns=True).repartition(*by, "__part")
    partition = ", ".join([*by, "__part"])
    over = lambda f: f"(PARTITION BY {partition} ORDER BY __ts RANGE BETWEEN {f.length_us} PRECEDING AND CURRENT ROW)"
    # Frames first, then the requests among the rows, then the features, so that no event's row is worked out to the end.
    states, ends = {}, []
    for n, f in enumerate(features):
        made, end = _split(rows, f, over(f), f"__s{n}", exclude_current_row)
        states |= made
        empty = _empty(f)
        ends.append((F.expr(end) if empty is None else F.coalesce(F.expr(end), empty)).alias(f.name))
    framed = rows.select("*", *(F.expr(s).alias(name) for name, s in states.items())).where("NOT __event")
    return framed.select(*(F.col(r).alias(c) for c, r in kept.items()), *ends)


def _hot(history: DataFrame, asked: DataFrame, by: list[str], part: int) -> DataFrame:
    """Keys and buckets with more requests than events and than ``part``, with the number of parts; at most one for ``part`` requests."""
    names = [F.col(b).alias(f"__h{n}") for n, b in enumerate(by)]
    each = history.select(*names, F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(asked.where("__known").select(*names, F.lit(0).alias("e"), F.lit(1).alias("r")))
    counted = each.groupBy(*(f"__h{n}" for n in range(len(by)))).agg(F.sum("e").alias("e"), F.sum("r").alias("r")).where(F.col("r") > F.greatest("e", F.lit(part)))
    return counted.select(*(f"__h{n}" for n in range(len(by))), F.ceil(F.col("r") / F.greatest("e", F.lit(part))).alias("__parts"))


def _split(rows: DataFrame, f: Feature, over: str, state: str, alone: bool) -> tuple[dict[str, str], str]:
    """What the frames of a feature give, by column, and the feature from that; unless ``alone``, with the request's own values."""
    args = list(f.args)
    if f.function in NAMES and not _where(f):
        # The frame's list stands for the one collecting aggregate; the own row is one more element.
        collected: list[str] = []

        def listed(x: str) -> str:
            collected.append(x)
            return state if alone else f"concat({state}, filter(array(CASE WHEN __timed THEN {x} END), y -> y IS NOT NULL))"

        end = expression(f.function, args, listed)
        return {state: f"collect_list(CASE WHEN __event THEN {collected[0]} END) OVER {over}"}, end
    if f.function in NAMES:
        function, x = f.function.removesuffix("_where"), f"CASE WHEN {args[1]} THEN {args[0]} END"
    else:
        function, x = f.function, args[0] if args and args[0] != "*" else "1"
    if function not in WINDOW_AGGREGATES:
        raise ValueError(f"unsupported window aggregate {f.function!r}")
    seen, mine = f"CASE WHEN __event THEN {x} END", f"(CASE WHEN __timed THEN {x} END)"
    if alone:
        return {state: f"{function}({seen}) OVER {over}"}, state
    if function in ("min", "max"):
        return {state: f"{function}({seen}) OVER {over}"}, f"{'least' if function == 'min' else 'greatest'}({state}, {mine})"
    n = f"({state}n + CASE WHEN {mine} IS NOT NULL THEN 1L ELSE 0L END)"
    made = {f"{state}n": f"count({seen}) OVER {over}"}
    if function == "count":
        return made, n
    kind = rows.select(F.expr(f"{function}({x})")).schema[0].dataType
    if function in ("sum", "avg"):
        value = f"CAST({{}} AS {kind.simpleString()})" if function == "sum" or kind.simpleString() == "double" else "{}"
        wide = kind if function == "sum" else rows.select(F.expr(f"sum({value.format(f'({x})')})")).schema[0].dataType
        made[state] = f"sum({seen if function == 'sum' else value.format(f'({seen})')}) OVER {over}"
        total = f"coalesce({_plus(state, value.format(mine), wide)}, {state}, {value.format(mine)})"
        if function == "sum":
            return made, total
        if not isinstance(kind, DecimalType):
            return made, f"CASE WHEN {n} > 0 THEN {total} / {n} END"
        # Quotient and remainder apart: the plain quotient of long decimals has fewer digits than avg gives.
        some, least = f"CAST(nullif({n}, 0L) AS DECIMAL(10,0))", f"DECIMAL(37,{kind.scale})" if kind.precision == 38 else kind.simpleString()
        return made, f"CAST(CAST({total} div {some} AS {least}) + CAST(({total} % {some}) / {some} AS {least}) AS {kind.simpleString()})"
    # Mean and squared deviations of the frame, and one more value.
    number = f"CAST({mine} AS DOUBLE)"
    made |= {f"{state}a": f"avg(CAST({seen} AS DOUBLE)) OVER {over}", f"{state}p": f"var_pop(CAST({seen} AS DOUBLE)) OVER {over}"}
    step = f"({number} - coalesce({state}a, 0D))"
    squares = f"(coalesce({state}n * {state}p, 0D) + coalesce({step} * ({step} - {step} / {n}), 0D))"
    value = f"{squares} / nullif(greatest({n} - {0 if function.endswith('_pop') else 1}, 0L), 0L)"
    return made, f"sqrt({value})" if function.startswith("stddev") else value


def _plus(a: str, b: str, kind: DataType) -> str:
    """The sum of two of a type, in that type; of decimals of 38 digits, ``+`` would give up one behind the point."""
    text = kind.simpleString()
    plain = f"CAST({a} + {b} AS {text})"
    if not isinstance(kind, DecimalType) or kind.precision < 38:
        return plain
    less = f"DECIMAL(37,{min(37, kind.scale)})"
    return f"coalesce(CAST(try_cast({a} AS {less}) + try_cast({b} AS {less}) AS {text}), {plain})"


def _where(f: Feature) -> bool:
    return f.function.endswith("_where") and "cate" not in f.function


def request_features_joined(
    events: DataFrame, requests: DataFrame, keys: list[str], time: str, features: list[Feature], exclude_current_row: bool = False, bucket_us: int | None = None
) -> DataFrame:
    """The same answers by a join, for few requests against long histories: the work grows with the pairs, events without requests cost none.

    Both sides are dealt to (key, time bucket), so a hot key is cut by time, and
    the pairs are collected by request.
    """
    reach = max(f.length_us for f in features)
    width = bucket_us or max(1, reach)
    # Without their own row, requests may hold keys and time only.
    names = list(dict.fromkeys([*keys, time, *(c for c in events.columns if exclude_current_row or c in requests.columns)]))
    row = [F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in requests.dtypes]
    asked = requests.withColumn("__rid", F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("second"), *row).alias("b")))  # equal requests have equal answers
    asked = asked.withColumn("__at", micros(F.col(time), dict(requests.dtypes)[time]))
    keyed = asked.select("__rid", "__at", *(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    low, high = F.floor((F.col("__at") - reach) / width), F.floor(F.col("__at") / width)
    keyed = keyed.withColumn("__bucket", F.explode(F.sequence(low, high)))
    history = events.where(F.col(time).isNotNull()).withColumn("__ts", micros(F.col(time), dict(events.dtypes)[time])).withColumn("__eb", F.floor(F.col("__ts") / width))
    same = F.col("__bucket") == F.col("__eb")
    for k in keys:
        same = same & (F.col(f"__{k}") == F.col(k))
    near = (F.col("__ts") <= F.col("__at")) & (F.col("__ts") >= F.col("__at") - reach)
    read = [c for c in names if c not in (time,)]
    found = history.join(keyed, same & near).select("__rid", "__at", "__ts", *read)
    if not exclude_current_row:
        found = found.unionByName(asked.select("__rid", "__at", F.col("__at").alias("__ts"), *read).distinct())
    columns = []
    for f in features:
        inside = f"__ts >= __at - {f.length_us}L"
        columns.append(F.expr(_masked(f, inside)).alias(f.name))
    answers = found.groupBy("__rid", "__at").agg(*columns).drop("__at")
    empty = {f.name: F.coalesce(f.name, _empty(f)) for f in features if _empty(f) is not None}
    out = asked.join(answers, "__rid", "left").drop("__rid", "__at")
    return out.withColumns(empty) if empty else out


def _masked(f: Feature, inside: str) -> str:
    """The feature as a grouped aggregate of rows for which ``inside`` holds."""
    args = list(f.args)
    if f.function in NAMES:
        # The measured value or the category is null outside, which leaves the row out.
        value = 2 if f.function.endswith("cate_where") or f.function.endswith("ratio_cate") else 1 if f.function.endswith("_cate") else 0
        args[value] = f"CASE WHEN {inside} THEN {args[value]} END"
        return expression(f.function, args)
    if f.function not in WINDOW_AGGREGATES:
        raise ValueError(f"unsupported window aggregate {f.function!r}")
    inner = args[0] if args and args[0] != "*" else "1"
    return f"{f.function}(CASE WHEN {inside} THEN {inner} END)"


def _empty(f: Feature):
    """What the feature is over no rows, where that isn't null."""
    if f.function in ("count", "count_where"):
        return F.lit(0)
    if f.function == "top1_ratio":
        return F.lit(0.0)
    if f.function in NAMES and not f.function.endswith("_where") or "cate" in f.function:
        return F.lit("")
    return None
