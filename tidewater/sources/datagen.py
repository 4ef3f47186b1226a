"""Generated rows, as a batch or a stream, computed from row numbers alone.

Rows are dealt to ``parallelism`` tasks; each owns its share of the keys and of
the limit, with what remains going to the last. A row's key and its place
within the key follow from its number, so every generator but random ones and
the clock can be replayed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLAYABLE = ("IncrementalTimestamp", "Key", "Increment", "Values")
_SEED = 42


@dataclass(frozen=True)
class Generator:
    """``kind`` with its options; ``type`` is long or double where a kind allows both."""

    kind: str
    start: float = 0
    step: float = 1
    length: int = 8
    num_unique: int = 1
    min: float = 0
    max: float = 1
    values: tuple = ()
    type: str = "double"


@dataclass(frozen=True)
class Datagen:
    fields: dict[str, Generator]
    limit: int | None = None
    rate: float | None = None
    parallelism: int = 1
    replayable: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.extra:
            raise ValueError(f"unknown options: {', '.join(sorted(self.extra))}")
        bad = [g.kind for g in self.fields.values() if g.kind not in REPLAYABLE]
        if self.replayable and bad:
            raise ValueError(f"not replayable: {', '.join(sorted(set(bad)))}")
        if sum(g.kind == "Key" for g in self.fields.values()) > 1:
            raise ValueError("one key generator at most")


def _places(spec: Datagen, number: Column) -> tuple[Column, Column, Column]:
    """(key's task, key's index within the task, place of the row within its key) of a row number."""
    keys = max([g.num_unique for g in spec.fields.values() if g.kind == "Key"] or [spec.parallelism])
    p = spec.parallelism
    if keys < p:
        raise ValueError("fewer keys than tasks")
    if spec.limit is None:
        task, local = number % p, F.floor(number / p)
    else:
        share = max(1, spec.limit // p)
        task = F.least(F.floor(number / share), F.lit(p - 1))
        local = number - task * share
    own = F.when(task == p - 1, keys // p + keys % p).otherwise(keys // p)
    return task.cast("long"), (local % own).cast("long"), F.floor(local / own).cast("long")


def _column(g: Generator, n: int, task: Column, index: Column, place: Column) -> Column:
    kind = "long" if g.type in ("long", "int64") else "double"
    if g.kind == "IncrementalTimestamp":
        return F.timestamp_millis((F.lit(int(g.start)) + place * int(g.step)).cast("long"))
    if g.kind == "ProcessingTimestamp":
        return F.current_timestamp()
    if g.kind == "String":
        return F.randstr(g.length, _SEED + n)
    if g.kind == "Key":
        return F.concat_ws("-", F.lit("key"), task.cast("string"), index.cast("string"))
    if g.kind == "Increment":
        return (F.lit(g.start) + place * F.lit(g.step)).cast(kind)
    if g.kind == "Uniform":
        span = F.rand(_SEED + n) * (g.max - g.min + (1 if kind == "long" else 0))
        return (F.floor(span) + int(g.min) if kind == "long" else span + g.min).cast(kind)
    if g.kind == "Values":
        return F.element_at(F.array(*map(F.lit, g.values)), (place % len(g.values) + 1).cast("int"))
    raise ValueError(f"unknown generator {g.kind!r}")


def _select(spec: Datagen, rows: DataFrame, number: str) -> DataFrame:
    task, index, place = _places(spec, F.col(number))
    return rows.select(*(_column(g, n, task, index, place).alias(name) for n, (name, g) in enumerate(spec.fields.items())))


def batch(spark: SparkSession, spec: Datagen) -> DataFrame:
    if spec.limit is None:
        raise ValueError("a batch needs a limit")
    return _select(spec, spark.range(0, spec.limit, 1, spec.parallelism), "id")


def stream(spark: SparkSession, spec: Datagen) -> DataFrame:
    """Endless rows at ``rate`` a second; ``limit`` ends it by a filter."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", int(spec.rate or 1)).option("numPartitions", spec.parallelism).load()
    rows = rows.where(F.col("value") < spec.limit) if spec.limit is not None else rows
    return _select(spec, rows, "value")


def words(spark: SparkSession, dictionary: list[str], copies: int, round_robin: bool = True) -> DataFrame:
    """(word, timestamp): each word ``copies`` times, in turn or one after the other."""
    n = len(dictionary)
    rows = spark.range(0, n * copies)
    at = F.col("id") % n if round_robin else F.floor(F.col("id") / copies)
    return rows.select(F.element_at(F.array(*map(F.lit, dictionary)), (at + 1).cast("int")).alias("word"), F.unix_millis(F.current_timestamp()).alias("timestamp"))


def vector(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
