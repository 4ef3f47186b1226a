"""Writers for batches and streams."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import upsert_latest

COMPRESSION = ("snappy", "gzip", "zstd", "lz4", "none")


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_fields: list[str] | None = None, max_rows_per_file: int = 0, row_group_bytes: int | None = None, mode: str = "append", checkpoint: str | None = None, trigger_ms: int = 0) -> StreamingQuery | None:
    """Hive-style folders ``field_=value``; the fields stay in the files under their own names, null as the text "null" in the folder's.

    A stream goes through Spark's file sink, whose log lists each batch's files
    once, so that a restarted query repeats no rows.
    """
    if compression not in COMPRESSION:
        raise ValueError(f"compression is one of {COMPRESSION}")
    fields = partition_fields or []
    # Each field twice: the copy names the folder and leaves the file.
    out = df.select("*", *(F.coalesce(F.col(f).cast("string"), F.lit("null")).alias(f"{f}_") for f in fields))
    names = [f"{f}_" for f in fields]
    if df.isStreaming:
        writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=f"{trigger_ms} milliseconds") if trigger_ms else writer
    else:
        writer = out.write.mode(mode)
    writer = writer.option("compression", compression).option("maxRecordsPerFile", max_rows_per_file)
    writer = writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer
    writer = writer.partitionBy(*names) if names else writer
    if df.isStreaming:
        return writer.start()
    writer.parquet(path)
    return None


class MemoryStore:
    """What a test or a small service reads back: appended rows, or the last row by key."""

    def __init__(self, keys: list[str] | None = None):
        self.keys, self.rows, self.by_key, self.lock, self.last = keys, [], {}, threading.Lock(), -1

    def key_of(self, row) -> str:
        return "|".join(str(row[k]) for k in self.keys)

    def write(self, df: DataFrame, order: str | None = None) -> None:
        """Append, or upsert the last row of each key in ``order`` (any of them without one)."""
        reduced = upsert_latest(df, self.keys, order) if self.keys and order else df
        with self.lock:
            for row in reduced.toLocalIterator():
                if self.keys:
                    self.by_key[self.key_of(row)] = row
                else:
                    self.rows.append(row)

    def batch(self, part: DataFrame, number: int, order: str | None) -> None:
        """One micro-batch; a batch that comes again after a failure is known by its number."""
        if number > self.last:
            self.write(part, order)
            self.last = number

    def stream(self, df: DataFrame, checkpoint: str, order: str | None = None, trigger_ms: int = 0) -> StreamingQuery:
        return _each_batch(df, lambda part, n: self.batch(part, n, order), checkpoint, "update" if self.keys else "append", trigger_ms)

    def get(self, *key) -> object:
        return self.by_key.get("|".join(map(str, key)))

    def drain(self) -> list:
        with self.lock:
            out, self.rows = self.rows, []
        return out


def count_rows(df: DataFrame) -> int:
    """Runs ``df`` without keeping its rows."""
    seen = Observation("count")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


class CountStore:
    """Counts the rows of a stream, each batch once."""

    def __init__(self) -> None:
        self.n, self.last = 0, -1

    def batch(self, part: DataFrame, number: int) -> None:
        if number > self.last:
            self.n += part.count()
            self.last = number

    def stream(self, df: DataFrame, checkpoint: str, trigger_ms: int = 0) -> StreamingQuery:
        return _each_batch(df, self.batch, checkpoint, "append", trigger_ms)


def _each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str, trigger_ms: int) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(processingTime=f"{trigger_ms} milliseconds") if trigger_ms else writer).start()
