"""Parquet files, local or in an object store, and Kafka topics of Arrow payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, regex: str | None = None, streaming: bool = False) -> DataFrame:
    """Files below ``path``; ``regex`` chooses among their paths, before any is opened. Columns and filters are pushed down by Catalyst."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(schema) if schema else reader
    rows = reader.option("recursiveFileLookup", "true").parquet(path) if not streaming else reader.parquet(path)
    return rows.where(F.col("_metadata.file_path").rlike(regex)) if regex else rows


def object_store(spark: SparkSession, region: str | None = None, endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None) -> None:
    """Hadoop settings for s3a:// paths."""
    settings = {"fs.s3a.endpoint.region": region, "fs.s3a.endpoint": endpoint, "fs.s3a.access.key": access_key, "fs.s3a.secret.key": secret_key}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in settings.items():
        if value is not None:
            conf.set(key, value)
    if endpoint:
        conf.set("fs.s3a.path.style.access", "true")


def kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType, offsets: str = "earliest", options: dict[str, str] | None = None, streaming: bool = True) -> DataFrame:
    """Rows of Arrow IPC payloads; offsets are kept in the query's checkpoint."""
    if offsets not in ("earliest", "latest"):
        raise ValueError("offsets: earliest or latest; positions of a group live in the checkpoint")
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return decode_arrow(reader.load().select("value"), schema)


def decode_arrow(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``payloads(value binary)``, each an Arrow IPC stream of ``schema``; undecodable ones are skipped, other schemas are an error."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                try:
                    table = pa.ipc.open_stream(payload.as_buffer()).read_all()
                except (pa.ArrowInvalid, OSError, AttributeError):
                    continue
                if table.schema.names != target.names:
                    raise ValueError(f"payload columns {table.schema.names} are not {target.names}")
                yield from table.cast(target).to_batches()

    return payloads.mapInArrow(run, schema)


def from_json_array(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``payloads(value string)``, each a JSON array of objects; unreadable ones are skipped."""
    return payloads.select(F.inline(F.from_json("value", T.ArrayType(schema))))


def to_json_array(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON array per key, nulls written."""
    return df.groupBy(*keys).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def encode_arrow(rows: list[dict], schema: T.StructType) -> bytes:
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()
