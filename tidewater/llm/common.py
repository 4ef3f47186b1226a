"""Shared building blocks of the training-data operators.

* ``materialize`` cuts lineage by writing Parquet into the folder that all
  executors share (``spark.checkpoint.dir``), so a lost executor costs a reread
  and never a recomputation from scratch.
* ``gapless_rank`` numbers rows without sorting a whole group in one task.
* ``numbered`` gives every row its number in a global order.
* ``components`` finds connected components by alternating large-star and
  small-star passes.
* ``counted_join`` joins a table of counted keys so that no hot key lands in one
  task, and ``screen`` tells rows that are surely not in a set from the others,
  by a bitmap of fixed size.
* ``block_pairs`` deals the members of a group to bounded pairs of blocks and
  ``spanning_edges`` compares one such pair, returning at most one edge a row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that are worked on at a time.
ARROW_ROWS = 512
#: Members of one block; a compared pair of blocks holds this many squared cells.
BLOCK = 1024
_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tidewater-"))
    return f"file://{_OWN_DIR[0]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, tag: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows written, taken by the job that writes them: no job and no shuffle of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(name) for name, c in measures.items())), tag)
    return out, seen.get


def local_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows of longs that the driver holds; a broadcast of them runs no job. ``schema``: names."""
    names = schema.split()
    return spark.createDataFrame(pa.table([pa.array([r[n] for r in rows], type=pa.int64()) for n in range(len(names))], names=names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` by slices of ARROW_ROWS rows; the batches they are cut from are bounded in bytes by the session (64 MB by default)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                yield f(batch.slice(at, ARROW_ROWS))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gapless_rank(df: DataFrame, group: list[str], spread: Column, out: str, buckets: int, order: list[Column]) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within ``group``, without gaps.

    Rows are dealt to ``buckets`` parts of each group by the hash of ``spread``;
    parts are counted, the counts are summed up, and only parts are sorted. A
    group that holds all rows is therefore sorted by many tasks.
    """
    parted = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    keys = [*group, "_part"]
    counts = parted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return parted.withColumn("_local", local).join(starts, keys, "left").withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def numbered(rows: DataFrame, order: list[Column], tag: str, spread: list[Column] | None = None) -> DataFrame:
    """``rows`` range-sorted by ``order`` and written, with ``g``: 0, 1, 2 ... in that order.

    ``spread`` deals rows to the ranges where keys of ``order`` are too long for
    that: columns that rise with it. Rows that tie should be equal.
    """
    placed = rows.repartitionByRange(*(spread or order)).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed, tag)
    part = F.shiftright("_m", 33).alias("_part")
    counts = sorted(placed.groupBy(part).agg(F.count(F.lit(1))).collect())  # a row a part
    before = accumulate((n for _, n in counts), initial=0)
    starts = local_table(rows.sparkSession, "_part _before", [(k, n) for (k, _), n in zip(counts, before)])
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("g", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_before")


def components(edges: DataFrame, tag: str, limit: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node reached.

    Alternating large-star and small-star passes: the number of passes grows with
    the logarithm of the longest chain, and a hub's edges are pre-aggregated.
    """

    state = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("a", "b"))}
    now, seen = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag, **state)
    for _ in range(limit):
        if not seen["n"]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(roots.select("a", F.col("m").alias("b"))).distinct()
        now, new = measured(small, tag, **state)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components: no fixed point")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


#: A key with more than one row in so many is joined by broadcast: there are fewer than HEAVY of these, whatever the data.
HEAVY = 4096
#: Bits of the bitmap behind ``screen`` (8 MB), in rows of BITMAP_ROW bits.
SCREEN_BITS, BITMAP_ROW = 1 << 26, 1 << 15


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Both parts of ``counted_parts``."""
    hot, cold = counted_parts(left, right, keys, how)
    return hot.unionByName(cold)


def counted_parts(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """``left`` joined to ``right(keys, n, ...)``, whose keys are unique and found ``n`` times in ``left``; how: inner or left_semi.

    The first part has the rows of hot keys, the second, dealt by ``keys``, all others.

    Keys with more than one in HEAVY of all counted rows, fewer than HEAVY of
    them, are broadcast, so their rows stay where they are; the others are
    shuffled, and none of them has more than that share. ``right`` should be a
    written table, since it is read four times; ``n`` is not returned.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HEAVY > total
    heavy, light = right.where(hot).drop("n"), right.where(~hot).drop("n")
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("shuffle_hash"), keys, how)
    return left.join(F.broadcast(heavy), keys, how), cold


def screen(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely none of ``member`` of ``members``, the other rows).

    Only the latter need a join. The bitmap has SCREEN_BITS bits whatever the
    number of members; more of them let more rows through, never fewer. A null
    key is surely none.
    """

    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(SCREEN_BITS))

    def line(x: Column) -> Column:
        return F.floor(x / BITMAP_ROW).cast("int")

    bits = members.select(place(member).alias("_x")).select(line(F.col("_x")).alias("_line"), (F.col("_x") % BITMAP_ROW).alias("_x"))
    maps = F.broadcast(bits.groupBy("_line").agg(F.bitmap_construct_agg("_x").alias("_map")))
    # Taken once, below the join: the key's hash is no part of what Spark generates for the join and the filter.
    placed, at = rows.withColumn("_at", F.when(key.isNotNull(), place(key))), F.col("_at")
    byte = F.conv(F.hex(F.substr(F.col("_map"), (F.floor(at % BITMAP_ROW / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = placed.join(maps, line(at) == F.col("_line"), "left").withColumn("_may", found)
    return marked.where(~F.col("_may")).select(*rows.columns), marked.where("_may").select(*rows.columns)


def block_pairs(df: DataFrame, keys: list[str], spread: Column, size: int = BLOCK) -> DataFrame:
    """Deal each group of ``keys`` to pairs of blocks (``_i`` <= ``_j``), for groups of two rows or more.

    Adds ``_b``, the row's own block. A group of n rows makes ceil(n / size)
    blocks; each row goes to as many pairs as there are blocks, so no task ever
    holds more than two blocks of a group, however large the group is.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / size).cast("int")
    dealt = df.join(sizes, keys).withColumn("_blocks", blocks).withColumn("_b", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_blocks", "_o")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' starts, from batches sorted by ``keys``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        starts = _starts(now, keys)
        if len(starts) > 1:
            yield now.slice(0, int(starts[-1])), starts[:-1]
        rest = now.slice(int(starts[-1]))
    if rest is not None:
        yield rest, np.zeros(1, dtype=np.int64)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        x = rows[key].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def spanning_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the smallest index reachable from each row."""
    n = len(linked)
    label = np.arange(n)
    has = np.flatnonzero(linked.any(axis=1))
    while len(has):
        new = label.copy()
        for at in range(0, len(has), 256):
            rows = has[at : at + 256]
            new[rows] = np.minimum(label[rows], np.where(linked[rows], label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
