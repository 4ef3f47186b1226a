"""Minimum-cost-flow resharding.

Old shard sizes are supplies, new capacities are demands, and moving a byte
from shard i to shard j costs 0 where i = j and 1 (or a given price) elsewhere.
Without prices the cheapest flow is known in closed form: each shard keeps what
fits, and surpluses are laid along deficits in order, with fewer transfers than
shards. With prices, successive shortest paths solve the transport problem on
the matrix of shards, whose size is not that of documents. The flow is then cut
into blocks: documents of a giving shard are laid out small first, and each
transfer takes the stretch of documents that its bytes cover, so a cut misses
its target by at most one of the smaller documents. Shards that neither give
nor take are not rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

#: Rows that one part of a shard should have when positions are numbered.
PART_ROWS = 100_000
#: Parts of a class of sizes in a shard, at most, unless there are more cores.
MAX_PARTS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """Cheapest flow {(i, j): amount} that sends all supply; needs sum(supply) <= sum(capacity).

    Successive shortest paths with potentials on the bipartite graph of shards.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than the supply")
    price = cost or [[int(i != j) for j in range(m)] for i in range(n)]
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    high = [0] * (n + m)
    while any(left):
        best = [float("inf")] * (n + m)
        came = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            best[i] = 0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            if u < n:
                steps = ((n + j, price[u][j]) for j in range(m))
            else:
                steps = ((i, -price[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                nd = d + c + high[u] - high[v]
                if nd < best[v]:
                    best[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        end = min((v for v in range(n, n + m) if room[v - n] and best[v] < float("inf")), key=lambda v: best[v] + high[v])
        high = [h + min(b, best[end]) for h, b in zip(high, best)]
        path, v = [], end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end - n], *(flow[y][x - n] for x, y in path if x >= n)])
        for x, y in path:
            if x < n:
                flow[x][y - n] += amount
            else:
                flow[y][x - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return {(i, j): flow[i][j] for i in range(n) for j in range(m) if flow[i][j]}


def fewest_moves(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The cheapest flow at one price for every move, in time linear in the number of shards; at most that many transfers."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than the supply")
    flow = {}
    kept = [min(s, c) for s, c in zip(supply, capacity)]
    for k, n in enumerate(kept):
        if n:
            flow[k, k] = n
    room = ((j, c - (kept[j] if j < len(kept) else 0)) for j, c in enumerate(capacity))
    j, free = next(room, (0, 0))
    for i, s in enumerate(supply):
        left = s - (kept[i] if i < len(kept) else 0)
        while left:
            while not free:
                j, free = next(room)
            n = min(left, free)
            flow[i, j] = flow.get((i, j), 0) + n
            left, free = left - n, free - n
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(sized: DataFrame, capacities: list[int] | None, shards: int) -> dict[tuple[int, int], int]:
    """The flow for ``sized(old_shard, size)``; only a row a shard comes to the driver."""
    totals = {r["old_shard"]: r["bytes"] for r in sized.groupBy("old_shard").agg(F.sum("size").cast("long").alias("bytes")).collect()}
    supply = [totals.get(s, 0) for s in range(max([shards - 1, *totals]) + 1)]
    goal = capacities or even_capacities(sum(supply), shards)
    return fewest_moves(supply, goal)


def _cuts(spark: SparkSession, flow: dict[tuple[int, int], int]) -> DataFrame:
    """(old_shard, new_shard, lo, hi): the stretch of a giving shard's layout that each transfer takes.

    What stays is laid out last, with the large documents.
    """
    rows, goes = [], {}
    for i, j in flow:
        goes.setdefault(i, []).append(j)
    for i in sorted(goes):
        at = 0
        for j in sorted(goes[i], key=lambda j: (j == i, j)):
            rows.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
        rows[-1] = (*rows[-1][:3], (1 << 62))
    return spark.createDataFrame(rows, "old_shard int, new_shard int, lo long, hi long")


def reshard(rows: DataFrame, old_shard: Column, size: Column, key: Column, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """``rows`` with size, old_shard and new_shard, moving the fewest bytes to capacities (even ones by default).

    ``old_shard`` is an integer from 0; a null counts as 0. ``size`` must be
    non-negative; a null counts as 0. Equal rows may part. Other columns are carried
    along (those named size, old_shard and new_shard are replaced). An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    sized = rows.withColumn("size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("old_shard", F.coalesce(old_shard, F.lit(0)).cast("int"))
    flow = plan(sized.select("old_shard", "size"), capacities, shards)
    count = max(1, sum(1 for _ in flow))
    stays = F.pmod(F.col("old_shard"), F.lit(len(capacities or []) or shards)).cast("int")  # without bytes, hence without flow
    if not flow:
        return sized.withColumn("new_shard", stays)
    # Position in the old shard's layout: classes of size, parts of a class by hash, rows within a part.
    parts = max(1, spark.sparkContext.defaultParallelism, min(count, MAX_PARTS))
    laid = sized.withColumn("_class", F.floor(F.log2(F.col("size") + 1)).cast("int")).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    by = ["old_shard", "_class", "_part"]
    sums = laid.groupBy(*by).agg(F.sum("size").cast("long").alias("_bytes"))
    order = Window.partitionBy("old_shard").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_bytes").over(order), F.lit(0))).drop("_bytes")
    inner = Window.partitionBy(*by).orderBy("size", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, by).withColumn("_at", F.col("_start") + F.col("_in"))
    cuts = F.broadcast(_cuts(spark, flow))  # fewer rows than old and new shards together
    middle = F.col("_at") + F.expr("size div 2")
    inside = (placed["old_shard"] == cuts["old_shard"]) & (middle >= F.col("lo")) & (middle < F.col("hi"))
    joined = placed.join(cuts, inside, "left").drop(cuts["old_shard"]).withColumn("new_shard", F.coalesce("new_shard", stays))
    return joined.drop("_class", "_part", "_start", "_in", "_at", "lo", "hi")


def rewrite(spark: SparkSession, old_dir: str, new_dir: str, size: str, key: str, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """Move files ``old_dir/shard=K`` to new capacities; returns the manifest (shard, path, rewritten).

    Only shards that give or take are written, below ``new_dir``; the manifest
    points to the old folder for all others, which are not read again.
    """
    rows = spark.read.parquet(old_dir)
    columns = [c for c in rows.columns if c != "shard"]
    old = F.col("shard").cast("int")
    held = rows.select(old.alias("old_shard"), F.coalesce(F.expr(size), F.lit(0)).cast("long").alias("size"), F.col(key).alias("_key"), F.struct(*columns).alias("_row"))
    flow = plan(held.select("old_shard", "size"), capacities, shards)
    idle = {r["old_shard"] for r in held.select("old_shard").distinct().collect()} - {i for i, _ in flow}
    goes = [*flow, *((s, s % (len(capacities or []) or shards)) for s in idle)]
    touched = sorted({s for i, j in goes if i != j for s in (i, j)})
    if touched:
        moved = reshard(held, F.col("old_shard"), F.col("size"), F.col("_key"), shards, capacities)
        affected = moved.where(F.col("old_shard").isin(touched) | F.col("new_shard").isin(touched))
        affected.select("_row.*", F.col("new_shard").alias("shard")).write.partitionBy("shard").parquet(new_dir)
    live = sorted({j for _, j in goes})
    manifest = [(s, f"{new_dir if s in touched else old_dir}/shard={s}", s in touched) for s in live]
    return spark.createDataFrame(manifest, "shard int, path string, rewritten boolean")


def shard_table(docs: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """Every document's shard and slot after growing from ``old_shards`` to ``shards`` of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text and 8; a null text has none),
    text_crc32 (0 for null and empty texts), law, shard, slot, grown_shard, old_shard.
    Null doc_ids are placed like any other. Repeated rows come out repeated, each with a
    slot of its own; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = materialize(slim, "shard-sizes")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int")
    moved = reshard(slim, old, F.col("size"), F.struct("doc_id", "text_crc32"), shards)
    moved = materialize(moved, "shard-moved")
    parts = max(4, min(4096, moved.count() // (shards * PART_ROWS) + 1))
    ranked = gapless_rank(moved.withColumnRenamed("new_shard", "shard"), ["shard"], F.struct("doc_id", "text_crc32"), "slot", parts, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
