"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are collapsed first. Centroids are fitted on a bounded sample
(``SAMPLE`` different vectors, the smallest by hash) and every vector is
assigned to its home cell. Vectors at cosine t or more are at most
sqrt(2 - 2 t) apart, and the hyperplane that bisects two centroids lies between
vectors of the two homes; so a vector farther than that behind the hyperplane
has no link in the other cell, whatever the data's shape. It is dealt to all
other pairs of cells: no pair is missed.

Cells are cut into bounded blocks, pairs of blocks are multiplied in double
precision, and each returns sums and one spanning edge a vector, never all
pairs. A vector is dealt to a pair of blocks at most once. Data in far clusters
meet few cells; data that spread evenly over many dimensions meet nearly all,
and the work then grows with the square of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, sorted_groups, spanning_labels

#: Vectors that centroids are fitted on, at most.
SAMPLE = 32_768
#: Centroids, at most: 16,384 of 1,024 components are 128 MB.
MAX_CELLS = 16_384
ROUNDS = 6
#: Vectors of a block, on average at most: a compared pair of blocks makes at most about twice that many rows.
CELL_BLOCK = 4096


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows: means of the members, scaled to unit length."""
    rng = np.random.default_rng(42)
    cells = max(1, min(cells, len(sample)))
    centre = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[at : at + 4096] @ centre.T).argmax(axis=1) for at in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, home, sample)
        length = np.linalg.norm(total, axis=1)
        fine = length > 1e-9
        centre[fine] = total[fine] / length[fine, None]
    return centre


def _units(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit rows in double precision from packed components of ``kind``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _packed(kind: str):
    """(rid, n, embedding) to (rid, n, dim, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(x.values, dtype=kind).tobytes() for x in batch.column(2)]
            dims = pa.array([len(x) // int(kind[-1]) for x in raw], type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, pa.array(raw, type=pa.binary())], names=["rid", "n", "dim", "raw"])

    return run


def _rows(centre: np.ndarray) -> int:
    """Vectors that are held against all centroids at a time: a matrix of 4 million at most."""
    return max(16, min(2048, (1 << 22) // len(centre)))


def _home(centre, kind: str):
    """(rid, n, raw) to (rid, n, raw, home); ``centre`` is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        for batch in batches:
            for at in range(0, batch.num_rows, _rows(c)):
                part = batch.slice(at, _rows(c))
                home = (_units(part.column(2), kind) @ c.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32))], names=["rid", "n", "raw", "home"])

    return run


def visits(unit: np.ndarray, home: np.ndarray, centre: np.ndarray, reach: float) -> np.ndarray:
    """Matrix of vectors and cells: whether the vector lies within ``reach`` of the hyperplane that bisects its home and the cell."""
    near = unit @ centre.T
    homes, back = np.unique(home, return_inverse=True)
    gap = np.sqrt(np.maximum(2 - 2 * centre[homes] @ centre.T, 1e-18))
    out = near[np.arange(len(home)), home][:, None] - near <= reach * gap[back]
    out[np.arange(len(home)), home] = True
    return out


def _deal(centre, reach: float, blocks: np.ndarray, kind: str):
    """Each vector once for every pair of blocks it may have a link in; ``own`` is its block, ``blocks`` counts those of a cell."""
    first = np.concatenate([[0], np.cumsum(blocks)])
    cell_of = np.repeat(np.arange(len(blocks)), blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        for batch in batches:
            for at in range(0, batch.num_rows, _rows(c)):
                part = batch.slice(at, _rows(c))
                home, spread = part.column(3).to_numpy(), part.column(4).to_numpy()
                row, other = np.nonzero(visits(_units(part.column(2), kind), home, c, reach)[:, cell_of])
                own = (first[home] + spread % blocks[home])[row]
                take = pa.array(row)
                ends = [pa.array(x.astype(np.int32)) for x in (own, np.minimum(own, other), np.maximum(own, other))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), *ends], names=["rid", "n", "raw", "own", "_i", "_j"])

    return run


def _compare(threshold: float, kind: str):
    def pair(n, unit, left) -> tuple[np.ndarray, np.ndarray]:
        """Links of each row, and its smallest reachable row, within one pair of blocks."""
        full = np.zeros((len(n), len(n)), dtype=bool)
        if left.all():
            full = unit @ unit.T >= threshold
            full |= full.T
            np.fill_diagonal(full, False)
        else:
            u, v = np.flatnonzero(left), np.flatnonzero(~left)
            full[np.ix_(u, v)] = ok = unit[u] @ unit[v].T >= threshold
            full[np.ix_(v, u)] = ok.T
        links = np.zeros(len(n), dtype=np.int64)
        some = np.flatnonzero(full.any(axis=1))
        for at in range(0, len(some), 256):
            links[some[at : at + 256]] = full[some[at : at + 256]] @ n
        return links, spanning_labels(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in sorted_groups(batches, ["_i", "_j"]):
            ends = np.append(starts[1:], rows.num_rows)
            rids, sums, least = [], [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                part = rows.slice(s, e - s)
                left = part["own"].to_numpy() == part["_i"].to_numpy()
                if e - s < 2 or not left.any() or (left.all() and part["_i"][0] != part["_j"][0]):
                    continue
                order = np.argsort(part["rid"].to_numpy(), kind="stable")
                rid = part["rid"].to_numpy()[order]
                links, label = pair(part["n"].to_numpy()[order], _units(part["raw"], kind)[order], left[order])
                at = np.flatnonzero(links)
                rids.append(rid[at])
                sums.append(links[at])
                least.append(rid[label[at]])
            empty = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [empty]).astype(np.int64)) for x in (rids, sums, least)], names=["rid", "links", "least"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing: n_links 0, component_id their own vec_id. Vectors of
    different lengths are never linked; each length is a pass of its own. Repeated rows
    count as other vectors. A null vec_id links with nothing.
    Labels and other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("_ok", F.coalesce(fine, F.lit(False))).withColumn("_h1", F.xxhash64("embedding")).withColumn("_h2", F.xxhash64(F.lit("second"), "embedding"))
    ids = keyed.select("vec_id", "_ok", "_h1", "_h2")
    same = keyed.where("_ok").groupBy("_h1", "_h2").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    distinct = materialize(same, "emb-distinct")
    units = materialize(distinct.select("rid", "n", "embedding").mapInArrow(_packed(kind), "rid long, n long, dim int, raw binary"), "emb-raw")
    found: DataFrame | None = None
    for dim, count in sorted((r["dim"], r["count"]) for r in units.groupBy("dim").count().collect()):
        mine = units.where(F.col("dim") == dim)
        cells = min(MAX_CELLS, -(-count // CELL_BLOCK))
        sample = mine.select("raw", F.xxhash64("raw").alias("h")).orderBy("h").limit(SAMPLE).select("raw").toArrow()["raw"]
        centre = spark.sparkContext.broadcast(fit_centroids(_units(sample, kind), cells))  # MAX_CELLS at most
        homes = materialize(mine.select("rid", "n", "raw").mapInArrow(_home(centre, kind), "rid long, n long, raw binary, home int"), "emb-cells")
        blocks = np.ones(len(centre.value), dtype=np.int64)
        for r in homes.groupBy("home").count().collect():
            blocks[r["home"]] = -(-r["count"] // CELL_BLOCK)
        reach = max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-6
        spread = F.pmod(F.xxhash64("rid"), F.lit(1 << 40)).alias("spread")
        dealt = homes.select("rid", "n", "raw", "home", spread).mapInArrow(_deal(centre, reach, blocks, kind), "rid long, n long, raw binary, own int, _i int, _j int")
        by = ["_i", "_j"]
        part = dealt.repartition(*by).sortWithinPartitions(*by).select(*by, "own", "rid", "n", "raw").mapInArrow(_compare(threshold, kind), "rid long, links long, least long")
        found = part if found is None else found.unionByName(part)
    found = materialize(found if found is not None else spark.createDataFrame([], "rid long, links long, least long"), "emb-links")
    roots = components(found.select(F.col("rid").alias("a"), F.col("least").alias("b")), "emb-cc")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    members = distinct.select("_h1", "_h2", "rid", "n").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    members = members.select("_h1", "_h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rid").alias("component_id"), F.lit(True).alias("_ok"))
    out = ids.join(members, ["_h1", "_h2", "_ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
