"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. At most three differing bits leave at
least five bytes equal in place, which is the guaranteed minimum the count
filter asks for. Posting lists of one byte would grow with the square of the
corpus, so postings are kept for four positions together: the fourteen planes
of the affine space over the positions 0..7 (four positions whose exclusive or
is 0). Any three positions lie in one plane and the complement of a plane is a
plane, so whichever three bytes differ, one plane of four equal bytes remains:
no pair is lost, and a posting key has 32 bits instead of 8. Within a posting
list the shared positional bytes of each pair are tallied, pairs with five or
more are retained, and their bits are compared.

Lists longer than ``SPLIT`` are posted anew by a fifth byte: of the four bytes
that a plane leaves, three differing bits leave one equal. Lists are dealt to
bounded pairs of blocks, and a pair of blocks returns at most one spanning edge a fingerprint, so neither copies nor near copies are
expanded to pairs. Equal fingerprints are collapsed before the index is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, arrow_map, block_pairs, components, materialize, screen, sorted_groups, spanning_labels, text_bytes

BYTES, MAX_BITS = 8, 3
MIN_SHARED = BYTES - MAX_BITS
#: Postings of a list, at most, unless its members share a fifth byte too.
SPLIT = 4 * BLOCK
#: Groups up to this size are compared by shifts of the whole sorted batch.
SMALL = 12


def planes() -> list[tuple[int, ...]]:
    """The fourteen sets of four byte positions with exclusive or 0."""
    return [p for p in combinations(range(BYTES), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text: XXH64 (seed 42) of its word shingles, repeats included."""
    w = text.lower().split()  # bytes: only A-Z change, and only 0x20 and 0x09-0x0D separate
    if not w:
        return 0
    whole = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [h(whole, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [h(whole[s:e], 42) for s, e in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())]
    values = np.array(hashes, dtype="<u8")
    set_in = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; texts without words and nulls have 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint_of(x, words) for x in text_bytes(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of pairs that share five positional bytes or more and differ in three bits or fewer."""
    x, y = a.view(np.uint8).reshape(-1, BYTES), b.view(np.uint8).reshape(-1, BYTES)
    shared = np.zeros((len(a), len(b)), dtype=np.uint8)
    for p in range(BYTES):
        shared += x[:, p, None] == y[None, :, p]
    out = shared >= MIN_SHARED
    i, j = np.nonzero(out)
    out[i, j] = np.bitwise_count(a[i].view(np.uint64) ^ b[j].view(np.uint64)) <= MAX_BITS
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, starts in sorted_groups(batches, ["plane", "key", "fifth", "_i", "_j"]):
        fp, own, i = rows["fp"].to_numpy(), rows["_b"].to_numpy(), rows["_i"].to_numpy()
        ends = np.append(starts[1:], len(fp))
        sizes = ends - starts
        group = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[group] <= SMALL
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lag in range(1, min(SMALL, len(fp))):
            at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            if not len(at):
                break
            x, y = fp[at], fp[at + lag]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == y.view(np.uint8).reshape(-1, BYTES)).sum(axis=1)
            at = np.flatnonzero(shared >= MIN_SHARED)
            at = at[np.bitwise_count(x[at].view(np.uint64) ^ y[at].view(np.uint64)) <= MAX_BITS]
            found.append((x[at], y[at]))
        for g in np.flatnonzero(sizes > SMALL):
            part = slice(starts[g], ends[g])
            order = np.argsort(fp[part], kind="stable")
            f, left = fp[part][order], (own[part] == i[starts[g]])[order]
            matrix = np.zeros((len(f), len(f)), dtype=bool)
            if left.all() or not left.any():
                matrix = linked(f, f)
            else:
                u, v = np.flatnonzero(left), np.flatnonzero(~left)
                matrix[np.ix_(u, v)] = cross = linked(f[u], f[v])
                matrix[np.ix_(v, u)] = cross.T
            label = spanning_labels(matrix)
            at = np.flatnonzero(label != np.arange(len(f)))
            found.append((f[at], f[label[at]]))
        a = np.concatenate([x for x, _ in found] or [fp[:0]])
        b = np.concatenate([y for _, y in found] or [fp[:0]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _split(postings: DataFrame) -> DataFrame:
    """``postings(fp, plane, key)`` with ``fifth``: -1, or in lists longer than ``SPLIT`` one row for each byte outside the plane, its place and value."""
    left = ", ".join(str(p) for plane in planes() for p in range(BYTES) if p not in plane)
    places = F.expr(f"slice(array({left}), plane * 4 + 1, 4)")
    fifth = F.transform(places, lambda p: p * 256 + F.call_function("shiftright", F.col("fp"), p * 8).bitwiseAND(F.lit(255)).cast("int"))
    long = postings.groupBy("plane", "key").agg(F.count(F.lit(1)).alias("_long")).where(F.col("_long") > SPLIT)
    held = postings.join(long.hint("shuffle_hash"), ["plane", "key"], "left")
    return held.select("fp", "plane", "key", F.explode(F.when(F.col("_long").isNull(), F.array(F.lit(-1))).otherwise(fifth)).alias("fifth"))


def link(distinct: DataFrame) -> DataFrame:
    """Spanning edges (a, b) between the different fingerprints ``distinct(fp)`` at three bits or fewer."""
    masks = [sum(0xFF << (8 * p) for p in plane) for plane in planes()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(n).alias("plane"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)))
    postings = distinct.select("fp", F.explode(keys).alias("_k")).select("fp", "_k.plane", "_k.key")
    dealt = block_pairs(_split(postings), ["plane", "key", "fifth"], F.col("fp"))
    by = ["plane", "key", "fifth", "_i", "_j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).select(*by, "_b", "fp").mapInArrow(_edges, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of three differing
    bits or fewer, the row's own included. Null and empty texts, and texts of
    separators only, have fingerprint 0 and are linked like any other. Repeated
    rows come out repeated. A null doc_id is never a component_id unless the
    component has no other. Other columns of ``docs`` are not read. An empty
    table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(link(distinct.select("fp")), "simhash-cc")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(members, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` without the rows that are not the first of their component; columns unchanged.

    Only texts whose id may be that of a later copy, by a bitmap of fixed size, are shuffled to
    the ids. Rows whose doc_id is null are kept. Of rows that share a doc_id, all are kept
    or none: none if one of them is a later copy.
    """
    gone = near_duplicates(docs, words).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "simhash-gone")
    whole, rest = screen(docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("row")), F.col("_id"), gone, F.col("_gone"))
    kept = rest.join(gone.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_anti")
    return whole.unionByName(kept).select("row.*")
