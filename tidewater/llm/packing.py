"""Best-fit packing by bulk-synchronous supersteps.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens, and
pieces are range-sorted by length, longest first. Pieces longer than half the
capacity open a sequence each; all others are placed by supersteps:

1. pieces and gaps are range-sorted together by size, largest first;
2. a successor sweep gives every piece the smallest gap that holds it and that
   no longer piece has taken. Read from the largest down, gaps and pieces match
   like brackets, the piece closing the gap opened last; a prefix sum over the
   classes of equal size gives each bracket its depth, and within a class the
   rank resolves who takes which gap: pairs are neighbours of one depth, of which
   each has a few rows, so the sweep runs in as many tasks as there are;
3. gaps are updated, and the next superstep goes on, until no piece fits a gap.

Short pieces are dealt in bundles of one length, which are halved from step to
step, so that a gap need not take them one by one. Where no gap holds any of the
pieces that are left, as many sequences are opened as their tokens need at
least, by the longest of them: those of which q fit in a sequence fill it q by
q; and the supersteps go on. The tables of classes have a row a size, at most
twice ``capacity``; nothing else is broadcast or gathered.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, local_table, materialize, measured, numbered

#: Pieces up to this share of the capacity are dealt in bundles.
SHORT = 1 / 16
_OTHER = re.compile("[^\x00-\x7f\xa1-\u017f]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _special(path: str) -> re.Pattern | None:
    """Texts of added tokens, which ``tokenizers`` takes out of a text before it splits it."""
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, added))) if added else None


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The same vocabulary as merge ranks, where a file of the same name has it; else None."""
    if not (path.endswith(".json") and os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken")):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Token ids by ``tokenizers``.

    Texts of Latin letters (below U+0180, no C1 controls) go through the same
    vocabulary and splitting pattern as merge ranks, which gives the same ids
    four times as fast; the two libraries could only differ in the Unicode
    classes of other letters, whose texts go through ``tokenizers`` itself, and
    so do texts that spell out a special token.
    """
    ranked, special = _ranked(path), _special(path)
    plain = [ranked is not None and not _OTHER.search(x) and not (special and special.search(x)) for x in texts]
    rest = [x for x, fast in zip(texts, plain) if not fast]
    slow = iter(_tokenizer(path).encode_batch_fast(rest, add_special_tokens=False) if rest else ())
    return [ranked.encode_ordinary(x) if fast else next(slow).ids for x, fast in zip(texts, plain)]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces; only the first may be shorter than the capacity."""
    first = len(ids) % capacity or min(len(ids), capacity)
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    return [(s, ids[s:e]) for s, e in zip(bounds, bounds[1:])]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the token pieces of each document, its end id included.

    A null text is an empty one; it has one piece that holds the end id only.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        out: list[list] = [[], [], [], [], [], []]
        docs_ids = batch.column(0).to_pylist()
        for at in range(0, len(texts), 64):
            for doc_id, found in zip(docs_ids[at : at + 64], encode(texts[at : at + 64], path)):
                ids = np.array([*found, end_id], dtype="<u4")
                for n, (start, part) in enumerate(cut(ids, capacity)):
                    for column, x in zip(out, (doc_id, n, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        arrays = [pa.array(x, type=t) for x, t in zip(out, kinds)][: 6 if with_ids else 5]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def _open(left: DataFrame, counts: dict[int, int], capacity: int, first: int, need: int | None = None) -> tuple[DataFrame, DataFrame, int, int, int]:
    """(placed(id, sequence_id, offset), gaps(seq, gap), the widest gap, sequences opened, pieces placed) after opening ``need`` sequences, or as many as ``left(g, id, length)`` needs at least.

    ``g`` numbers ``left`` from the longest piece on, so the pieces placed are the first ones; ``counts`` has
    the number of pieces of each length. Sequences are numbered from ``first``.
    """
    need = -(-sum(x * n for x, n in counts.items()) // capacity) if need is None else need
    held: dict[int, list[int]] = {}  # by pieces that fit in a sequence, fewest first: where they start, how many there are
    at = before = end = 0
    for x in sorted(counts, reverse=True):
        held.setdefault(capacity // x, [at, 0])[1] += counts[x]
        at += counts[x]
    bands = []
    for q, (start, n) in held.items():
        bands.append((q, start, before))
        if before < need:
            end = start + min(n, (need - before) * q)
        before += -(-n // q)
    dealt = left.where(F.col("g") < end).withColumn("q", F.floor(capacity / F.col("length")))
    dealt = dealt.join(F.broadcast(local_table(left.sparkSession, "q start before", bands)), "q")
    own = Window.partitionBy("seq").orderBy("g")
    inside = dealt.withColumn("seq", F.col("before") + F.floor((F.col("g") - F.col("start")) / F.col("q")) + first)
    offset = F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = capacity - F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = inside.select("id", F.col("seq").alias("sequence_id"), offset.alias("offset"), gap.alias("gap"))
    placed, seen = measured(inside, "pack-opened", widest=F.max("gap"))
    gaps = placed.where("offset = 0 AND gap > 0").select(F.col("sequence_id").alias("seq"), "gap")
    return placed.drop("gap"), gaps, seen["widest"] or 0, min(need, before), end


def _levels(placed: DataFrame) -> DataFrame:
    """A row for each class of equal size and kind and each part of ``placed``: part, size, kind, c, base.

    c numbers the classes in order; base is the depth of a row less, or for pieces plus, its place in the part.
    """
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.groupBy("_part", "size", "kind").agg(F.count(F.lit(1)), F.min(place)).collect()
    out, c, before = [], 0, None
    high = low = was = rank = 0
    for part, size, kind, n, start in sorted(found, key=lambda r: (-r[1], r[2], r[0])):
        if before != (size, kind):
            # Open gaps: what the lowest point so far falls short of zero never opened.
            c, before, was, rank = c + 1, (size, kind), high - low, 0
        out.append((part, size, kind, c, was - rank + start if kind else was + 1 + rank - start))
        rank += n
        high += -n if kind else n
        low = min(low, high)
    return local_table(placed.sparkSession, "_part size kind c base", out)


def _matched(gaps: DataFrame, items: DataFrame) -> DataFrame:
    """kind, size, a, b of ``gaps(seq, gap)`` (kind 0, a: seq) and ``items(size, a, b)`` (kind 1), with ``next``, what a gap takes, and ``prev``, what takes an item, or nulls."""
    both = gaps.select(F.col("gap").alias("size"), F.lit(0).cast("long").alias("kind"), F.col("seq").alias("a"), F.lit(0).cast("long").alias("b"))
    both = both.unionByName(items.select("size", F.lit(1).cast("long").alias("kind"), "a", "b"))
    order = [F.desc("size"), F.col("kind"), F.xxhash64("a", "b"), F.col("a"), F.col("b")]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed, "pack-sweep").withColumn("_part", F.shiftright("_m", 33))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    depth = F.col("base") + F.when(F.col("kind") == 0, place).otherwise(-place)
    # Depths of pieces for which no gap is open are 0 and less, where no gap is.
    levelled = placed.join(F.broadcast(_levels(placed)), ["_part", "size", "kind"]).withColumn("depth", depth)
    own, other = Window.partitionBy("depth").orderBy("c"), F.struct("kind", "size", "a", "b")
    levelled = levelled.withColumn("next", F.lead(other).over(own)).withColumn("prev", F.lag(other).over(own))
    taken, held = F.when(F.col("next.kind") == 1, F.col("next")), F.when(F.col("prev.kind") == 0, F.col("prev"))
    return levelled.select("kind", "size", "a", "b", F.when(F.col("kind") == 0, taken).alias("next"), F.when(F.col("kind") == 1, held).alias("prev"))


def _sweep(gaps: DataFrame, items: DataFrame) -> DataFrame:
    """``gaps(seq, gap)`` with what each takes of ``items(size, a, b)``: size, a, b, or nulls."""
    return _matched(gaps, items).where("kind = 0").select(F.col("a").alias("seq"), F.col("size").alias("gap"), "next.size", "next.a", "next.b")


def _singles(left: DataFrame, gaps: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(placed, gaps, left, the shortest piece left, the widest gap; 0 where there are none) after one superstep over the pieces of ``left(id, length)``."""
    found = _matched(gaps, left.select(F.col("length").alias("size"), F.col("length").alias("a"), F.col("id").alias("b")))
    gap = F.when(F.col("kind") == 0, F.col("size") - F.coalesce("next.size", F.lit(0)))
    found = found.select("kind", F.col("b").alias("id"), F.col("size").alias("length"), F.coalesce("prev.a", "a").alias("seq"), gap.alias("gap"), (capacity - F.col("prev.size")).alias("offset"))
    stays = F.col("offset").isNull() & (F.col("kind") == 1)
    done, seen = measured(found, "pack-step", shortest=F.min(F.when(stays, F.col("length"))), widest=F.max("gap"))
    placed = done.where("offset IS NOT NULL").select("id", F.col("seq").alias("sequence_id"), "offset")
    return placed, done.where("gap > 0").select("seq", "gap"), done.where(stays).select("id", "length"), seen["shortest"] or 0, seen["widest"] or 0


def _bundles(left: DataFrame, gaps: DataFrame, capacity: int, bundle: Column) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """As ``_singles``, over the bundles of one length of ``left(id, length, r)``."""
    keyed = left.withColumn("a", F.col("length")).withColumn("b", bundle.cast("long"))
    pairs, seen = measured(_sweep(gaps, keyed.groupBy("a", "b").agg(F.sum("length").alias("size"))), "pack-pairs", widest=F.max(F.col("gap") - F.coalesce("size", F.lit(0))))
    taken = pairs.where("size IS NOT NULL").select("a", "b", "seq", (capacity - F.col("gap")).alias("at"))
    joined = keyed.join(taken.hint("shuffle_hash"), ["a", "b"], "left")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("id")) - 1
    joined = joined.withColumn("offset", F.col("at") + place * F.col("length"))
    joined, least = measured(joined, "pack-step", shortest=F.min(F.when(F.col("seq").isNull(), F.col("length"))))
    placed = joined.where("seq IS NOT NULL").select("id", F.col("seq").alias("sequence_id"), "offset")
    gaps = pairs.select("seq", (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap")).where("gap > 0")
    return placed, gaps, joined.where("seq IS NULL").select(*left.columns), least["shortest"] or 0, seen["widest"] or 0


def place(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset. ``cut_pieces`` needs doc_id, piece, ids_crc32 and length.

    First, pieces longer than half the capacity open a sequence each, as they
    must. From then on as many are opened as the tokens that are left need at
    least; half of them at least are placed so each time, which ends the loop.
    """
    order = [F.desc("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece")]
    every = numbered(cut_pieces, order, "pack-sorted")
    left = every.select("g", F.col("g").alias("id"), "length")
    found, first, short = [], 0, int(capacity * SHORT)
    while counts := dict(left.groupBy("length").agg(F.count(F.lit(1))).collect()):  # a row a length
        again = bool(found)
        half = sum(n for x, n in counts.items() if x > capacity // 2)
        placed, gaps, widest, opened, end = _open(left, counts, capacity, first, half if half and not again else None)
        first += opened
        found.append(placed)
        left, starts, at = left.where(F.col("g") >= end), [], 0
        for x in sorted(counts, reverse=True):
            if at + counts[x] > end:
                starts.append((x, max(at, end)))
            at += counts[x]
        tall, low = left.where(F.col("length") > short).select("id", "length"), left.where(F.col("length") <= short)
        shortest = min((x for x, _ in starts if x > short), default=0)
        least = min((x for x, _ in starts if x <= short), default=0)
        while shortest and shortest <= widest:
            placed, gaps, tall, shortest, widest = _singles(tall, gaps, capacity)
            found.append(placed)
        # Short pieces fill what is left in the end.
        if again or not shortest:
            low = low.join(F.broadcast(local_table(left.sparkSession, "length _s", starts)), "length").select("id", "length", (F.col("g") - F.col("_s")).alias("r"))
            total = capacity
            while least and least <= widest:
                total = min(total, 1 << (widest.bit_length() - 1))
                bundle = F.floor(F.col("r") / F.greatest(F.lit(1), F.floor(total / F.col("length"))))
                placed, gaps, low, least, widest = _bundles(low, gaps, capacity, bundle)
                found.append(placed)
                total = total // 2 or 1  # single pieces until none fits
        if not (shortest or least):
            break
        left = numbered(tall.unionByName(low.select("id", "length")), [F.desc("length"), F.col("id")], "pack-sorted")
    where = local_table(cut_pieces.sparkSession, "id sequence_id offset", [])
    for placed in found:
        where = where.unionByName(placed.select("id", F.col("sequence_id").cast("long"), F.col("offset").cast("long")))
    return every.join(where.withColumnRenamed("id", "g"), "g").drop("g")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every row of ``docs(doc_id, text)`` is packed: repeated rows repeatedly, null
    and empty texts as their end id alone. Other columns are not read. An empty
    table gives an empty result.
    """
    cut_pieces = materialize(pieces(docs, path or vocabulary_path(), capacity, end_id, with_ids), "pack-pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return place(cut_pieces, capacity).select(*out)
