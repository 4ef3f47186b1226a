"""Chat formatting by cumulative-snapshot collapse, with DataFrame functions only.

A conversation logged after each turn leaves snapshots that are prefixes of the
longest one. Each turn's hash is keyed by its place; a prefix's hash is the
exclusive or of its turns' hashes, in two independent 64-bit halves, which
rolls forward turn by turn and can be summed up over parts of a conversation.
Whole conversations with equal hashes collapse to the smallest conv_id, and an
anti-join against the proper prefixes of all others retains the maximal ones.
What is retained is rendered.

All turns are range-sorted together, so a conversation that holds a large share
of them is numbered by many tasks, whatever its turn numbers are. Its turns are
hashed and rendered in parts of ``PART`` of them, and joins by conversation
leave the turns of large ones where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_join, counted_parts, materialize, numbered

#: Turns of a part of a conversation; rendered rows hold one part.
PART = 1024
#: Characters by which turns with the same number are dealt to ranges, before they are sorted by their whole texts.
BEGIN = 64


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, role, text, g: cleaned turns, each once, numbered in order; conv_id, start, n: each conversation's first number and how many)."""
    clean = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    begin = [F.left(c, F.lit(BEGIN)) for c in ("role", "text")]
    turns = numbered(clean, [F.col(c) for c in ("conv_id", "turn", "role", "text")], "chat-turns", [F.col("conv_id"), F.col("turn"), *begin])
    return turns, materialize(turns.groupBy("conv_id").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "chat-starts")


def _prefixes(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, n, h1, h2: the rolled hashes of each conversation's first n turns. Texts stay behind."""
    slim = turns.select("conv_id", "g", F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit("second"), "text", "role").alias("x2"))
    placed = counted_join(slim, starts, ["conv_id"]).withColumn("n", F.col("g") - F.col("start") + 1).withColumn("part", F.floor((F.col("n") - 1) / PART))
    hashed = placed.select("conv_id", "part", "n", F.xxhash64("n", "x1").alias("t1"), F.xxhash64("x2", "n").alias("t2"))
    run = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(hashed.select("conv_id", "part", "n", F.bit_xor("t1").over(run).alias("l1"), F.bit_xor("t2").over(run).alias("l2")), "chat-hashed")
    # A part's last turn has the part's sum.
    sums = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("l1", "l2"), "n").alias("s"))
    parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"s.{c}").over(parts), F.lit(0)).alias(b) for c, b in (("l1", "b1"), ("l2", "b2"))]
    halves = [F.col(b).bitwiseXOR(F.col(c)).alias(h) for c, b, h in (("l1", "b1", "h1"), ("l2", "b2", "h2"))]
    return local.join(sums.select("conv_id", "part", *before), ["conv_id", "part"]).select("conv_id", "n", *halves)


def collapse(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of all conversations, (conv_id, start, n_turns, n_same) of the maximal ones)."""
    turns, starts = _turns(conversations)
    prefixes = materialize(_prefixes(turns, starts), "chat-rolled")
    by = ["n", "h1", "h2"]
    whole = prefixes.join(starts.select("conv_id", "n"), ["conv_id", "n"])
    same = whole.groupBy(*by).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    proper = prefixes.join(starts.select("conv_id", "n"), ["conv_id", "n"], "left_anti").select(*by).distinct()
    kept = same.join(proper, by, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_same")
    return turns, materialize(kept.join(starts.select("conv_id", "start"), "conv_id"), "chat-maximal")


def render(turns: DataFrame, maximal: DataFrame, template: tuple[str, str, str] = ("<|", "|>\n", "\n")) -> DataFrame:
    """One row per part of a maximal conversation: conv_id, part, n_turns, n_same, first_turn, rendered."""
    opening, middle, closing = template
    line = F.concat(F.lit(opening), "role", F.lit(middle), "text", F.lit(closing))

    def joined(part: DataFrame) -> DataFrame:
        """Turns dealt by conversation are grouped where they are."""
        placed = part.select("conv_id", "n_turns", "n_same", (F.col("g") - F.col("start") + 1).alias("n"), line.alias("line"))
        ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
        grouped = placed.groupBy("conv_id", F.floor((F.col("n") - 1) / PART).alias("part")).agg(F.first("n_turns").alias("n_turns"), F.first("n_same").alias("n_same"), ordered.alias("lines"))
        text: Column = F.array_join(F.transform("lines", lambda x: x["line"]), "")
        return grouped.select("conv_id", F.col("part").cast("long"), "n_turns", "n_same", F.get("lines", F.lit(0))["n"].alias("first_turn"), text.alias("rendered"))

    hot, cold = counted_parts(turns, maximal.withColumn("n", F.col("n_turns")), ["conv_id"])
    return joined(hot).unionByName(joined(cold))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations of ``conversations(conv_id, turn, role, text)``.

    Turns are ordered by turn, role and text (a null turn is turn 0, null roles
    and texts are empty); a turn repeated whole counts once. Rows without conv_id
    are no conversation and are left out. Of equal conversations the smallest
    conv_id stays, and n_same counts them. Conversations of up to 1,024 turns
    make one row, whatever their turn numbers, longer ones a row for each 1,024
    turns. Other columns are not read; an empty table gives an empty result.
    """
    return render(*collapse(conversations))
