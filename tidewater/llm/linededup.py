"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines with a word are hashed. From each line starts the shortest window of
whole lines with ``min_words`` words or more, and the window selects the place
of its smallest line hash, the rightmost one of equal ones. Neighbouring windows
mostly select the same place, which is posted once: the fingerprints are these
minima, far fewer than lines. Any run of lines of ``min_words`` words that two
places share holds a whole window, equal in both, which selects the same line
in both: the guarantee of winnowing, measured in words, so that one long line is
a run as well.

Fingerprints are joined on the minimum's hash: windows whose minimum is posted
once only are done with. For the others the window's lines are compared, by
their common hash, with the first place that has them, in the order of doc_id
and line, so that a common line in unrelated surroundings makes no match. Each
match is extended line by line to both sides as far as the two places agree (an
agreement of ``min_words`` words or more beyond the window holds another window,
which matches by itself), and the lines of the later place are deleted.

Hot minima and hot passages are joined by ``counted_join``, and only texts that
may have deletions are shuffled to them; both work alike at every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_join, materialize, screen

#: What a line with a word has.
WORD = r"[^\x20\x09-\x0D]"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, words): each line with a word; th tells apart texts that share a doc_id.

    A line's words are its runs of other signs than blanks, tabs and the like.
    """
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    counted = lines.withColumn("words", F.regexp_count("line", F.lit(f"{WORD}+")).cast("long")).where("words > 0")
    return counted.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), "words")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Every window: doc_id, th, first and last line numbers (of lines with a word), anchor (its minimum), posted (whether the window before did not select the same place), key, lines before and after."""
    by = Window.partitionBy("doc_id", "th")
    by_line = by.orderBy("pos")
    spread = lines.withColumn("at", F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).withColumn("nth", F.row_number().over(by_line))
    # All else is ordered by the words before a line, so that Spark sorts thin rows once more and no row that holds lists.
    order = by.orderBy("at")
    reach = order.rangeBetween(0, min_words - 1)
    spread = spread.withColumn("last", F.max("nth").over(reach)).withColumn("total", F.sum("words").over(reach)).withColumn("hashes", F.collect_list("h").over(reach))
    spread = spread.withColumn("before", F.collect_list("h").over(order.rangeBetween(-(min_words - 1), -1)))
    # From a line on, the lines that have less than min_words words together: all of its window but the last, which makes it whole. After a window come those of the next line.
    ahead = F.when(F.col("total") < min_words, F.col("hashes")).otherwise(F.slice("hashes", 1, F.size("hashes") - 1))
    spread = spread.withColumn("ahead", F.coalesce(F.lead(ahead).over(order), F.array().cast("array<bigint>")))
    spread = spread.withColumn("after", F.last("ahead").over(reach))
    whole = spread.where(F.col("total") >= min_words).withColumn("anchor", F.array_min("hashes"))
    # The rightmost minimum: its place from the window's end.
    place = F.col("last") + 1 - F.array_position(F.reverse("hashes"), F.col("anchor"))
    whole = whole.select("doc_id", "th", "at", F.col("nth").alias("first"), "last", "anchor", place.alias("place"), F.xxhash64("hashes").alias("key"), "before", "after")
    posted = F.coalesce(F.lag("place").over(order) != F.col("place"), F.lit(True))
    return whole.select("doc_id", "th", "first", "last", "anchor", posted.alias("posted"), "key", "before", "after")


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    short = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), short), lambda i: (i == short) | (F.get(a, i) != F.get(b, i)))
    return F.get(differ, F.lit(0))


def fingerprints(windows: DataFrame) -> DataFrame:
    """(anchor, n): the minima that are posted twice or more."""
    return windows.where("posted").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeats(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, nth): the lines to delete, each once; nth counts lines with a word from 1."""
    windows = materialize(_windows(lines, min_words), "lines-windows")
    met = materialize(fingerprints(windows), "lines-minima")
    met = materialize(counted_join(windows.drop("posted"), met, ["anchor"], "left_semi"), "lines-met")
    by = ["anchor", "key"]
    place = F.struct("doc_id", "th", "first")
    firsts = met.groupBy(*by).agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts, "lines-firsts")
    at_source = firsts.select(*by, "n", "source.*")
    sources = met.join(at_source.hint("shuffle_hash"), [*by, "doc_id", "th", "first"]).select(*by, "n", F.struct("doc_id", "th", "first").alias("source"), F.col("before").alias("s_before"), F.col("after").alias("s_after"))
    later = counted_join(met, materialize(sources, "lines-sources"), by).where(place != F.col("source"))
    left = _agree(F.reverse("before"), F.reverse("s_before"))
    right = _agree(F.col("after"), F.col("s_after"))
    runs = later.select("doc_id", "th", (F.col("first") - left).alias("lo"), (F.col("last") + right).alias("hi"))
    merged = Window.partitionBy("doc_id", "th").orderBy("lo", "hi")
    runs = runs.withColumn("seen", F.max("hi").over(merged.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = runs.withColumn("lo", F.greatest("lo", F.coalesce(F.col("seen") + 1, "lo"))).where("lo <= hi")
    return fresh.select("doc_id", "th", F.explode(F.sequence("lo", "hi")).alias("nth"))


def dedup(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """``docs`` with later repeats of runs of ``min_words`` words or more deleted from ``text``; adds n_deleted.

    Every row comes back, with all its other columns (a column n_deleted of its own is replaced, and n_chars,
    if there is one, is counted anew for changed texts); a text all of whose lines repeat becomes empty. Order is by doc_id, then by a hash of the text where a
    doc_id is shared, then by line; repeats within one text count too. Rows with
    a null doc_id or text come back as they are. Rows that repeat both doc_id and
    text are one document and stay alike. Lines without a word are never run
    members and stay. An empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    lines = line_table(keyed).repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    gone = repeats(lines, min_words).groupBy("doc_id", "th").agg(F.collect_set("nth").alias("_gone"))
    gone = materialize(gone, "lines-gone")
    columns = [c for c in docs.columns if c != "n_deleted"]
    text = F.col("text").cast("string")
    # All columns in one, so that none can clash with those of the join; the text, which may change, goes beside them and not twice.
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"), F.struct(*(c for c in columns if c != "text")).alias("row"))
    whole, touched = screen(rows, F.when(F.col("text").isNotNull(), F.struct("doc_id", "th")), gone, F.struct("doc_id", "th"))
    joined = touched.join(gone.hint("shuffle_hash"), ["doc_id", "th"], "left").withColumn("n_deleted", F.coalesce(F.size("_gone"), F.lit(0)))
    joined = joined.withColumn("text", F.when(F.col("n_deleted") > 0, _without(F.col("text"), F.col("_gone"))).otherwise(F.col("text"))).drop("_gone")

    def out(found: DataFrame) -> DataFrame:
        def of(c: str) -> Column:
            if c == "n_chars":
                return F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType)
            return F.col("text") if c == "text" else F.col("row")[c]

        return found.select(*(of(c).alias(c) for c in columns), "n_deleted")

    return out(whole.withColumn("n_deleted", F.lit(0))).unionByName(out(joined))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once although lambdas inside ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the ``gone``-th of its lines with a word."""

    def of_lines(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        dropped = _bind(places, lambda p: F.transform(gone, lambda n: F.get(p, n - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return _bind(F.split(text, "\n", -1), of_lines)
