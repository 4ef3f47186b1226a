"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Plain patterns find e-mail addresses, IP addresses, card and telephone numbers.
These are the seed entities, and so are words that look like keys: long, of
letters and digits mixed, as access tokens and digests are. The two words before
a seed and the two words after it are its lexical patterns. Other words that
hold a digit or an at sign are candidates with the same kinds of patterns.
Patterns and instances make a graph, whose edges are counted over the whole
corpus; a pattern's confidence is the share of its different instances that are
believed, an instance's is that of its best pattern. After ``rounds`` passes,
candidates (words like keys are candidates, too) at a pattern of high confidence
and support are added as spans of the kind ``context``. A word like a key that
no such pattern vouches for is not added.

Positions are found without any UDF: split() and regexp_extract_all() walk
over the same matches, so the lengths of gaps and matches, summed up in order,
give starts and ends in code points. The expressions below match what the plain
ones match, but start only where a match can start and never backtrack into a
run, so that a long run of letters or digits takes linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_join, materialize

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
#: Java expressions equal in their matches to the plain ones of the contract.
EXPRESSIONS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
)
#: Signs that are not part of a candidate at its ends.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|="
#: Code points and matches before a span that are looked at first, and the length from which a pattern stands as its digest.
NEAR, BACK, LONG = 96, 8, 256
LEAST_LENGTH = 5
#: A word like a key: signs of keys only, this many of them at least, and this many digits and letters among them at least.
KEY_LENGTH, KEY_EACH = 20, 4


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    parts = F.split(match, r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.expr("1") * F.ltrim(F.right(p, F.lit(3)), F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == 1, small).when(kind == 2, F.when(size.between(13, 19), _luhn(digits)).otherwise(F.lit(False))).when(kind == 3, size.between(9, 15)).otherwise(F.lit(True))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, match, context, after) of every match of every kind, candidates included.

    ``docs`` needs doc_id, text and th, a hash of the text that tells apart
    rows that share a doc_id. Rows that repeat a whole doc_id and text count once.
    """
    some = docs.where(F.col("text").rlike("[0-9@]"))

    def kind(n: int, when: Column) -> Column:
        pattern = F.lit(EXPRESSIONS[n])
        none = F.array().cast("array<string>")
        gaps = F.when(when, F.split("text", pattern, -1)).otherwise(none)
        found = F.when(when, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none)
        return F.struct(F.lit(n).alias("kind"), gaps.alias("gap"), found.alias("match"))

    at, dot, plus = F.col("text").contains("@"), F.col("text").contains("."), F.col("text").contains("+")
    kinds = F.array(*(kind(n, w) for n, w in enumerate((at, dot, F.lit(True), plus, F.lit(True)))))
    each = some.select("doc_id", "th", F.inline(kinds)).where(F.size("match") > 0)
    rows = each.select("doc_id", "th", "kind", F.posexplode(F.arrays_zip("gap", "match", _contexts(True).alias("context"), _contexts(False).alias("after"))).alias("n", "x")).where("x.match IS NOT NULL")
    slim = rows.select("doc_id", "th", "kind", "n", F.length("x.gap").alias("gap"), "x.match", "x.context", "x.after")
    slim = slim.repartition("doc_id", "th", "kind").dropDuplicates(["doc_id", "th", "kind", "n"])
    order = Window.partitionBy("doc_id", "th", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ended = slim.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(order)).withColumn("start", F.col("end") - F.length("match"))
    return ended.where(_valid(F.col("kind"), F.col("match"))).select("doc_id", "th", "kind", "start", "end", "match", "context", "after")


def _contexts(back: bool) -> Column:
    """The pattern before each match (``back``) or after it, from the whole text on that side: gaps and matches of its kind, put together again.

    Mostly the nearest few hold two whole words; only where they don't is all text on that side read.
    """

    def text(first: Column, last: Column, cut: Callable[[Column], Column]) -> Column:
        """Gaps ``first`` to ``last`` and the matches between them; numbers that do not exist add nothing."""
        one = F.transform(F.sequence(first, last - 1), lambda j: F.concat(cut(F.get("gap", j)), F.get("match", j)))
        return F.concat(F.array_join(F.when(first < last, one).otherwise(F.array()), ""), F.coalesce(cut(F.get("gap", last)), F.lit("")))

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def before(i: Column) -> Column:
        tail = F.right(text(F.greatest(i - BACK, F.lit(0)), i, lambda gap: F.right(gap, F.lit(NEAR))), F.lit(NEAR))
        enough = lambda t: ((i <= BACK) & (F.length(t) < NEAR)) | t.rlike(r"\s\S++\s++\S++\s*+$")
        return bound(tail, lambda t: F.when(enough(t), t).otherwise(text(F.lit(0), i, lambda gap: gap)))

    def behind(i: Column) -> Column:
        end = F.size("gap") - 1
        head = F.left(text(i + 1, F.least(i + 1 + BACK, end), lambda gap: F.left(gap, F.lit(NEAR))), F.lit(NEAR))
        enough = lambda t: ((i + 1 + BACK >= end) & (F.length(t) < NEAR)) | t.rlike(r"^\s*+\S++\s++\S++\s")
        return bound(head, lambda t: F.when(enough(t), t).otherwise(text(i + 1, end, lambda gap: gap)))

    def of(i: Column) -> Column:
        words = bound(before(i) if back else behind(i), lambda t: _context(t, back))
        return bound(words, lambda c: F.when(F.length(c) > LONG, F.md5(c.cast("binary"))).otherwise(c))

    return F.transform(F.col("match"), lambda _, i: of(i))


def _context(text: Column, back: bool) -> Column:
    """The last two words of the text (the first two if not ``back``), lower-case, digits as 0; empty where there is none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\s]+"), lambda w: w != "")
    return F.array_join(F.when(F.size(words) > 2, F.slice(words, -2 if back else 1, 2)).otherwise(words), " ")


def _candidates(found: DataFrame) -> DataFrame:
    """Candidates without signs at their ends, which no seed overlaps, beside the seeds."""
    lead = F.length("match") - F.length(F.ltrim("match", F.lit(EDGES)))
    core = F.rtrim(F.ltrim("match", F.lit(EDGES)), F.lit(EDGES))
    core = F.when(F.col("kind") == CANDIDATE, core).otherwise(F.col("match"))
    begin = F.col("start") + F.when(F.col("kind") == CANDIDATE, lead).otherwise(0)
    own = found.withColumn("core", core).withColumn("begin", begin).withColumn("finish", F.col("begin") + F.length("core"))
    seed = F.col("kind") < CANDIDATE
    before = Window.partitionBy("doc_id", "th").orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "th").orderBy(F.desc("begin"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(seed, F.col("finish"))).over(before)
    next_seed = F.min(F.when(seed, F.col("begin"))).over(after)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("begin")) & (F.coalesce(next_seed, F.col("finish")) >= F.col("finish"))
    return own.withColumn("_free", free).where(seed | (F.col("_free") & (F.length("core") >= LEAST_LENGTH))).drop("_free")


def _key_like(core: Column) -> Column:
    others = F.length(F.regexp_replace(core, "[0-9]", ""))
    letters = F.length(core) - F.length(F.regexp_replace(core, "[A-Za-z]", ""))
    return core.rlike(f"^[A-Za-z0-9+/_=-]{{{KEY_LENGTH},}}$") & (F.length(core) - others >= KEY_EACH) & (letters >= KEY_EACH)


def _patterns() -> Column:
    """A match's patterns: the words before it and the words after it, where there are any."""
    sides = F.array(F.when(F.col("context") != "", F.concat(F.lit("< "), "context")), F.when(F.col("after") != "", F.concat(F.lit("> "), "after")))
    return F.filter(sides, lambda p: p.isNotNull())


def confident_patterns(graph: DataFrame, rounds: int, least_support: int, least_confidence: float) -> DataFrame:
    """(context, confidence, support) of the patterns that may add spans.

    ``graph(context, instance, seed)`` has one row per edge. Patterns without
    ``least_support`` different instances have no say. Edges of hot instances and
    patterns stay where they are in the joins.
    """
    seeds = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"), F.count(F.lit(1)).alias("n"))
    believed = materialize(seeds, "pii-belief")
    patterns = None
    for _ in range(rounds):
        rated = counted_join(graph, believed, ["instance"]).groupBy("context").agg(F.avg("belief").alias("confidence"), F.count(F.lit(1)).alias("support"))
        patterns = materialize(rated.where((F.col("support") >= least_support) & (F.col("confidence") > 0)), "pii-patterns")
        reached = counted_join(graph, patterns.select("context", "confidence", F.col("support").alias("n")), ["context"])
        told = reached.select("instance", F.col("confidence").alias("belief"), F.lit(0).cast("long").alias("n")).unionByName(believed)
        # A belief never falls: what a pattern said of an instance in an earlier round holds, seeds are 1.
        believed = materialize(told.groupBy("instance").agg(F.max("belief").alias("belief"), F.max("n").alias("n")), "pii-belief")
    return patterns.where(F.col("confidence") >= least_confidence)


def find(docs: DataFrame, rounds: int = 3, least_support: int = 5, least_confidence: float = 0.6) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans.

    A null text is an empty one and has no spans. Repeated rows come out
    repeated, with the same spans; rows that share a doc_id but not the text are
    kept apart. Other columns are not read; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    ids = slim.select("doc_id", "th")
    found = materialize(_candidates(matches(slim)), "pii-matches")
    each = found.select("*", F.explode(_patterns()).alias("pattern"))
    seed = (F.col("kind") < CANDIDATE) | _key_like(F.col("core"))
    graph = each.groupBy(F.col("pattern").alias("context"), F.xxhash64(F.lower("core")).alias("instance")).agg(F.max(seed).alias("seed"))
    patterns = confident_patterns(materialize(graph, "pii-graph"), rounds, least_support, least_confidence)
    free = each.where(F.col("kind") == CANDIDATE)
    rows = free.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    told = materialize(rows.join(patterns.select(F.col("context").alias("pattern")), "pattern", "left_semi"), "pii-told")
    good = counted_join(free, told, ["pattern"], "left_semi").select("doc_id", "th", "kind", "begin", "finish").distinct()
    spans = found.where(F.col("kind") < CANDIDATE).select(*good.columns).unionByName(good)
    one = F.struct("kind", F.col("begin").alias("start"), F.col("finish").alias("end"))
    by_doc = spans.groupBy("doc_id", "th").agg(*(F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate((*KINDS, "context"))), F.array_sort(F.collect_list(one)).alias("all"))
    names = F.array(*map(F.lit, (*KINDS, "context")))

    def text(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")

    by_doc = by_doc.withColumn("base", text(F.filter("all", lambda r: r["kind"] < CANDIDATE))).withColumn("spans", text(F.col("all"))).drop("all")
    here = by_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    out = ids.join(here, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*KINDS, "context")]
    base = F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256")
    every = sum((F.coalesce(f"n_{k}", F.lit(0)) for k in KINDS), F.coalesce("n_context", F.lit(0))).cast("long").alias("n_spans")
    return out.select("doc_id", *counts[:4], base, F.coalesce("spans", F.lit("")).alias("spans"), counts[4], every)
