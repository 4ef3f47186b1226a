"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are counted by cell of source, language and topic; the table of cells is
raked to the target shares of each margin in turn until all of them agree, and
documents are drawn with the probability raked tokens over own tokens of their
cell. No document is repeated, so no cell can give more than it has: weights are
raked below that bound, and what a short cell cannot give its margins get from
their other cells. A value of a margin whose target is beyond all its tokens is
to give them all, and the other values share the rest in proportion; ``report``
says what each value was asked, was to give after that, and gives. A document is
drawn by the hash of its id and text, so a rerun draws the same ones.

All documents enter the counts, pre-aggregated before their shuffle. Raking
works on cells, never on documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARGINS = ("source", "lang", "topic")
#: Words by topic, in lower case.
TOPICS = {
    "legal": ("license", "licence", "copyright", "rights", "terms", "warranty", "lizenz", "licencia", "derechos", "droits"),
    "web": ("click", "cookie", "cookies", "login", "menu", "subscribe", "newsletter", "share", "website", "download"),
    "trade": ("price", "buy", "order", "shop", "sale", "shipping", "preis", "kaufen", "precio", "prix"),
    "technical": ("data", "server", "code", "token", "version", "error", "file", "software", "system", "api"),
    "society": ("government", "people", "school", "health", "history", "science", "gobierno", "gouvernement", "regierung", "schule"),
}
OTHER_TOPIC = "other"
#: Cells up to which they are raked in one task and their probabilities are broadcast; beyond, both are shuffled.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """A topic from the whole text, where no topic column is given: that of most of the words in TOPICS, the first in a tie; "other" without any.

    One pass finds all of them. Any other column of topics can take its place.
    """
    words = sorted((w for x in TOPICS.values() for w in x), key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])"), F.lit(0))

    def score(hits: Column, place: int, topic: str) -> Column:
        return F.struct(F.size(F.filter(hits, lambda x: x.isin(*TOPICS[topic]))).alias("n"), F.lit(-place).alias("k"), F.lit(topic).alias("t"))

    best = F.transform(F.array(found), lambda hits: F.greatest(*(score(hits, k, t) for k, t in enumerate(TOPICS))))[0]
    return F.when(best["n"] > 0, best["t"]).otherwise(OTHER_TOPIC)


def _count(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def token_count(text: Column) -> Column:
    """Words of the whole text, counted by single spaces and line ends; an empty text has none."""
    return F.when(text == "", 0).otherwise(_count(text, " ") + _count(text, "\n") + 1).cast("long")


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, tokens, docs) of all documents; nulls are a value of their own, texts of nulls have no tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(*_margins(text, topic), token_count(text).alias("tokens"))
    return marked.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _margins(text: Column, topic: Column | None) -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), (topic if topic is not None else topic_of(text)).alias("topic")]


def _targets(cells: DataFrame, margin: str, given: dict | None, flatten: float, keep: float | None) -> DataFrame:
    """(margin, _asked, _t) by value: the given shares, or natural ones to the power ``flatten``, scaled to sum to 1.

    _t is the share within what a value has when ``keep`` of all tokens are
    drawn; the others share what it can't give.
    """
    values = cells.groupBy(margin).agg(F.sum("tokens").alias("_n"))
    total, powers = values.agg(F.sum("_n"), F.sum(F.pow("_n", F.lit(flatten)))).first()
    if given is not None:
        pairs = F.create_map(*(F.lit(x) for kv in given.items() for x in kv))
        values = values.withColumn("_asked", F.coalesce(pairs[F.col(margin)], F.lit(0.0)))
    else:
        values = values.withColumn("_asked", F.pow("_n", F.lit(flatten)) / (powers or 1.0))
    if keep is None:
        return values.select(margin, "_asked", F.col("_asked").alias("_t"))
    values = materialize(values.withColumn("_most", F.col("_n") / ((total or 1.0) * keep)), "mix-goals")
    scale = 1.0
    for _ in range(100):  # each round at least one more value gives all it has, or the scale stands
        full = scale * F.col("_asked") >= F.col("_most")
        spent, rest = values.agg(F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_asked")))).first()
        if not rest or (new := (1 - spent) / rest) <= scale * (1 + 1e-9):
            break
        scale = new
    return values.select(margin, "_asked", F.least(F.col("_most"), scale * F.col("_asked")).alias("_t"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, flatten: float = 0.8, tolerance: float = 1e-3, rounds: int = 5, limit: int = 16, keep: float | None = None) -> DataFrame:
    """``cells`` with weight: shares that meet the targets of each margin.

    ``targets`` gives shares by value of a margin, for values the cells have; a
    margin without targets gets natural shares to the power ``flatten``, scaled
    to sum to 1. With ``keep``, no weight is above what the cell has when that
    share of all tokens is drawn. Where the cells there are cannot meet all
    margins at once (``off_target`` says by how much), the weights after
    ``limit`` times ``rounds`` rounds are returned.
    """
    given = targets or {}
    now = materialize(cells.where("tokens > 0"), "mix-cells")
    total = now.agg(F.sum("tokens")).first()[0] or 1.0
    small = now.count() <= BROADCAST_CELLS
    wide = now
    for m in MARGINS:
        goal = materialize(_targets(now, m, given.get(m), flatten, keep).withColumnsRenamed({"_asked": f"_a_{m}", "_t": f"_t_{m}"}), "mix-goals")
        wide = wide.join(F.broadcast(goal) if small else goal, m)
    bound = F.col("tokens") / (total * keep) if keep else F.lit(float("inf"))
    now = wide.select(*cells.columns, *(f"_{x}_{m}" for m in MARGINS for x in "at"), (F.col("tokens") / total).alias("weight"), bound.alias("_most"))
    for _ in range(limit):
        now = now.coalesce(1) if small else now  # all windows then share one task, without a shuffle
        for _ in range(rounds):
            for m in MARGINS:
                share = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("weight", F.when(share > 0, F.least("_most", F.col("weight") * F.col(f"_t_{m}") / share)).otherwise(0.0))
        now = materialize(now, "mix-cells")
        if off_target(now) <= tolerance:
            break
    return now


def report(raked: DataFrame) -> DataFrame:
    """(margin, value, asked, target, share): what each value of a margin was asked, what it was to give, and its part of the raked weights."""
    parts = [raked.groupBy(F.col(m).cast("string").alias("value")).agg(F.first(f"_a_{m}").alias("asked"), F.first(f"_t_{m}").alias("target"), F.sum("weight").alias("share")).select(F.lit(m).alias("margin"), "value", "asked", "target", "share") for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def off_target(raked: DataFrame) -> float:
    """The largest distance of a margin's share from its target."""
    return report(raked).agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0] or 0.0


def probabilities(raked: DataFrame) -> DataFrame:
    """(source, lang, topic, p): the chance of a document of each cell of cells raked with ``keep``."""
    return raked.select(*MARGINS, F.least(F.lit(1.0), F.col("weight") / F.col("_most")).alias("p"))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, flatten: float = 0.8, keep: float = 0.75, topic: Column | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, source)`` that are drawn, columns unchanged, with ``_p`` and ``_topic`` added (or replaced).

    ``keep`` is the share of all tokens to expect. Null sources and languages are
    a value of their own ("" after casting). Documents without tokens weigh
    nothing and are always kept. Rows that repeat doc_id and text are drawn
    together. An empty table gives an empty result.
    """
    raked = rake(materialize(cells_of(docs, topic), "mix-counts"), targets, flatten, keep=keep)
    p = materialize(probabilities(raked).select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.col("p").alias("_p")), "mix-p")
    small = p.count() <= BROADCAST_CELLS
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source, lang, kind = _margins(text, topic)
    same = (source == p["_source"]) & (lang == p["_lang"]) & (kind == p["_topic"])
    joined = docs.join(F.broadcast(p) if small else p, same, "left")
    chance = F.coalesce(p["_p"], F.lit(1.0))
    draw = F.pmod(F.xxhash64(F.lit(seed), docs["doc_id"], F.xxhash64(text)), F.lit(1 << 52)) / float(1 << 52)
    return joined.where(draw < chance).select(*(docs[c] for c in docs.columns if c not in ("_p", "_topic")), chance.alias("_p"), p["_topic"])
