"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, homoglyphs, digits and signs that
stand for letters within a word) and scanned once by an Aho-Corasick automaton.
Entries are whole words or word beginnings; at each word the longest entry
counts, unless an exception phrase covers it. The sum of weights is divided by
a power of the length in words and passed through a logistic curve.

Entries, weights, exception phrases, the power and the curve are learnt from the
whole texts of labelled documents, of at most ``SAMPLE`` doc_ids, the smallest by
hash. Spark counts the documents of each entry and phrase; what reaches the
driver are the best entries and phrases, and two numbers a document.
Neither labels nor lang, source or doc_id enter a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Labelled doc_ids that the lexicon is learnt from, at most, and its entries (and exceptions), at most.
SAMPLE, ENTRIES = 12_000, 400
#: Rated entries among which those of the lexicon are chosen, at most.
RATED = 8 * ENTRIES
#: Letters of an entry that is a beginning; marked documents that hold an entry, at least; log odds, at least; unmarked documents that hold an exception, at least.
SHORTEST, LONGEST, LEAST, ODDS, LEAST_PHRASE = 4, 8, 4, 2.0, 8
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝкмтвнгαορτυνικ", "aeopcyxijsdhqwkmtbhraoptuvik"))
#: Digits and signs written for letters.
LEET = dict(zip("0134578@$!", "oieastbasi"))
_FOLD = str.maketrans(HOMOGLYPHS)
_LEET_WORD = re.compile(r"(?<![^\W_])(?=[^\W\d_]*[0134578@$!])(?=[0134578@$]*[^\W\d_])[^\W_@$!]*(?:[@$!]+[^\W_@$!]+)*[^\W_]", re.UNICODE)
_GAP = re.compile(r"[\W_]+", re.UNICODE)
_MARKED = re.compile("[^\x00-ɏ]")
_SIGNED = re.compile(r"[^\W\d_][0-9@$!]+[^\W\d_]|(?<!\w)[0134578@$]+[^\W\d_]{2}", re.UNICODE)


def fold(text: str) -> str:
    """Lower-case words between single spaces, one before and one after."""
    if _MARKED.search(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = text.lower()
    if _MARKED.search(text):
        text = text.translate(_FOLD)
    if _SIGNED.search(text):
        text = _LEET_WORD.sub(lambda m: "".join(LEET.get(c, c) for c in m[0]), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """weights: by entry; " word " is a whole word and " begin" a beginning. score: 1 / (1 + exp(-(bias + slope * log1p(sum / words ** power))))."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.25
    bias: float = -2.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None))
        out.make_automaton()
        return out

    def total(self, folded: str, automaton: ahocorasick.Automaton) -> float:
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        if not excused:
            return sum(w for _, w in best.values())
        # How far the phrases that start at a word or before it reach.
        excused.sort()
        total, reach, at = 0.0, -1, 0
        for start in sorted(best):
            while at < len(excused) and excused[at][0] <= start:
                reach = max(reach, excused[at][1])
                at += 1
            size, weight = best[start]
            total += weight if start + size - 1 > reach else 0.0
        return total

    def score(self, value: float, words: int) -> float:
        x = self.bias + self.slope * math.log1p(max(0.0, value) / max(1, words) ** self.power)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def entries_of(folded: str) -> set[str]:
    """Whole words and word beginnings of a folded text, as the lexicon writes them."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def phrases_of(folded: str, whole: frozenset[str]) -> set[str]:
    """Two neighbouring words, one of them in ``whole``."""
    words = folded.split()
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in whole or b in whole}


def _excuse(exceptions: tuple[str, ...]) -> Callable[[str], str]:
    if not exceptions:
        return lambda text: text
    pattern = re.compile(" (?:" + "|".join(map(re.escape, exceptions)) + ")(?= )")
    return lambda text: pattern.sub("", text)


def _counted(folded: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    """(x, hit, miss): marked and unmarked rows of ``folded(toxic, folded)`` that hold x; counted before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [sorted(of(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, type=pa.list_(pa.string()))], names=["toxic", "held"])

    rows = arrow_map(folded, run, "toxic int, held array<string>").select("toxic", F.explode("held").alias("x"))
    return rows.groupBy("x").agg(F.sum("toxic").alias("hit"), F.sum(1 - F.col("toxic")).alias("miss"))


def _rated(counts: DataFrame, p: int, n: int, odds: float) -> DataFrame:
    """(x, weight) of the entries that ``LEAST`` marked documents hold and that speak for the mark, with the score they are ranked by."""
    weight = F.log((F.col("hit") + 0.5) / (p + 1)) - F.log((F.col("miss") + 0.5) / (n + 1))
    rated = counts.where(F.col("hit") >= LEAST).withColumn("weight", weight).where(F.col("weight") >= odds)
    # A whole word says more than a beginning.
    return rated.withColumn("score", F.col("hit") * F.col("weight") * F.when(F.col("x").endswith(" "), 1.0).otherwise(0.85)).orderBy(F.desc("score"), F.length("x"), "x")


def choose(rated: list[tuple[str, float]]) -> dict[str, float]:
    """The first ``ENTRIES`` of ranked entries, without those that an entry chosen before begins."""
    chosen: dict[str, float] = {}
    for entry, weight in rated:
        if len(chosen) == ENTRIES:
            break
        if not any(entry.startswith(k) for k in (entry[:m] for m in range(SHORTEST + 1, len(entry))) if k in chosen):
            chosen[entry] = weight
    return chosen


def fit_curve(chosen: dict[str, float], exceptions: tuple[str, ...], values: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> Lexicon:
    """The power of the length and the logistic curve that fit the documents' sums and lengths best."""
    best: tuple[float, Lexicon] | None = None
    for power in (0.0, 0.25, 0.5, 0.75):
        x = np.log1p(np.maximum(values, 0) / np.maximum(sizes, 1) ** power)
        bias, slope = _logistic(x, marks)
        z = bias + slope * x
        loss = float(np.logaddexp(0, np.where(marks, -z, z)).mean())
        if best is None or loss < best[0] - 1e-9:
            best = (loss, Lexicon(chosen, exceptions, power, bias, slope))
    return best[1]


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from ``rows(key, text, toxic)``; at most ``SAMPLE`` of them, the smallest by hash of key and text, fit the curve."""

    def folding(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t or "") for t in batch.column(2).to_pylist()], type=pa.string())], names=["order", "toxic", "folded"])

    slim = rows.select(F.xxhash64("key", "text").alias("order"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.col("text").cast("string"))
    held = materialize(arrow_map(slim, folding, "order long, toxic int, folded string"), "toxic-folded")
    p, n = held.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not p or not n:
        return Lexicon()
    folded = held.select("toxic", "folded")
    first = _rated(_counted(folded, entries_of), p, n, ODDS / 2).limit(4 * ENTRIES).collect()
    # Phrases of a possible entry and its neighbour that only unmarked texts hold are exceptions; they are left out of the final count.
    whole = frozenset(r["x"].strip() for r in first if r["x"].endswith(" "))
    met = _counted(folded, lambda t: phrases_of(t, whole)).where((F.col("hit") == 0) & (F.col("miss") >= LEAST_PHRASE))
    exceptions = tuple(r["x"] for r in met.orderBy(F.desc("miss"), "x").limit(ENTRIES).collect())
    excuse = _excuse(exceptions)
    chosen = choose([(r["x"], r["weight"]) for r in _rated(_counted(folded, lambda t: entries_of(excuse(t))), p, n, ODDS).limit(RATED).collect()])
    plain = Lexicon(chosen, exceptions)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(plain)
        texts = batch.column(2).to_pylist()
        sums = pa.array([plain.total(t, automaton) for t in texts], type=pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sums, pa.array([t.count(" ") - 1 for t in texts], type=pa.int64())], names=["order", "toxic", "value", "size"])

    seen = arrow_map(held, measured, "order long, toxic int, value double, size long").orderBy("order", "toxic", "value", "size").limit(SAMPLE).toArrow()
    return fit_curve(chosen, exceptions, seen["value"].to_numpy(), seen["size"].to_numpy(), seen["toxic"].to_numpy().astype(bool))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a small ridge."""
    w = np.zeros(2)
    rows = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (y - p) - 0.01 * w
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn_labels(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon for ``labels(doc_id, toxic)``, from rows that are not held out; rows with nulls are not used."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "_id")
    slim = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return learn(slim.join(F.broadcast(marks), F.col("key") == F.col("_id")).select("key", "text", "toxic"))


def held_out():
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, weight (the sum of matched weights).

    Null and empty texts get the score of a text without matches. A null doc_id
    is not held out. Repeated rows come out repeated; other columns are not
    read; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(lexicon)
        scores, hits = [], []
        for text in batch.column(2).to_pylist():
            folded = fold(text or "")
            total = lexicon.total(folded, automaton)
            scores.append(lexicon.score(total, folded.count(" ") - 1))
            hits.append(total)
        predicted = [int(s >= 0.5) for s in scores]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, type=pa.float64()), pa.array(predicted, type=pa.int32()), pa.array(hits, type=pa.float64())], names=["doc_id", "held_out", "score", "predicted", "weight"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, held_out boolean, score double, predicted int, weight double")


_BUILT: list[tuple[Lexicon, ahocorasick.Automaton]] = []


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    if not _BUILT or _BUILT[0][0] is not lexicon:
        _BUILT[:] = [(lexicon, lexicon.automaton())]
    return _BUILT[0][1]
