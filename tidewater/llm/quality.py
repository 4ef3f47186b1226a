"""Quality rules by line sequence labelling.

Every line of a text that holds a word is labelled content or boilerplate by
Viterbi decoding of a linear-chain conditional random field with two labels.
The share of words in content lines decides whether the text is kept, beside
two plain rules on its length and its repeated word windows.

The field's weights are fitted here, by gradient ascent on the likelihood of
weakly labelled lines: the lines of documents marked good are content, those of
documents marked bad are boilerplate at first and are decoded anew between two
rounds, since bad documents also hold content lines. At most ``SAMPLE`` labelled
documents are used, the smallest by hash of doc_id, whatever their length: long
ones are cut into blocks of lines.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_bytes

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 1_500
#: Lines of a block: a longer document enters the fit as several sequences, which only cuts the bond between two lines.
BLOCK_LINES = 40
#: Blocks that the weights are fitted on, at most, the smallest by hash.
BLOCKS = 6_000
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
FEATURES = ("bias", "symbols", "bangs", "upper", "repeats", "adjacent", "duplicate", "bars", "digits", "short", "ended")


@dataclass(frozen=True)
class Field:
    """emission: score of content over boilerplate by feature; transition[a][b]: of label b after a (1 is content)."""

    emission: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]


#: Used where there are no labelled documents of both kinds.
PRIOR = Field((3.0, -6.0, -6.0, -4.0, -4.0, -6.0, -2.0, -4.0, -1.0, -0.5, 0.5), ((0.5, -0.5), (-0.5, 0.5)))


def lines_of(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and words of each line with a word, and how many such lines equal an earlier one."""
    rows, sizes, seen, again = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        duplicate = line in seen
        again += duplicate
        seen.add(line)
        letters = len(line) - len(line.translate(None, LETTERS))
        upper = len(line) - len(line.translate(None, UPPER))
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        adjacent = sum(map(bytes.__eq__, words, words[1:])) / n
        repeats = 1 - len(set(words)) / n if n > 7 else 0.0
        rows.append([1.0, min(1.0, symbols / n), min(1.0, line.count(b"!") / n), upper / letters if letters > 7 else 0.0, repeats, adjacent, float(duplicate), min(1.0, line.count(b"|") / n), (len(line) - len(line.translate(None, DIGITS))) / len(line), float(n < 4), float(line.rstrip()[-1:] in b".!?:")])
        sizes.append(n)
    return rows, sizes, again


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that are found twice or more."""
    if len(words) < width + 1:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, end = 0, 0
    for at, w in enumerate(windows):
        if found[w] > 1:
            total += at + width - max(at, end)
            end = at + width
    return total


def viterbi(scores: list[float], field: Field) -> list[int]:
    """Best labels for the lines' emission scores; ties go to content."""
    (t00, t01), (t10, t11) = field.transition
    back: list[tuple[int, int]] = []
    bad, good = 0.0, scores[0] if scores else 0.0
    for s in scores[1:]:
        from_bad, from_good = bad + t00, good + t10
        b0 = int(from_good >= from_bad)
        to_bad, to_good = bad + t01, good + t11
        b1 = int(to_good >= to_bad)
        bad, good = max(from_bad, from_good), max(to_bad, to_good) + s
        back.append((b0, b1))
    label = int(good >= bad)
    out = [label] * bool(scores)
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def fit(sequences: list[list[list[float]]], good: list[bool], rounds: int = 2, steps: int = 80) -> Field:
    """Weights of the field from lines' features by document and the documents' marks."""
    use = [(x[at : at + BLOCK_LINES], g) for x, g in zip(sequences, good) for at in range(0, len(x), BLOCK_LINES)]
    if len({g for _, g in use}) < 2:
        return PRIOR
    n, longest, width = len(use), max(len(x) for x, _ in use), len(FEATURES)
    features, mask, truth = np.zeros((n, longest, width)), np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for k, (x, g) in enumerate(use):
        features[k, : len(x)], mask[k, : len(x)], truth[k, : len(x)] = x, True, int(g)
    # Both kinds of documents weigh the same.
    share = np.mean([g for _, g in use])
    weight = np.where([g for _, g in use], 0.5 / share, 0.5 / (1 - share))[:, None]
    field = PRIOR
    for _ in range(rounds):
        e, t = np.array(field.emission), np.array(field.transition)
        speed_e, speed_t = np.zeros_like(e), np.zeros_like(t)
        for _ in range(steps):
            grad_e, grad_t = _gradient(features, mask, truth, weight, e, t)
            speed_e = 0.9 * speed_e + grad_e / n - 1e-3 * e
            speed_t = 0.9 * speed_t + grad_t / n - 1e-3 * t
            e, t = e + 0.1 * speed_e, t + 0.1 * speed_t
        field = Field(tuple(e.tolist()), tuple(map(tuple, t.tolist())))
        for k, (x, g) in enumerate(use):
            if not g:
                truth[k, : len(x)] = viterbi((np.array(x) @ e).tolist(), field)
    return field


def _gradient(features, mask, truth, weight, e, t):
    """Of the weighted log-likelihood: observed less expected counts, by forward-backward sums."""
    n, longest, _ = features.shape
    score = np.zeros((n, longest, 2))
    score[:, :, 1] = features @ e
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[:, 0] = score[:, 0]
    for k in range(1, longest):
        step = np.logaddexp(forward[:, k - 1, 0, None] + t[0], forward[:, k - 1, 1, None] + t[1]) + score[:, k]
        forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
    for k in range(longest - 2, -1, -1):
        ahead = score[:, k + 1] + backward[:, k + 1]
        step = np.logaddexp(ahead[:, 0, None] + t[:, 0], ahead[:, 1, None] + t[:, 1])
        backward[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    grad_e = ((truth - one) * mask * weight)[:, :, None] * features
    both = mask[:, 1:]
    grad_t = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected = np.exp(forward[:, :-1, a] + t[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None])
            observed = (truth[:, :-1] == a) & (truth[:, 1:] == b)
            grad_t[a, b] = ((observed - expected) * both * weight).sum()
    return grad_e.sum(axis=(0, 1)), grad_t


def fit_labels(docs: DataFrame, labels: DataFrame) -> Field:
    """The field for ``labels(doc_id, quality)``; rows with nulls are not used."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "_id")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = arrow_map(slim.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text"), _features, "doc_id long, quality int, lines array<array<array<double>>>")
    # A text or the rows of a doc_id may go on without end: BLOCKS of them at most leave the executors.
    blocks = lines.select("doc_id", "quality", F.posexplode("lines").alias("n", "lines"))
    blocks = blocks.orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n", F.xxhash64("lines")).limit(BLOCKS)
    rows = sorted((r["doc_id"], r["n"], r["quality"], r["lines"]) for r in blocks.collect())
    return fit([r[3] for r in rows], [r[2] > 0 for r in rows])


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lines' features by document, in blocks."""
    found = (lines_of(t)[0] for t in text_bytes(batch.column(2)))
    rows = [[x[at : at + BLOCK_LINES] for at in range(0, len(x), BLOCK_LINES)] for x in found]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, type=pa.list_(pa.list_(pa.list_(pa.float64()))))], names=["doc_id", "quality", "lines"])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def judge(text: bytes, field: Field, min_share: float, min_words: int = 50) -> tuple:
    """The values of COLUMNS for one text."""
    words = text.split()
    rows, sizes, again = lines_of(text)
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, CONTINUED)))
    repeat = repeated_words(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    failed = len(words) < min_words or 100 * repeat > 50 * len(words)
    marks = viterbi((np.array(rows) @ np.array(field.emission)).tolist(), field) if rows else []
    content = sum(n for n, m in zip(sizes, marks) if m)
    share = content / len(words) if words else 0.0
    return len(words), chars, symbols, again, repeat, failed, not failed and share >= min_share, share, len(rows), sum(marks)


#: Bytes that continue a code point in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


def label(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id and COLUMNS.

    A null text is judged as an empty one and fails. Repeated rows come out
    repeated; other columns are not read; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in COLUMNS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*(judge(t, field, min_share) for t in text_bytes(batch.column(1)))))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=k) for x, k in zip(columns, kinds))], names=["doc_id", *names])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, {COLUMNS}")


def keep(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; one narrow pass, no join.

    A null text is judged as an empty one and goes, a null doc_id changes nothing.
    Repeated rows stay or go together; an empty table gives an empty result.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(t, field, min_share)[6] for t in text_bytes(batch.column(at))], type=pa.bool_()))

    return arrow_map(docs, run, schema)
