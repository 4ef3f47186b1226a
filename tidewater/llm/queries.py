"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding, linededup, mixing, packing, pii, quality, sharding, simhash, toxicity
from .common import table

#: Shards before and after growth.
OLD_SHARDS, SHARDS = 20, 24
#: Content share from which a text is kept, words of the shortest repeated run, tokens of a sequence, power of natural shares.
MIN_SHARE, RUN_WORDS, SEQUENCE, FLATTEN = 0.5, 25, 2048, 0.8


def op1_reshard_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), OLD_SHARDS, SHARDS)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.label(docs, quality.fit_labels(docs, table(spark, sf_dir, "labels")), MIN_SHARE)


def op3_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op4_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn_labels(docs, table(spark, sf_dir, "labels")))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"), RUN_WORDS)


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary_path(), SEQUENCE)


def op9_mix_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), flatten=FLATTEN)


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_reshard_flow, op2_quality_crf, op3_embedding_cells, op4_toxic_lexicon, op5_line_winnowing, op6_chat_snapshots, op7_simhash_bytes, op8_best_fit, op9_mix_ipf, op10_pii_bootstrap)
    }


#: Every pair of vectors, and reachability by recursion: exact, for small tables.
EMBEDDINGS = """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, m.vec_id = c.root AS kept
FROM embeddings m JOIN c ON c.id = m.vec_id LEFT JOIN n ON n.a = m.vec_id"""

#: Prefixes compared by the digest of the joined turns; a row for each 1,024 turns.
CHATS = """WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t),
p AS (SELECT conv_id, n, md5(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY n)) AS h FROM k),
w AS (SELECT conv_id, max(n) AS n FROM k GROUP BY conv_id),
r AS (SELECT conv_id, (n - 1) // 1024 AS part, min(n) AS first_turn, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY n) AS rendered FROM k GROUP BY conv_id, (n - 1) // 1024),
f AS (SELECT w.conv_id, w.n, p.h FROM w JOIN p ON p.conv_id = w.conv_id AND p.n = w.n),
s AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_same FROM f GROUP BY n, h),
x AS (SELECT DISTINCT p.n, p.h FROM p JOIN w ON w.conv_id = p.conv_id WHERE p.n < w.n)
SELECT s.conv_id, r.part, s.n AS n_turns, s.n_same, r.first_turn, r.rendered
FROM s JOIN r ON r.conv_id = s.conv_id WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.n = s.n AND x.h = s.h)"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are held against brute force in the tests."""
    return {"op3_embedding_cells": EMBEDDINGS, "op6_chat_snapshots": CHATS}
