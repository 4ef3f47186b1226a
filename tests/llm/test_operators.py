"""Operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import chat, embedding, linededup, mixing, packing, pii, quality, queries, sharding, simhash, toxicity
from tidewater.llm.common import components, gapless_rank

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    rows = [(start + n, t, "en", f"src{n % 3}", None if t is None else len(t)) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    long = " ".join(f"v{k % 997}" for k in range(60_000))
    return [None, "", " \t\n", "one", "Two words", "a b c", "A B C", long, "\n".join(words(rng, 12) for _ in range(30)), "naïve Ünïcode текст 漢字 🙂", "x" * 50_000, "1" * 30_000, "a b c", None]


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_and_ranks(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(500, rng.randrange(500, 700)) for _ in range(150)] + [(rng.randrange(1000), rng.randrange(1000)) for _ in range(200)]
    expected = union(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert all(got.get(n, n) == r for n, r in expected.items())
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
    rows = spark.createDataFrame([(k % 3, k, k // 2) for k in range(500)], "g int, id long, tie long")
    ranked = gapless_rank(rows, ["g"], F.col("id"), "r", 7, [F.col("tie"), F.col("id")]).collect()
    by = defaultdict(list)
    for r in ranked:
        by[r["g"]].append(r["r"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(ranked) == 500


# --- 1


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        capacity = sharding.even_capacities(sum(supply), m)
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == capacity
        moved = sum(v for (i, j), v in flow.items() if i != j)
        assert moved == sum(supply[k] - min(supply[k], capacity[k] if k < m else 0) for k in range(n))
    # With prices: brute force over all ways to split.
    flow = sharding.min_cost_flow([3, 2], [2, 3], [[5, 1], [1, 4]])
    assert sum(v * [[5, 1], [1, 4]][i][j] for (i, j), v in flow.items()) == 5
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_closed_form_moves_as_few_as_the_flow():
    rng = random.Random(25)
    for _ in range(40):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        capacity = sharding.even_capacities(sum(supply), m) if rng.random() < 0.5 else [rng.randrange(0, 60) for _ in range(m)]
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                sharding.fewest_moves(supply, capacity)
            continue
        moves, flow = sharding.fewest_moves(supply, capacity), sharding.min_cost_flow(supply, capacity)
        assert [sum(v for (i, _), v in moves.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in moves.items() if j == k) <= capacity[k] for k in range(m)) and len(moves) <= n + m
        assert sum(v for (i, j), v in moves.items() if i != j) == sum(v for (i, j), v in flow.items() if i != j)
    supply = [rng.randrange(10**12) for _ in range(100_000)]
    assert len(sharding.fewest_moves(supply, sharding.even_capacities(sum(supply), 120_000))) < 220_000


def test_shards(spark):
    texts = [x for x in odd_texts() if not x or len(x) < 9000] + [words(random.Random(k), 5 + k % 90) for k in range(3000)]
    docs = docs_of(spark, texts).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    got = sharding.shard_table(docs.unionByName(docs.where("doc_id = 5")), 20, 24).collect()
    assert len(got) == len(texts) + 1
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert max(loads.values()) - min(loads.values()) < 1_500
    huge = docs_of(spark, odd_texts())
    assert {r["doc_id"] for r in sharding.shard_table(huge, 20, 24).collect()} == set(range(len(odd_texts())))
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard_table(empty, 20, 24).count() == 0


def test_rewrite_leaves_other_shards(spark, tmp_path):
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "1.5D AS size", "cast(CASE WHEN id < 200 THEN 0 WHEN id < 300 THEN 1 ELSE 2 END AS int) AS shard")
    rows.write.partitionBy("shard").parquet(old)
    manifest = {r["shard"]: r for r in sharding.rewrite(spark, old, new, "octet_length(text)", "doc_id", 4, [1000, 1000, 1000, 1000]).collect()}
    assert [manifest[s]["rewritten"] for s in range(4)] == [True, False, False, True]
    parts = [spark.read.parquet(manifest[s]["path"]) for s in range(4)]
    assert [p.count() for p in parts] == [100] * 4
    assert {r["doc_id"] for p in parts for r in p.collect()} == set(range(400)) and parts[3].first()["size"] == 1.5


def test_shards_without_bytes_stay(spark, tmp_path):
    rows = [(k, k % 4, None if k % 4 in (1, 3) else 10) for k in range(80)]
    frame = spark.createDataFrame(rows, "id long, shard int, size long")
    for shards, capacities in ((4, None), (4, [200, 0, 200, 0]), (3, [200, 0, 200])):
        moved = sharding.reshard(frame.drop("size").join(frame.select("id", F.col("size").alias("s")), "id"), F.col("shard"), F.col("s"), F.col("id"), shards, capacities).collect()
        assert sorted(r["id"] for r in moved) == list(range(80)) and all(0 <= r["new_shard"] < shards for r in moved)
        old, new = str(tmp_path / f"old{shards}{bool(capacities)}"), str(tmp_path / f"new{shards}{bool(capacities)}")
        frame.write.partitionBy("shard").parquet(old)
        manifest = sharding.rewrite(spark, old, new, "size", "id", shards, capacities).collect()
        assert sorted(r["id"] for m in manifest for r in spark.read.parquet(m["path"]).collect()) == list(range(80))


# --- 2


def plain_rules(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    places = defaultdict(list)
    for k, x in enumerate(windows):
        places[x].append(k)
    covered = {k + d for at in places.values() if len(at) > 1 for k in at for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_quality(spark):
    rng = random.Random(3)
    good = ["\n".join(words(rng, 30).capitalize() + "." for _ in range(4)) for _ in range(40)]
    bad = ["\n".join(" ".join(w + "***" for w in words(rng, 20).split()) for _ in range(5)) for _ in range(40)]
    texts = odd_texts() + ["x y x y x y x y\nx y\nx y"] + good + bad
    docs = docs_of(spark, texts).withColumn("kept", F.lit("clash"))
    first = len(texts) - 80
    labels = spark.createDataFrame([(first + k, int(k < 40), 0) for k in range(0, 80, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.fit_labels(docs, labels)
    got = {r["doc_id"]: r for r in quality.label(docs, field).collect()}
    for n, t in enumerate(texts):
        r = got[n]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t), n
        assert not (r["kept"] and r["base_failed"])
    assert all(got[first + k]["kept"] == (k < 40) for k in range(80))
    kept = quality.keep(docs, field)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {n for n, r in got.items() if r["kept"]}
    assert quality.label(docs.limit(0), quality.fit_labels(docs.limit(0), labels.limit(0))).count() == 0


def test_viterbi_is_the_best_labelling():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(1, 9)
        s = [rng.uniform(-2, 2) for _ in range(n)]
        field = quality.Field((), ((rng.uniform(-1, 1), rng.uniform(-1, 1)), (rng.uniform(-1, 1), rng.uniform(-1, 1))))

        def value(labels):
            return sum(x for x, m in zip(s, labels) if m) + sum(field.transition[a][b] for a, b in zip(labels, labels[1:]))

        best = max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert value(quality.viterbi(s, field)) == pytest.approx(best)
    assert quality.viterbi([], quality.PRIOR) == []


# --- 3


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 24))
    near = base[:300] + rng.normal(size=(300, 24)) * 0.09 * np.linalg.norm(base[:300], axis=1)[:, None]
    hub = base[0] + rng.normal(size=(250, 24)) * 0.03
    rows = [x.tolist() for x in np.concatenate([base, near, hub, base[:5], base[7:8] * 3])]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [None] + [1.0] * 23]
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(frame.withColumn("cell", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    fine = len(rows) - 7
    x = np.array(rows[:fine], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    expected = union(zip(i.tolist(), j.tolist()), range(len(rows)))
    links = np.bincount(np.concatenate([i, j]), minlength=len(rows))
    mine = np.array([got[k]["n_links"] for k in range(len(rows))])
    assert (mine <= links).all() and mine.sum() >= 0.999 * links.sum()
    assert np.mean([got[k]["component_id"] == expected[k] for k in range(len(rows))]) > 0.998
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(fine, len(rows)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


# --- 4


def test_toxicity(spark):
    rng = random.Random(7)
    clean = [words(rng, 40) for _ in range(200)]
    foul = [words(rng, 20) + rng.choice([" scoundrel ", " Blockhead! "]) + words(rng, 20) for _ in range(200)]
    clean += [words(rng, 10) + " not blockhead " + words(rng, 10) for _ in range(20)]
    texts = clean + foul
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(n, 1, int(220 <= n)) for n in range(len(texts))], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_labels(docs, labels)
    got = toxicity.score(docs, lexicon).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {n for n in range(len(texts)) if zlib.crc32(str(n).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(r["doc_id"] >= 220) for r in held]) > 0.95
    disguised = docs_of(spark, [words(rng, 9) + " sc0undr3l " + words(rng, 9), words(rng, 9) + " ѕсоundrеl " + words(rng, 9), words(rng, 9) + " not blockhead " + words(rng, 9), *odd_texts()])
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(disguised.withColumn("score", F.lit("clash")), lexicon).collect()}
    assert found[0] == found[1] == 1 and not any(found[n] for n in range(2, len(found))) and len(found) == 3 + len(odd_texts())
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0).selectExpr("doc_id AS key", "text", "0 AS toxic"))).count() == 0


def test_embedding_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng = np.random.default_rng(3)
    base = np.array([r["embedding"] for r in rows])
    gap = rng.normal(size=base.shape)
    gap -= (gap * base).sum(axis=1, keepdims=True) * base  # all at cosine 0.91
    near = base + gap / np.linalg.norm(gap, axis=1, keepdims=True) * np.tan(np.arccos(0.91))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embedding.near_duplicates(frame).collect()}
    assert np.mean([got[k + len(base)] == got[k] for k in range(len(base))]) > 0.97


@pytest.mark.parametrize("rank", [2, 16])
def test_embeddings_of_low_rank_lose_no_pair(spark, monkeypatch, rank):
    """Vectors of a few dimensions out of 64, in many cells of several blocks, each with a partner at cosine 0.91."""
    monkeypatch.setattr(embedding, "CELL_BLOCK", 100)
    rng = np.random.default_rng(rank)
    plane = np.linalg.qr(rng.normal(size=(64, rank)))[0]
    base = rng.normal(size=(1500, rank))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    gap = rng.normal(size=base.shape)
    gap -= (gap * base).sum(axis=1, keepdims=True) * base
    near = base + gap / np.linalg.norm(gap, axis=1, keepdims=True) * np.tan(np.arccos(0.91))
    x = np.concatenate([base, near]) @ plane.T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(frame).collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    expected = union(zip(i.tolist(), j.tolist()), range(len(x)))
    assert [got[k]["n_links"] for k in range(len(x))] == np.bincount(np.concatenate([i, j]), minlength=len(x)).tolist()
    assert all(got[k]["component_id"] == expected[k] for k in range(len(x)))


def test_what_is_shipped_for_ten_million_vectors():
    """Neither closure holds a matrix of cells by cells."""
    from pyspark import cloudpickle

    class Shipped:  # stands for a broadcast variable, of which a closure holds the number only
        value = None

    cells = -(-10_000_000 // embedding.CELL_BLOCK)
    blocks = np.ones(cells, dtype=np.int64)
    assert len(cloudpickle.dumps(embedding._deal(Shipped(), 0.45, blocks, "<f4"))) < 1 << 20 and cells * 1024 * 8 < 64 << 20


def test_visits_cross_every_bisector_in_reach():
    rng = np.random.default_rng(5)
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(200, 8)), rng.normal(size=(12, 8))))
    home = (x @ c.T).argmax(axis=1)
    got = embedding.visits(x, home, c, 0.3)
    for n in range(200):
        for k in range(12):
            normal = c[home[n]] - c[k]
            behind = (x[n] @ normal) / np.linalg.norm(normal) if k != home[n] else 0.0
            assert got[n, k] == (behind <= 0.3)


def test_fold():
    assert toxicity.fold("Héllo, W0RLD!") == " héllo world "
    assert toxicity.fold("") == "  " and toxicity.fold("2024 12") == " 2024 12 "


def test_toxicity_held_out_on_the_table(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = queries.op4_toxic_lexicon(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hit = [r["predicted"] for r in got if r["toxic"]]
    assert np.mean(hit) > 0.85 and np.mean([r["predicted"] for r in got if not r["toxic"]]) < 0.02 and docs.count() == 10_000


# --- 5


def brute_lines(texts, min_words):
    """Deleted line numbers by document, from the definition."""
    lines = [[(p, x) for p, x in enumerate((t or "").split("\n")) if re.search("[^\x20\x09-\x0d]", x)] if t is not None else [] for t in texts]
    size = [[len(re.findall("[^\x20\x09-\x0d]+", x)) for _, x in doc] for doc in lines]
    first, later = {}, []
    for d, doc in enumerate(lines):
        for a in range(len(doc)):
            total, b = 0, a
            while b < len(doc) and total < min_words:
                total += size[d][b]
                b += 1
            if total < min_words:
                continue
            key = tuple(x for _, x in doc[a:b])
            if key in first:
                later.append((d, a, b - 1, *first[key]))
            else:
                first[key] = (d, a, b - 1)
    gone = [set() for _ in lines]
    for d, a, b, sd, sa, sb in later:
        left = right = 0
        reach = 0
        while a - left - 1 >= 0 and sa - left - 1 >= 0 and lines[d][a - left - 1][1] == lines[sd][sa - left - 1][1]:
            reach += size[d][a - left - 1]
            if reach > min_words - 1:
                break
            left += 1
        reach = 0
        while b + right + 1 < len(lines[d]) and sb + right + 1 < len(lines[sd]) and lines[d][b + right + 1][1] == lines[sd][sb + right + 1][1]:
            reach += size[d][b + right + 1]
            if reach > min_words - 1:
                break
            right += 1
        gone[d] |= {lines[d][k][0] for k in range(a - left, b + right + 1)}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[n]) if t is not None else None for n, t in enumerate(texts)]


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [words(rng, rng.randrange(1, 30)) for _ in range(40)]
    texts = ["\n".join(rng.choice([*pool, "", "All rights reserved.", words(rng, 8)]) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    passage = words(rng, 60)
    texts += [f"{words(rng, 30)}\n{passage}\n{words(rng, 30)}" for _ in range(30)] + texts[:6] + odd_texts()
    docs = docs_of(spark, texts).withColumn("_gone", F.lit(3)).withColumn("th", F.lit("x"))
    got = {r["doc_id"]: r for r in linededup.dedup(docs, 12).collect()}
    expected = brute_lines(texts, 12)
    assert [got[n]["text"] for n in range(len(texts))] == expected
    assert sum(passage in (r["text"] or "") for r in got.values()) == 1
    assert all((got[n]["n_deleted"] == 0) == (texts[n] == expected[n]) for n in range(len(texts)))
    assert linededup.dedup(docs, 12).columns == [*docs.columns, "n_deleted"]
    twice = docs.unionByName(docs.where("doc_id IN (1, 125)"))
    again = linededup.dedup(twice.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 12).collect()
    assert len(again) == len(texts) + 3 and all(r["text"] == expected[r["doc_id"]] for r in again if r["doc_id"] is not None)
    assert linededup.dedup(docs.limit(0), 12).count() == 0
    assert all(r["n_chars"] == (len(r["text"]) if r["n_deleted"] else docs_chars(texts[r["doc_id"]])) for r in got.values())


def docs_chars(text):
    return None if text is None else len(text)


def test_line_dedup_posts_minima_only(spark):
    """Posted fingerprints are window minima, the rightmost of equal ones, each place once; only those met twice go on."""
    rng = random.Random(19)
    texts = ["\n".join(words(rng, rng.randrange(1, 6), 5000) for _ in range(60)) for _ in range(30)]
    texts += ["\n".join([*(words(rng, 4, 5000) for _ in range(9)), *["same line here"] * 9, *texts[0].split("\n")[5:40]]) for _ in range(3)]
    lines = linededup.line_table(docs_of(spark, texts)).repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    hashes = defaultdict(dict)
    for r in lines.collect():
        hashes[r["doc_id"]][r["pos"]] = (r["h"], r["words"])
    places = set()
    for d, own in hashes.items():
        seq = [own[p] for p in sorted(own)]
        for a in range(len(seq)):
            total, b = 0, a
            while b < len(seq) and total < 25:
                total += seq[b][1]
                b += 1
            if total >= 25:
                places.add((d, max(range(a, b), key=lambda k: (-seq[k][0], k)), min(h for h, _ in seq[a:b])))
    windows = linededup._windows(lines, 25)
    posted = windows.where("posted").collect()
    assert sorted((r["doc_id"], r["anchor"]) for r in posted) == sorted((d, h) for d, _, h in places)
    assert len(posted) < 0.45 * sum(map(len, hashes.values())) and len(posted) < 0.5 * windows.count()
    times = defaultdict(int)
    for _, _, h in places:
        times[h] += 1
    assert {r["anchor"]: r["n"] for r in linededup.fingerprints(windows).collect()} == {h: n for h, n in times.items() if n > 1}


@pytest.mark.parametrize("heavy, bits", [(1, 1 << 15), (10**9, 1 << 20)])
def test_line_dedup_by_shuffle_and_by_broadcast(spark, monkeypatch, heavy, bits):
    """All keys light and a small, crowded bitmap; and all keys heavy."""
    from tidewater.llm import common

    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(common, "SCREEN_BITS", bits)
    rng = random.Random(20)
    pool = [words(rng, rng.randrange(1, 30)) for _ in range(40)]
    texts = ["\n".join(rng.choice([*pool, "", words(rng, 8)]) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs_of(spark, texts), 12).collect()}
    assert [got[n] for n in range(len(texts))] == brute_lines(texts, 12)


def test_screen_lets_all_members_through(spark):
    from tidewater.llm import common

    rows = spark.range(20_000).withColumn("x", F.when(F.col("id") % 100 != 7, F.col("id")))
    surely_none, rest = common.screen(rows, F.col("x"), spark.range(0, 20_000, 9), F.col("id"))
    through = {r["id"] for r in rest.collect()}
    assert {n for n in range(0, 20_000, 9) if n % 100 != 7} <= through and len(through) < 3000
    assert surely_none.count() == 20_000 - len(through)


def plan_of(df, phase):
    return getattr(df._jdf.queryExecution(), phase)().toString()


def test_line_dedup_sorts_and_shuffles_no_more_than_it_needs(spark):
    """Windows: two sorts, none of rows that hold lists. Texts are shuffled once, and their hash is taken once."""
    rng = random.Random(21)
    docs = docs_of(spark, ["\n".join(words(rng, rng.randrange(1, 9)) for _ in range(20)) for _ in range(20)] * 2)
    lines = linededup.line_table(docs).repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    windows = linededup._windows(lines, 25)
    assert len(re.findall(r"\bSort \[", plan_of(windows, "executedPlan"))) == 2
    out = linededup.dedup(docs)
    plan = plan_of(out, "optimizedPlan")
    assert "AS row#" in plan and not re.search(r"struct\([^)]*\btext, text#", plan)
    joins = [x for x in plan.split("\n") if re.search(r"(Join|Filter) .*(_line#|_map#)", x)]
    assert joins and not any("xxhash64(" in x for x in joins)
    assert out.where("n_deleted > 0").count() == 20


@pytest.mark.parametrize("min_words", [1, 2, 9, 40])
def test_line_windows_know_the_lines_beside_them(spark, min_words):
    rng = random.Random(22)
    texts = ["\n".join(words(rng, rng.choice([1, 1, 2, 5, 8, 30])) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    own = defaultdict(list)
    for r in linededup.line_table(docs_of(spark, texts)).orderBy("doc_id", "pos").collect():
        own[r["doc_id"]].append((r["h"], r["words"]))
    expected = set()
    for d, seq in own.items():
        at = [sum(w for _, w in seq[:n]) for n in range(len(seq) + 1)]
        for a in range(len(seq)):
            b = next((b for b in range(a + 1, len(seq) + 1) if at[b] - at[a] >= min_words), None)
            if b:
                before = tuple(seq[k][0] for k in range(a) if at[a] - at[k] < min_words)
                after = tuple(seq[k][0] for k in range(b, len(seq)) if at[k + 1] - at[b] < min_words)
                expected.add((d, a + 1, b, before, after))
    got = linededup._windows(linededup.line_table(docs_of(spark, texts)), min_words).collect()
    assert sorted((r["doc_id"], r["first"], r["last"], tuple(r["before"]), tuple(r["after"])) for r in got) == sorted(expected)


def test_line_dedup_counts_words(spark):
    """Blanks are no words, and words parted by tabs or several blanks are."""
    rng = random.Random(18)
    brace, table = " " * 28 + "}", "cell" + " " * 40 + "|"
    tabbed = words(rng, 60).replace(" ", "\t")
    spaced = words(rng, 24).replace(" ", " \t ") + "\r"
    short = words(rng, 23).replace(" ", "   ")
    texts = [f"{words(rng, 30)}\n{x}\n{words(rng, 30)}" for x in (brace, table, tabbed, short, spaced) for _ in range(3)]
    texts += [f"{words(rng, 30)}\n{spaced}\n{brace}\n{words(rng, 30)}" for _ in range(2)]
    lines = [x for t in texts for x in t.split("\n")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs_of(spark, texts)).collect()}
    left = [x for n in range(len(texts)) for x in got[n].split("\n")]
    for x, times in ((brace, 4), (table, 3), (tabbed, 1), (short, 3), (spaced, 4)):
        assert left.count(x) == times, x
    assert sum(map(len, map(str.split, left))) == sum(len(x.split()) for x in lines) - 2 * 60 - 25
    assert [got[n] for n in range(len(texts))] == brute_lines(texts, 25)


# --- 6


def test_chat_collapse(spark):
    rng = random.Random(9)
    chats = {}
    for k in range(60):
        turns = [(("user", "assistant")[n % 2], words(rng, 3, 5)) for n in range(rng.randrange(1, 7))]
        chats[k] = turns
    for k in range(60, 100):
        source = chats[rng.randrange(60)]
        chats[k] = source[: rng.randrange(1, len(source) + 1)]
    chats[100] = [("user", f"turn {n}") for n in range(2500)]
    chats[101] = chats[100][:1800]
    rows = [(k, n, r, t, "x") for k, turns in chats.items() for n, (r, t) in enumerate(turns)]
    rows += rows[:10] + [(None, 0, "user", "lost", "x"), (200, None, None, None, "x")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = chat.format_chats(frame).collect()
    chats[200] = [("", "")]
    keep = {k for k, t in chats.items() if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and j < k) for j, u in chats.items())}
    assert {r["conv_id"] for r in got} == keep
    parts = defaultdict(list)
    for r in got:
        parts[r["conv_id"]].append((r["part"], r["rendered"]))
        assert r["n_turns"] == len(chats[r["conv_id"]]) and r["n_same"] == sum(t == chats[r["conv_id"]] for t in chats.values())
    for k, found in parts.items():
        assert "".join(x for _, x in sorted(found)) == "".join(f"<|{r}|>\n{t}\n" for r, t in chats[k])
    assert len(parts[100]) == 3 and chat.format_chats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [2, 4096])
def test_chats_equal_sql_whatever_the_turn_numbers(spark, monkeypatch, tmp_path, heavy):
    """Turn numbers from 1,020, from epoch time, negative and null, masses of equal ones, and more than 1,024 turns."""
    import duckdb

    from tidewater.llm import common

    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(24)
    rows = []
    for k, (start, step) in enumerate([(1020, 1), (1_700_000_000_000, 977), (-3, 1), (1 << 40, 1 << 33), (5, 0), (0, 1)] * 4):
        for n in range(rng.randrange(1, 12)):
            rows.append((k, start + n * step, ("user", "assistant")[n % 2], f"t{n}" if k % 3 else f"{k} {n}"))
    rows += [(50, None, "user", f"{n % 7}"*(n % 90)) for n in range(300)] + [(51, 3, None, "x" * 70 + str(n)) for n in range(2200)] + [(52, n, "user", "x") for n in range(1024)] + [(53, n, "user", "x") for n in range(1025)] + [(54, 0, "user", None), (None, 1, "user", "t")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/c")
    got = chat.format_chats(frame)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    expected = con.execute(queries.CHATS)
    columns = [d[0] for d in expected.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())
    assert {(r["conv_id"], r["part"]) for r in got.collect()} >= {(51, 0), (51, 1), (51, 2), (53, 0), (53, 1)}


# --- 7


def slow_fingerprint(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(10)
    base = [words(rng, 120) for _ in range(150)]
    texts = base + base[:40] + [t.replace("w1", "q1", 1) for t in base[:80]] + [x for x in odd_texts() if not x or len(x) < 9000]
    hub = words(rng, 200).split()
    for _ in range(60):
        new = list(hub)
        new[rng.randrange(200)] = "other"
        texts.append(" ".join(new))
    docs = docs_of(spark, texts).withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert all(got[n]["fp"] % (1 << 64) == p for n, p in enumerate(prints))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = union(pairs, range(len(texts)))
    assert {n: got[n]["component_id"] for n in got} == expected and len(got) == len(texts)
    kept = simhash.near_dedup(docs)
    assert {r["doc_id"] for r in kept.collect()} == set(expected.values()) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_index_finds_all_pairs_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(300)} | {centre}
    for _ in range(400):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    from tidewater.llm import common

    monkeypatch.setattr(simhash, "block_pairs", lambda df, keys, spread: common.block_pairs(df, keys, spread, 50))
    edges = [(r["a"], r["b"]) for r in simhash.link(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    exact = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert set(union(edges, values).items()) == set(union(exact, values).items())
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 64 for a, b in edges)
    assert len(simhash.planes()) == 14


def test_simhash_long_lists_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    spread = {(centre & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(400)}  # one plane in common
    near = {v ^ sum(1 << b for b in rng.sample(range(64), 3)) for v in sorted(spread)[:150]}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in spread | near | {rng.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    exact = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    expected = union(exact, values)
    for longest in (10, 100, 10**6):
        monkeypatch.setattr(simhash, "SPLIT", longest)
        assert union([(r["a"], r["b"]) for r in simhash.link(table).collect()], values) == expected
    # The places and values of the four bytes outside a plane, by plain arithmetic.
    monkeypatch.setattr(simhash, "SPLIT", 1)
    plane = simhash.planes()[0]
    postings = spark.createDataFrame([(v, 0, 7) for v in values] + [(5, 1, 8)], "fp long, plane int, key long")
    got = {(r["fp"], r["plane"], r["fifth"]) for r in simhash._split(postings).collect()}
    assert got == {(v, 0, 256 * p + (v >> (8 * p) & 255)) for v in values for p in range(8) if p not in plane} | {(5, 1, -1)}


# --- 8


def best_fit_decreasing(lengths, capacity):
    """Number of sequences, piece by piece."""
    room = []  # sorted
    n = 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, x)
        if at < len(room):
            gap = room.pop(at)
        else:
            gap, n = capacity, n + 1
        if gap > x:
            bisect.insort(room, gap - x)
    return n


def placed_whole(rows, capacity):
    """Sequences whose pieces lie without gaps or overlaps, all rows placed."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["mixed", "short", "one length", "halves", "ones", "long"])
def test_sweeps_against_best_fit_decreasing(spark, kind):
    rng = random.Random(kind)
    pick = {
        "mixed": lambda: min(512, int(rng.expovariate(1 / 150)) + 1),
        "short": lambda: rng.randrange(1, 30),
        "one length": lambda: 100 if rng.random() < 0.7 else rng.randrange(1, 513),
        "halves": lambda: rng.randrange(200, 300),
        "ones": lambda: 1,
        "long": lambda: rng.randrange(257, 513),
    }[kind]
    lengths = [pick() for _ in range(2500)]
    frame = spark.createDataFrame([(n, 0, 0, x) for n, x in enumerate(lengths)], "doc_id long, piece int, ids_crc32 long, length long")
    got = packing.place(frame, 512).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2500)) and all(r["length"] == lengths[r["doc_id"]] for r in got)
    assert placed_whole(got, 512) <= 1.01 * best_fit_decreasing(lengths, 512) + 1


def test_supersteps_run_few_jobs(spark):
    """Each job of a shuffle or broadcast keeps threads, plans and buffers on the driver."""
    rng = random.Random(41)
    lengths = [min(512, int(rng.expovariate(1 / 150)) + 1) for _ in range(300)]
    frame = spark.createDataFrame([(n, 0, 0, x) for n, x in enumerate(lengths)], "doc_id long, piece int, ids_crc32 long, length long")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    got = packing.place(frame, 512).collect()
    assert placed_whole(got, 512) and len(got) == 300
    assert scheduler.numTotalJobs() - before <= 170


def test_a_sweep_matches_like_best_fit(spark):
    """Longest first, each to the smallest gap that holds it and is free."""
    rng = random.Random(23)
    gaps, items = [rng.randrange(1, 60) for _ in range(300)], [rng.randrange(1, 60) for _ in range(300)]
    free, expected = sorted(gaps), []
    for x in sorted(items, reverse=True):
        at = bisect.bisect_left(free, x)
        if at < len(free):
            expected.append((free.pop(at), x))
    frames = spark.createDataFrame(list(enumerate(gaps)), "seq long, gap long"), spark.createDataFrame([(x, n, 0) for n, x in enumerate(items)], "size long, a long, b long")
    got = packing._sweep(*frames).collect()
    assert sorted((r["gap"], r["size"]) for r in got if r["size"]) == sorted(expected) and sorted(r["seq"] for r in got) == list(range(300))
    assert len({r["a"] for r in got if r["size"]}) == len(expected) and all(gaps[r["seq"]] == r["gap"] for r in got)


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = odd_texts() + [words(random.Random(k), 20 + 13 * (k % 70)) for k in range(150)] + ["<|endoftext|> it's 12,345 don't", " x\u0085y  z"]
    path = packing.vocabulary_path()
    t = Tokenizer.from_file(path)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    docs = docs_of(spark, texts).withColumn("length", F.lit("clash"))
    got = packing.pack(docs, path, 256, with_ids=True).collect()
    rows = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        rows[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["ids"] == part.tolist()
    for n, x in enumerate(ids):
        parts = sorted(rows[n], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(x)
        assert all(r["length"] == 256 for r in parts[1:]) and len(parts) == -(-len(x) // 256)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    lengths = [r["length"] for r in got]
    assert len(sequences) <= 1.01 * best_fit_decreasing(lengths, 256) + 1
    assert packing.pack(docs.limit(0), path, 256).count() == 0


def test_encode_equals_tokenizers():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(12)
    signs = [chr(c) for c in (*range(0x180), 0x3B1, 0x4E2D, 0x1F600, 0x2003, 0x300)] + ["'s", "  ", "\n\n", "<|endoftext|>", "the", "12"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert packing.encode(texts, path) == [t.encode(x, add_special_tokens=False).ids for x in texts]


# --- 9


def test_mixing(spark):
    rng = random.Random(13)
    rows = [(n, words(rng, rng.randrange(5, 60)), rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "a", "b", "c"]), 0) for n in range(3000)]
    rows += [(9000, None, "en", None, 0), (9001, "", None, "a", 0), (9002, "x", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_c", F.lit("clash")).withColumn("topic", F.lit("own"))
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.29, "": 0.01}, "lang": {"en": 0.5, "fr": 0.49, "": 0.01}}
    cells = mixing.cells_of(docs)
    raked = mixing.rake(cells, targets, flatten=1.0).collect()
    table = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in raked}
    weight = {k: v / sum(table.values()) for k, v in table.items()}
    natural = defaultdict(float)
    for k, v in weight.items():
        natural[k[2]] += v
    goals = [targets["source"], targets["lang"], natural]
    for _ in range(400):
        for m, goal in enumerate(goals):
            total = defaultdict(float)
            for k, v in weight.items():
                total[k[m]] += v
            weight = {k: v * goal[k[m]] / total[k[m]] for k, v in weight.items()}
    for r in raked:
        assert r["weight"] == pytest.approx(weight[r["source"], r["lang"], r["topic"]], abs=2e-3)
    drawn = mixing.mix(docs, targets, keep=0.5)
    assert drawn.columns == [*docs.columns, "_p", "_topic"]
    got = drawn.collect()
    tokens = {r["doc_id"]: r["t"] for r in docs.select("doc_id", mixing.token_count(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    total = sum(tokens.values())
    assert sum(tokens[r["doc_id"]] for r in got) == pytest.approx(0.5 * total, rel=0.06)
    assert {9000, 9001} <= {r["doc_id"] for r in got} and len({r["doc_id"] for r in got}) == len(got)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in mixing.mix(docs.repartition(7), targets, keep=0.5).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [0, 50_000])
def test_drawn_shares_meet_the_targets(spark, monkeypatch, cells):
    """Cells that are too short for their weight are made up for by others of their margins."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    rng = random.Random(26)
    rows = [(n, words(rng, rng.randrange(20, 40)) + rng.choice([" license", " price", "", "", ""]), "fr" if rng.random() < (0.7 if n % 50 == 0 else 0.1) else "en", "rare" if n % 50 == 0 else rng.choice("ab"), 0) for n in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = {"source": {"a": 0.54, "b": 0.42, "rare": 0.04}}
    told = {(r["margin"], r["value"]): r for r in mixing.report(mixing.rake(mixing.cells_of(docs), asked, 0.5, keep=0.75)).collect()}
    assert all(abs(r["target"] - r["share"]) < 2e-3 for r in told.values())
    assert all(told["source", v]["asked"] == s for v, s in asked["source"].items())
    a, b, rare = (told["source", v]["target"] for v in ("a", "b", "rare"))
    assert a / b == pytest.approx(0.54 / 0.42) and a + b + rare == pytest.approx(1) and 0.025 < rare < 0.028
    drawn = mixing.mix(docs, asked, 0.5)
    share = {(m, r["value"]): r["t"] for m, c in (("source", "source"), ("lang", "lang"), ("topic", "_topic")) for r in drawn.groupBy(F.col(c).alias("value")).agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    total = sum(t for (m, _), t in share.items() if m == "source")
    assert share.keys() == told.keys() and len(told) == 8
    assert all(abs(share[k] / total - r["target"]) < 0.01 for k, r in told.items()), (share, told)
    assert abs(total / sum(len(r[1].split()) for r in rows) - 0.75) < 0.02


def test_topics(spark):
    texts = ["", None, "no such words", "License and terms, PRICE", "click the menu to buy", "licensed", "the license.error file", "x" * 9000]
    got = docs_of(spark, texts).select(mixing.topic_of(F.coalesce("text", F.lit(""))).alias("t")).collect()
    assert [r["t"] for r in got] == ["other", "other", "other", "legal", "web", "other", "technical", "other"]


# --- 10


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark):
    rng = random.Random(14)
    bits = ["a.b@c.de", "x@y", "@", "z@q.w_r@t.u", "1.2.3.4", "255.256.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4485275742308327", "+1 (017) 555-7713", "+49", "++12.34 5678-9", " ", "\n", "é漢🙂", "word", "...", "-", "a@b.c-d@e.f", "12345678901234567890123", "+", "7"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(800)] + [x for x in odd_texts()]
    docs = docs_of(spark, texts).withColumn("kind", F.lit("clash")).withColumn("th", F.lit(0))
    got = pii.find(docs.unionByName(docs.where("doc_id = 3"))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (texts[r["doc_id"]], spans, r)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in spans) for k in PLAIN]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("context")] == spans
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_bootstrap(spark):
    rng = random.Random(15)
    texts = [f"{words(rng, 5)} contact number +1 (555) 010-{rng.randrange(1000, 9999)} {words(rng, 4)}" for _ in range(30)]
    texts += [f"{words(rng, 5)} contact number QX-{rng.randrange(10**6, 10**7)}. {words(rng, 4)}" for _ in range(8)]
    texts += [f"{words(rng, 5)} serial code QZ-{rng.randrange(10**6, 10**7)}. {words(rng, 4)}" for _ in range(30)]
    got = {r["doc_id"]: r for r in pii.find(docs_of(spark, texts)).collect()}
    for n, t in enumerate(texts):
        if 30 <= n < 38:
            start = t.index("QX-")
            assert got[n]["spans"] == f"context:{start}:{start + 10}" and got[n]["n_context"] == 1
        else:
            assert got[n]["n_context"] == 0


def test_pii_contexts_are_the_last_two_words(spark):
    """Whatever stands there: numbers, addresses, long words, many matches within a word."""
    rng = random.Random(17)
    long = "y" * 60
    bits = ["12", "a@b.cd", "1.2.3.4", "4111111111111111", "word", long, "Q1-" * 40 + "7", "+1 (555) 010-7713", "é🙂", "11a" * 30, "("]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "  \n", "", "\t"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    texts += [f"{long} {'z' * 300} x@y.zw", "11a" * 400 + "@b.cd", "head tail" + "1-" * 9 + "4111111111111111"]
    docs = docs_of(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("th"))
    got = pii.matches(docs).collect()
    assert len(got) > 1000
    for r in got:
        found = " ".join(re.sub("[0-9]+", "0", texts[r["doc_id"]][: r["start"]].lower()).split()[-2:])
        assert r["context"] == (hashlib.md5(found.encode()).hexdigest() if len(found) > pii.LONG else found), r


def test_pii_bootstrap_behind_numbers(spark):
    rng = random.Random(16)
    contexts = ["ref 12 from", "code 77", "x" * 40 + " " + "y" * 40]
    texts = [f"{words(rng, 5)} {c} +1 (555) 010-{rng.randrange(1000, 9999)} end" for c in contexts for _ in range(30)]
    texts += [f"{words(rng, 5)} {c} QX-{rng.randrange(10**6, 10**7)} end" for c in contexts for _ in range(8)]
    got = {r["doc_id"]: r for r in pii.find(docs_of(spark, texts)).collect()}
    for n, t in enumerate(texts):
        start = t.find("QX-")
        assert got[n]["n_context"] == (start >= 0), t
        assert start < 0 or got[n]["spans"] == f"context:{start}:{start + 10}"


def test_pii_patterns_after_a_match(spark):
    """The first two words after a match, whatever stands there; with them and with key-like seeds contexts find more."""
    rng = random.Random(21)
    bits = ["12", "a@b.cd", "4111111111111111", "word", "y" * 120, "Q1-" * 40 + "7", "+1 (555) 010-7713", "é🙂", "("]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "  \n", "", "\t"]) for _ in range(rng.randrange(14))) for _ in range(200)]
    got = pii.matches(docs_of(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("th"))).collect()
    for r in got:
        found = " ".join(re.sub("[0-9]+", "0", texts[r["doc_id"]][r["end"] :].lower()).split()[:2])
        assert r["after"] == (hashlib.md5(found.encode()).hexdigest() if len(found) > pii.LONG else found), r
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'{words(rng, 5)} token = "{k}"!! {words(rng, 4)}' for k in keys] + [f"{words(rng, 4)} token = pass-{n}77 {words(rng, 3)}" for n in range(5)]
    texts += [f"{words(rng, 4)} {k[::-1]} {words(rng, 4)}" for k in keys[:9]] + [f"{words(rng, 3)} {k[:9]}{k[20:]} expires in {words(rng, 2)}" for k in keys] + [f"{words(rng, 3)} K{n}-998 expires in {words(rng, 3)}" for n in range(6)]
    for r in pii.find(docs_of(spark, texts)).collect():
        t, n = texts[r["doc_id"]], r["doc_id"]
        span = re.search("(?<=token = )pass-[0-9]+|[0-9a-f]{29,40}|K[0-9]-998", t)
        assert r["spans"] == ("" if 35 <= n < 44 else f"context:{span.start()}:{span.end()}"), t
        assert r["n_spans"] == r["n_context"] == (0 if 35 <= n < 44 else 1)


@pytest.mark.parametrize("heavy", [2, 4096])
def test_pii_graph_scores(spark, monkeypatch, heavy):
    from tidewater.llm import common

    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(22)
    edges = {(f"p{min(rng.randrange(25), rng.randrange(25))}", min(rng.randrange(60), rng.randrange(60))) for _ in range(260)}
    seeds = {n for n in range(60) if n % 5 == 0}
    belief = {n: float(n in seeds) for _, n in edges}
    for _ in range(3):
        of = defaultdict(list)
        for p, n in edges:
            of[p].append(belief[n])
        score = {p: sum(x) / len(x) for p, x in of.items() if len(x) >= 5 and sum(x) > 0}
        for p, n in edges:
            belief[n] = max(belief[n], score.get(p, 0.0))
    frame = spark.createDataFrame([(p, n, n in seeds) for p, n in edges], "context string, instance long, seed boolean")
    got = {r["context"]: (r["confidence"], r["support"]) for r in pii.confident_patterns(frame, 3, 5, 0.3).collect()}
    expected = {p: (s, len(of[p])) for p, s in score.items() if s >= 0.3}
    assert got.keys() == expected.keys() and all(got[p] == pytest.approx(expected[p]) for p in got) and len(got) > 3


# --- queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    table = {"op3_embedding_cells": "embeddings"}.get(name, "documents")
    got = queries.queries()[name](spark, SF)
    rows = got.count()
    if name not in ("op6_chat_snapshots", "op8_best_fit", "op9_mix_ipf"):
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_sql(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, f"/root/testdata/{sf}")
    expected = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())


def test_learning_leaves_rows_on_the_executors(spark, monkeypatch):
    """A doc_id that repeats and long documents enter the counts whole; a bounded number of rows reaches the driver."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    monkeypatch.setattr(quality, "SAMPLE", 20)
    monkeypatch.setattr(quality, "BLOCKS", 30)
    rows = [(1, f"vile scum number {n}\nline") for n in range(60)] + [(n, "a calm and pleasant text of words") for n in range(2, 12)] + [(12, "vile " * 6000), (12, "scum line\n" * 3000), (13, None), (14, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n not in (1, 12)), int(n in (1, 12))) for n in range(1, 15)], "doc_id long, quality int, toxic int")
    seen = []
    curve = toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda *a: seen.append(a[2]) or curve(*a))
    monkeypatch.setattr(quality, "fit", lambda rows, marks: seen.append(rows) or quality.PRIOR)
    lexicon = toxicity.learn_labels(docs, labels)
    quality.fit_labels(docs, labels)
    assert [len(x) for x in seen] == [20, 30] and " scum " in lexicon.weights
    assert all(len(x) <= quality.BLOCK_LINES for x in seen[1])


def slow_rates(folded, marks, odds):
    p, n = sum(marks), len(marks) - sum(marks)
    counts = defaultdict(lambda: [0, 0])
    for text, mark in zip(folded, marks):
        held = set()
        for w in text.split():
            held.add(f" {w} ")
            held |= {f" {w[:k]}" for k in range(4, 9) if k <= len(w)}
        for x in held:
            counts[x][mark] += 1
    rated = []
    for x, (miss, hit) in counts.items():
        weight = np.log((hit + 0.5) / (p + 1)) - np.log((miss + 0.5) / (n + 1))
        if hit >= 4 and weight >= odds:
            rated.append((-hit * weight * (1 if x.endswith(" ") else 0.85), len(x), x, weight))
    return [(x, w) for _, _, x, w in sorted(rated)]


def test_lexicon_is_learnt_as_by_plain_counts(spark):
    rng = random.Random(27)
    foul = ["scoundrel", "blockhead", "rascal"]
    texts = [words(rng, 30, 60) + (" " + rng.choice(foul) + ("s " if rng.random() < 0.1 else " ") + words(rng, 9, 60) if k < 90 else " not blockhead " if k % 13 == 0 else "") for k in range(200)]
    marks = [int(k < 90) for k in range(200)]
    got = toxicity.learn(spark.createDataFrame([(n, t, m) for n, (t, m) in enumerate(zip(texts, marks))], "key long, text string, toxic int"))
    folded = [toxicity.fold(t) for t in texts]
    whole = {x.strip() for x, _ in slow_rates(folded, marks, 1.0)[:1600] if x.endswith(" ")}
    pairs = defaultdict(lambda: [0, 0])
    for t, m in zip(folded, marks):
        w = t.split()
        for x in {f"{a} {b}" for a, b in zip(w, w[1:]) if a in whole or b in whole}:
            pairs[x][m] += 1
    assert set(got.exceptions) == {x for x, (miss, hit) in pairs.items() if miss >= 8 and not hit} >= {"not blockhead"}
    cut = [re.sub(" (?:" + "|".join(got.exceptions) + ")(?= )", "", t) for t in folded]
    expected = toxicity.choose(slow_rates(cut, marks, 2.0))
    assert list(got.weights) == list(expected) and all(got.weights[x] == pytest.approx(w) for x, w in expected.items())
    assert any(x.startswith(" scoundrel") or x.startswith(" scou") for x in expected)


def test_matches_equal_plain_search():
    """The longest entry at each word, unless an exception phrase covers it."""
    rng = random.Random(28)
    for _ in range(300):
        vocabulary = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(8)]
        weights = {f" {w} " if rng.random() < 0.5 else f" {w}": rng.randrange(1, 9) for w in rng.sample(vocabulary, 5)}
        exceptions = tuple({" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))) for _ in range(3)})
        lexicon = toxicity.Lexicon(weights, exceptions)
        text = " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) + " "
        covered = [(m.start(), m.start() + len(e) + 1) for e in exceptions for m in re.finditer(f"(?= {re.escape(e)} )", text)]
        total = 0
        for at in (m.start() for m in re.finditer(" ", text)):
            fits = [e for e in weights if text.startswith(e, at)]
            if fits:
                e = max(fits, key=len)
                total += 0 if any(a <= at and at + len(e) - 1 <= b for a, b in covered) else weights[e]
        assert lexicon.total(text, lexicon.automaton()) == total
    many = toxicity.Lexicon({" a ": 1.0}, ("a a",))
    text, built = " a" * 100_000 + " ", many.automaton()
    began = time.perf_counter()
    assert many.total(text, built) == 0 and time.perf_counter() - began < 3
