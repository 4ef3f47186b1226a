"""Stages of the corpus pipeline, each against brute force on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tidewater.llm import quality  # noqa: E402
from tidewater.llm.common import materialize  # noqa: E402

from .test_operators import brute_lines, plain_rules, slow_fingerprint, union  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns or n == len(pipeline.STAGES) - 1
        seen.append(docs)
    texts = [{r["doc_id"]: r["text"] for r in x.collect()} for x in seen[:5]]
    field = quality.fit_labels(seen[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts[1]) == {k for k, t in texts[0].items() if not plain_rules(t)[5] and quality.judge(t.encode(), field, 0.5)[6]}
    ids = sorted(texts[1])
    assert [texts[2][k] for k in ids] == brute_lines([texts[1][k] for k in ids], 25)
    prints = {k: slow_fingerprint(t) for k, t in texts[2].items()}
    roots = union([(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    assert set(texts[3]) == set(roots.values())
    assert set(texts[4]) <= set(texts[3]) and all(texts[4][k] == texts[3][k] for k in texts[4])
    assert {r["doc_id"] for r in seen[5].select("doc_id").collect()} == set(texts[4])
    assert pipeline.run(spark, SF).count() == seen[5].count()
