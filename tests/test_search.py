import numpy as np
import pytest
from pyspark.sql import functions as F

from loomveil.operators import vectors as V


@pytest.mark.parametrize("most", [20, 4096])
def test_blocked_search_against_brute_force(spark, most):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    x[x.any(axis=1) == 0] = 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, [1.0, 0.0, 0.0, 0.0])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        items = spark.createDataFrame(rows, "i bigint, embedding array<double>").repartition(4)
        queries = items.where("i % 3 = 0").select(F.concat(F.lit("q"), "i").alias("query_id"), "embedding")
        got = {}
        for r in V.search(items, queries, 7, "i", max_queries=most).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.i))
        assert V.search(items.limit(0), queries, 7, "i").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for q in range(0, 300, 3):
        d = [(round(1.0 - float(x[q] @ v), 12), i) for i, v in enumerate(x)]
        want[f"q{q}"] = [i for _, i in sorted(d)[:7]]
    for q, ids in want.items():
        own = [i for _, i in sorted(got[q])]
        near = lambda ids: [round(1.0 - float(x[int(q[1:])] @ x[i]), 9) for i in ids]
        assert near(own) == near(ids) and len(set(own)) == 7
    assert got.keys() == want.keys()


def test_reranking_by_words_and_without(spark):
    docs = spark.createDataFrame([(0, "red apple", [1.0, 0.0]), (1, "green pear", [0.8, 0.6]), (2, "red red wine", [0.6, 0.8]), (3, None, [0.0, 1.0])], "i bigint, t string, embedding array<double>")
    queries = spark.createDataFrame([("q", "red wine", [1.0, 0.0])], "query_id string, query_text string, embedding array<double>")
    out = V.two_stage_search(docs, queries, 3, "i", "t").orderBy("id").collect()
    assert [(r.i, r.similarity, r.percentage) for r in out] == [(2, 0.6, 60.0), (0, 1.0, 100.0), (1, 0.8, 80.0)]
    assert out[0].candidate_count == 4 and out[0]["count"] == 3 and out[2].reranker_score == 0.0
    plain = V.two_stage_search(docs, queries, 3, "i", "t", reranker=False).orderBy("id").collect()
    assert [r.i for r in plain] == [0, 1, 2] and plain[0].reranker_score is None
