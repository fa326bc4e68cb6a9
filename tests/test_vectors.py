import random

from loomveil.operators import vectors as V


def test_search_takes_more_queries_than_one_part(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = items.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in V.search(items, queries, 5, "vec_id", max_queries=6).collect()}
    want = {}
    for q, x in rows[::3]:
        near = sorted(rows, key=lambda r: 1 - sum(a * b for a, b in zip(x, r[1])))
        want |= {(q, k + 1): near[k][0] for k in range(5)}
    assert got == want
