from pyspark.sql import functions as F

from loomveil.operators import dashboard as D


def test_filters():
    assert D.api_filters({"jaar": "2024", "locatie": "Utrecht", "taal": "All", "opleiding": ""}) == {"academic_year": "2024", "location": "24"}
    assert D.checked_filters({"cohort": "1", "x": "y", "sector": "All"}) == {"cohort": "1"}


def test_insight_cache_replaces_and_clears(spark, tmp_path):
    cache = D.InsightCache(spark, f"{tmp_path}/cache", "key string, value int")
    assert cache.load().collect() == []
    cache.save(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"))
    cache.save(spark.createDataFrame([("b", 3)], "key string, value int"))
    assert sorted(cache.load().collect()) == [("a", 1), ("b", 3)]
    cache.clear()
    assert cache.load().collect() == []


def test_rebuilt_vectors_have_other_cache_keys(spark):
    row = spark.range(1).select(*(D.versioned_key(F.lit("t"), F.create_map(F.lit("k"), F.lit("v")), F.lit(v)).alias(f"k{v}") for v in (1, 2))).first()
    assert row.k1 != row.k2


def test_collection_ids_follow_the_order(spark, tmp_path):
    df = spark.range(50).select(F.format_string("a%03d", 49 - F.col("id")).alias("answer_id"), F.lit("x").alias("answer"), F.array(F.lit(1.0)).alias("embedding"), F.lit("q").alias("question"))
    rows = D.rebuild_collection(df, f"{tmp_path}/c", "id_", ["question"]).collect()
    assert {r.id: r.answer_id for r in rows} == {f"id_{i}": f"a{i:03d}" for i in range(50)}


def test_masking_report_is_one_row_with_zero_filled_tags(spark):
    masked = spark.createDataFrame([(1, "hi [NAME]"), (2, "x"), (3, None)], "i int, t string")
    row = D.masking_report(masked, spark.createDataFrame([("NAME", 1, 4)], "tag string, missed bigint, removed bigint"), ["t"], "i").first()
    assert (row.cells, row.affected, row.entities) == (2, 1, 1) and len(row.tags) == 5
    assert {t.tag: (t.n, t.missed, t.removed) for t in row.tags}["NAME"] == (1, 1, 4) and [s.cell for s in row.samples] == ["hi [NAME]"]
