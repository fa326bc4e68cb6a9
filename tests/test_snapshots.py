import pytest
from pyspark.sql import functions as F

from loomveil.operators import dashboard as D
from loomveil.sources.snapshots import SnapshotTable

SCHEMA = "key string, n int"


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def content(cache):
    return {r.key: r.n for r in cache.load().collect()}


def test_saves_replace_and_clear(spark, tmp_path):
    cache = D.InsightCache(spark, str(tmp_path), SCHEMA)
    assert content(cache) == {}
    cache.save(rows(spark, a=1, b=2))
    cache.save(rows(spark, b=3, c=4))
    assert content(cache) == {"a": 1, "b": 3, "c": 4}
    assert {r.key: r.n for r in cache.table.load(1).collect()} == {"a": 1, "b": 2}
    cache.clear()
    assert content(cache) == {}
    cache.table.vacuum(keep=1)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("data-")]) == 1
    cache.save(rows(spark, d=5))
    assert content(cache) == {"d": 5} and cache.table.version() == 4


def test_a_writer_that_stops_between_steps_loses_nothing(spark, tmp_path, monkeypatch):
    cache = D.InsightCache(spark, str(tmp_path), SCHEMA)
    cache.save(rows(spark, a=1))

    def stop(self, version, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", stop)  # data is written, the manifest is not
        with pytest.raises(KeyboardInterrupt):
            cache.save(rows(spark, b=2))
    assert content(cache) == {"a": 1}
    boom = F.udf(lambda n: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        cache.save(rows(spark, b=2).withColumn("n", boom("n")))  # data is half written
    assert content(cache) == {"a": 1}
    cache.save(rows(spark, c=3))
    assert content(cache) == {"a": 1, "c": 3}


def test_two_writers_and_damage(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), SCHEMA)
    other, done = SnapshotTable(spark, str(tmp_path), SCHEMA), []

    def change(now):
        if not done:  # another writer is faster
            done.append(other.commit(lambda d: d.unionByName(rows(spark, x=1))))
        return now.unionByName(rows(spark, y=2))

    assert table.commit(change) == 2
    assert {r.key for r in table.load().collect()} == {"x", "y"}
    (tmp_path / "manifests" / ".2.crc").unlink(missing_ok=True)
    (tmp_path / "manifests" / "2").write_text("{")
    with pytest.raises(ValueError, match="damaged"):
        table.load()


def test_validity(spark):
    full = {"cache_version": 1, "llm_context_documents": 240, "hierarchical_batch_documents": 60, "reranker": "r", "llm_model": "m", **dict.fromkeys(D.REQUIRED_FIELDS, "x")}
    cases = [(full, True), ({**full, "cache_version": 2}, False), ({**full, "quotes": None}, False), ({**full, "llm_model": None}, False), ({**full, "reranker": None}, False)]
    df = spark.createDataFrame([(i, *c.values()) for i, (c, _) in enumerate(cases)], "i int, cache_version int, llm_context_documents int, hierarchical_batch_documents int, reranker string, llm_model string, " + ", ".join(f"{c} string" for c in D.REQUIRED_FIELDS))
    settings = {"cache_version": 1, "llm_context_documents": 240, "hierarchical_batch_documents": 60, "reranker": "r"}
    assert [r.v for r in df.orderBy("i").select(D.valid_insight(settings, {"llm_model": "m", "llm_provider": None}).alias("v")).collect()] == [v for _, v in cases]
    with pytest.raises(ValueError):
        D.valid_insight({"cache_version": 1})
