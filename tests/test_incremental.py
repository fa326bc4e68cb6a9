from pyspark.sql import functions as F

from loomveil.streaming import incremental as N


def test_changed_settings_start_anew_and_the_same_go_on(spark, tmp_path):
    src, out, mark, status = (str(tmp_path / n) for n in ("src", "out", "mark", "status"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string").write.parquet(src)
    run = lambda settings: N.run_available(spark, src, "k int, t string", out, mark, lambda d: d.withColumn("t", F.upper("t")), settings=settings, status=status)
    first, second = {"columns": ["t"], "layers": ["a"]}, {"columns": ["t"], "layers": ["a", "b"]}
    assert run(first) == 1 and run(first) == 0 and run(second) == 1
    spark.createDataFrame([(3, "c")], "k int, t string").write.mode("append").parquet(src)
    assert run(first) == 1
    read = lambda s: sorted((r.k, r.t) for r in N.results(spark, out, s, "k int, t string").collect())
    assert read(first) == [(1, "A"), (2, "B"), (3, "C")] and read(second) == [(1, "A"), (2, "B")]
    got = {r.fingerprint: (r.runs, r.batches, r.rows) for r in N.run_status(spark, status).collect()}
    assert got == {N.fingerprint(first): (3, 2, 3), N.fingerprint(second): (1, 1, 2)}


def test_overviews_are_made_once(spark, tmp_path):
    made = []

    def make(filters):
        made.append(filters)
        return spark.createDataFrame([(len(made),)], "n int")

    first = N.Overviews(spark, str(tmp_path), "v1")
    assert [first.get(f, make).first().n for f in ({"a": "x", "b": "All"}, {"a": "x"}, {"a": "y"}, {"a": "x"})] == [1, 1, 3, 1]
    assert N.Overviews(spark, str(tmp_path), "v2").get({"a": "x"}, make).first().n == 5
