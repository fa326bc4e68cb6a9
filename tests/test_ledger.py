import pytest
from pyspark.sql import functions as F

from loomveil.operators.ledger import Ledger


def answer(prompts):
    """A stand-in for a model: counts the answers of a prompt, or adds up counts."""
    many = F.size(F.split("prompt", "\n- ")) - 1
    total = F.aggregate(F.from_json(F.regexp_extract("prompt", r"\[.*\]", 0), "array<struct<n:bigint>>"), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    n = F.when(F.col("level") == 0, many.cast("bigint")).otherwise(total)
    return prompts.select("prompt_id", F.when(F.col("theme") == "bad", "no json").otherwise(F.concat(F.lit('Sure: {"n": '), n.cast("string"), F.lit("} ok"))).alias("reply"), F.lit(None).cast("string").alias("error"))


def documents(spark):
    sizes = {"one": 3, "two": 11, "deep": 95, "bad": 7}
    return spark.createDataFrame([(t, i, None if i == 2 else f"text {i}") for t, n in sizes.items() for i in range(n)], "theme string, i int, text string"), sizes


def test_themes_are_reduced_to_one_reply(spark, tmp_path):
    docs, sizes = documents(spark)
    ledger = Ledger(spark, str(tmp_path), fan=3, tries=2)
    ledger.plan(docs, ["i"], size=5, cap=None)
    before = ledger.rows().count()
    ledger.plan(docs, ["i"], size=5, cap=None)
    assert ledger.rows().count() == before == 1 + 3 + 19 + 2
    rounds = ledger.run(answer)
    got = {r.theme: (r.n_docs, r.parsed.n if r.parsed else None, r.error) for r in ledger.results("n bigint").collect()}
    assert got == {**{t: (n, n, None) for t, n in sizes.items() if t != "bad"}, "bad": (None, None, "the reply holds no JSON")}
    assert rounds == 4 and ledger.run(answer) == 0  # 19, 7, 3 and 1 prompts of the deep theme
    assert ledger.rows().where("theme = 'bad'").agg(F.max("tries")).first()[0] == 2


def test_a_rerun_asks_only_what_is_missing(spark, tmp_path):
    docs, _ = documents(spark)
    first = Ledger(spark, str(tmp_path), fan=3)
    first.plan(docs, ["i"], size=5)
    first.record(answer(first.pending().where("node < 4")))
    with pytest.raises(RuntimeError):
        first.run(lambda prompts: (_ for _ in ()).throw(RuntimeError("the model is gone")))
    again, asked = Ledger(spark, str(tmp_path), fan=3), []

    def watched(prompts):
        asked.append({(r.theme, r.node) for r in prompts.where("level = 0").collect()})
        return answer(prompts)

    again.run(watched)
    assert {x for x in asked[0] if x[0] != "bad"} == {("deep", n) for n in range(4, 19)}
    assert not {x for s in asked[1:] for x in s if x[0] != "bad"}
    assert again.results("n bigint").where("theme = 'deep'").first().parsed.n == 95
