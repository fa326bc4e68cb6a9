import glob
import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from loomveil.llm import decontam, ngram_join, registry

SF = "/root/testdata/sf0.001"


def test_decontamination_with_clashing_columns_and_several_blocks(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randint(0, 400)}"
    items = [[word() for _ in range(rnd.choice([3, 10, 14, 25]))] for _ in range(12)]
    texts = []
    for _ in range(40):
        item = rnd.choice(items)
        a = rnd.randint(0, max(0, len(item) - 8))
        texts.append(" ".join([*(word() for _ in range(9)), *item[a : a + rnd.choice([5, 10, 12, 30])], *(word() for _ in range(6))]))
    texts += [None, "", "..."]
    docs = spark.createDataFrame([(i, t, i, "h", "m", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, __words int, __hits string, __items string, n_hit int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    want = {}
    for i, t in enumerate(texts):
        words, hit, found = decontam_words(t), set(), set()
        for k, item in enumerate(items):
            m = min(10, len(item))
            for b in range(len(item) - m + 1):
                for a in range(len(words) - m + 1):
                    if words[a : a + m] == item[b : b + m]:
                        hit |= set(range(a, a + m))
                        found.add(str(k))
        want[i] = (len(words), len(hit), sorted(found))
    for chars in (1 << 20, 150):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, bench, block_chars=chars).collect()}
        assert got == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    assert decontam.drop_contaminated(docs.limit(0), bench).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def decontam_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_keep_one_with_maps_and_repeated_ids(spark):
    rows = [(1, "a b c d", {"x": 1}), (1, "a b c d", {"x": 1}), (1, "a b c d", {"x": 2}), (2, "e f g h", None)]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>")).collect()
    assert sorted((r.doc_id, str(r.m)) for r in out) == [(1, "{'x': 1}"), (1, "{'x': 2}"), (2, "None")]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = entry.queries()[name](spark, SF), con.sql(registry.ORACLE[name])
    names, order = want.columns, sorted(df.columns)
    assert sorted(names) == order
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    got = sorted(repr([value(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([value(dict(zip(names, r))[c]) for c in order]) for r in want.fetchall())
