"""Substring dedup: no lost text, runs with hot anchors, near-duplicate lines against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomveil.llm import substring_dedup
from loomveil.llm.linking import IdFilter
from loomveil.llm.substring_dedup import Settings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def test_words_that_a_near_copy_loses_stay_where_they_are_quoted(spark):
    line = [f"w{i}" for i in range(200)]
    near = [*line[:90], *(f"own{i}" for i in range(15)), *line[90:]]
    quote = ["say", *near[75:121], "end"]
    texts = [" ".join(line), " ".join(near), " ".join(quote), " ".join(quote[::-1] + near[60:110])]
    out = {r.id: r for r in substring_dedup.dedup_substrings(table(spark, texts), "id", report=True).collect()}
    assert out[0].text == texts[0] and out[1].text == "" and out[1].source_ids == [0]
    assert out[2].text == texts[2]
    # the first quote keeps the words, so it is the source of the next
    assert out[3].source_ids == [] or out[3].source_ids == [2]


def test_equal_paragraphs_are_sources_of_the_windows_around_them(spark):
    words = [[f"{c}{i}" for i in range(40)] for c in "pqrst"]
    join = lambda *parts: "\n\n".join(" ".join(p) for p in parts)
    texts = [join(words[0]), join(words[0], words[1][:20]), join(words[2], words[0], words[1][:20])]
    out = {r.id: r.text.split() for r in substring_dedup.dedup_substrings(table(spark, texts), "id").collect()}
    assert out == {0: words[0], 1: words[1][:20], 2: words[2]}


@pytest.mark.parametrize("hot", [1, 6, 10_000])
def test_runs_against_brute_force_with_hot_anchors(spark, hot):
    rnd, size = random.Random(8), 20
    pool = [[f"{rnd.choice('abcdef')}{rnd.randint(0, 60)}" for _ in range(120)] for _ in range(3)]
    texts = []
    for _ in range(40):
        a, b = rnd.randint(0, 70), rnd.randint(0, 70)
        texts.append(" ".join([*(f"u{rnd.randint(0, 9)}" for _ in range(4)), *rnd.choice(pool)[a : a + 45], "x", *pool[0][b : b + 30]]))
    gone = {i: (rnd.randint(0, 20), 8) for i in range(0, 40, 5)}
    split = [t.split() for t in texts]
    grams = [[tuple(w[k : k + size]) for k in range(len(w) - size + 1)] for w in split]
    first = {}
    for i, g in enumerate(grams):
        for k, x in enumerate(g):
            if not (i in gone and k < sum(gone[i]) and k + size > gone[i][0]):
                first[x] = min(i, first.get(x, i))
    want = {i: {k + j for k, x in enumerate(g) if first.get(x, i) < i for j in range(size)} for i, g in enumerate(grams)}
    rows = []
    for i, (at, n) in gone.items():
        for _, _, w in substring_dedup._blocks(substring_dedup.pa.array([texts[i]])):
            key = int(substring_dedup.textops.span_hashes(w.hashes(), substring_dedup.np.array([at]), substring_dedup.np.array([at + n])).view("int64")[0])
        # the second names other words, as a row of the same id and another text would
        rows.append((i, [(at, n, key), (1, 30, 5), (70, 900, 6)]))
    lists = spark.createDataFrame(rows, "id bigint, gone array<struct<at: int, n: int, hash: bigint>>")
    got = {i: set() for i in want}
    for r in substring_dedup.verbatim_spans(table(spark, texts), Settings(min_run=size, anchor=6, hot=hot), lists).collect():
        assert r.source < r.id
        got[r.id] |= set(range(r.at, r.at + r.n))
    assert got == want and any(want.values())


def test_near_lines_against_brute_force(spark):
    rnd = random.Random(4)
    base = [[f"{c}{rnd.randint(0, 500)}" for _ in range(60)] for c in "abcdefgh"]
    texts = []
    for _ in range(50):
        lines = []
        for w in rnd.sample(base, rnd.randint(0, 3)):
            w = list(w)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 9)}"
            lines.append(" ".join(w))
        texts.append("\n\n".join(lines))
    # paragraphs as word lists, their five-word shingles, and the components of links at 0.8
    found = [(i, at, tuple(x.split())) for i, t in enumerate(texts) for at, x in zip(*_starts(t))]
    items = sorted({w for *_, w in found})
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} for w in items]
    group = list(range(len(items)))
    for a in range(len(items)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    of = dict(zip(items, group))
    keep = {}
    for i, _, w in found:
        keep[of[w]] = min(i, keep.get(of[w], i))
    want = {(i, at, len(w), keep[of[w]]) for i, at, w in found if keep[of[w]] < i}
    got = {(r.id, r.at, r.n, r.source) for r in substring_dedup.duplicate_spans(table(spark, texts)).collect() if r.kind == "p"}
    assert got == want and len(want) > 20


def _starts(text):
    lines, at, starts = [x for x in text.split("\n") if WORDS.search(x)], 0, []
    for x in lines:
        starts.append(at)
        at += len(x.split())
    return starts, lines


def test_a_task_gets_one_bucket_of_windows(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(100 * (i % 3), 100 * (i % 3) + 200))) for i in range(9)]
    docs = spark.createDataFrame(rows, "id bigint, text string").withColumn("gone", F.lit(None).cast(substring_dedup._GONE))
    every = spark.sparkContext.broadcast(IdFilter(np.full(1 << 13, 255, np.uint8), 1 << 16))
    dealt = substring_dedup._dealt(docs, Settings(), 13, every, None)
    found = set(dealt.select("bucket", F.spark_partition_id().alias("task")).collect())
    assert len(found) > 6 and len({r.bucket for r in found}) == len({r.task for r in found}) == len(found)
