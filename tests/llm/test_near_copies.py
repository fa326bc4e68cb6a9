"""Near copies of one text that are not similar enough: the join tells them apart without checking all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomveil.llm import ngram_join, textops


def copies(rng, words, n, least, most):
    """n copies of words, each with between least and most of its words replaced."""
    out = []
    for _ in range(n):
        own = list(words)
        for i in rng.sample(range(len(own)), rng.randint(least, most)):
            own[i] = f"x{rng.random()}"
        out.append(" ".join(own))
    return out


def components(texts, n, percent):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[a] != least[b]:
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = [new if x == old else x for x in least]
    return dict(enumerate(least))


def test_pairs_checked_do_not_grow_with_the_square_of_a_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    # 8 words replaced are the limit to the text itself: some copies link with it, and the others with nothing
    texts = [" ".join(words), *copies(rng, words, 50, 2, 6), *copies(rng, words, 50, 9, 12)]
    n_pairs, check = [], ngram_join.exact_check

    def counted(sets, percent):
        own = check(sets, percent)

        def run(pairs):
            n_pairs.append(pairs.count())
            return own(pairs)

        return run

    monkeypatch.setattr(ngram_join, "exact_check", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, n=5, percent=80).collect()}
    assert got == components(texts, 5, 80)
    assert n_pairs[-1] <= len(texts), n_pairs


@pytest.mark.parametrize("most", [8, 512])
def test_wide_parities_bound_the_difference_of_sets_of_any_sizes(spark, most):
    rng, rows = np.random.default_rng(3), []
    for size in (1, 3, 60, 127, 129, 500, 1030, 4100):
        base = rng.integers(0, 2**63, size=size, dtype=np.uint64)
        for share in (0, 0.05, 0.2, 0.6):
            keep = base[rng.random(size) >= share]
            rows.append(np.unique(np.append(keep, rng.integers(0, 2**63, size=1 + int(share * size / 2), dtype=np.uint64))))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    wide, cut = textops.wide_parities(np.concatenate(rows), bounds, most)
    df = spark.createDataFrame([(i, len(r), wide[cut[i] : cut[i + 1]].tolist()) for i, r in enumerate(rows)], "item long, n_shingles long, wide array<bigint>")
    both = df.select(F.struct("*").alias("x")).crossJoin(df.select(F.struct("*").alias("y"))).select("x.item", F.col("y.item").alias("other"), ngram_join.wide_close(80)("x", "y").alias("close")).collect()
    for r in both:
        a, b = rows[r.item], rows[r.other]
        common = len(np.intersect1d(a, b))
        assert r.close or 100 * common < 80 * (len(a) + len(b) - common)
    alike = [r.close for r in both if 80 * max(len(rows[r.item]), len(rows[r.other])) <= 100 * min(len(rows[r.item]), len(rows[r.other]))]
    assert sum(alike) < 0.6 * len(alike) or most == 8
