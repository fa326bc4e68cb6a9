"""The last round of linking: long traits are made and dealt out for rows with a partner that is close only."""

import random

from test_near_copies import components, copies

from loomveil.llm import ngram_join


def test_wide_parities_are_made_for_items_with_a_close_partner_only(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    near = [*copies(rng, words, 30, 2, 6), *copies(rng, words, 30, 9, 12)]
    # each text shares a passage, and so buckets, with the one before and the one after, and is like none
    passages = [[f"p{i}_{j}" for j in range(60)] for i in range(101)]
    texts = [*near, *(" ".join(a + b) for a, b in zip(passages, passages[1:]))]
    asked, traits = [], ngram_join.wide_traits

    def seen(docs, items, n):
        asked.append({r.item for r in items.collect()})
        return traits(docs, items, n)

    monkeypatch.setattr(ngram_join, "wide_traits", seen)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, n=5, percent=80).collect()}
    assert got == components(texts, 5, 80)
    assert len(asked) == 1 and asked[0] and asked[0] <= set(range(len(near))), asked
