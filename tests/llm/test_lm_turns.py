"""Words looked up by their first bits, and the order in which documents of a block are scored together."""

import numpy as np
import pytest

from loomveil.llm import lm_score, textops


def code_of(keys):
    return lm_score.Code(keys, np.arange(1, len(keys) + 1), 1, np.zeros(4, np.int64), np.zeros(4, np.int64))


@pytest.mark.parametrize("spread", [True, False])
def test_symbols_are_found_among_hashes_with_the_same_first_bits(spread):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64) if spread else np.append(np.arange(7, 3000, 5, dtype=np.uint64), np.uint64(2**64 - 1)))
    code = code_of(rng.permutation(keys))
    h = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    place = {k: code.first + i for i, k in enumerate(keys.tolist())}
    assert code.symbols(h).tolist() == [place.get(x, 1 + x % 4) for x in h.tolist()]
    assert code.index is not None


def test_documents_of_a_block_are_scored_step_by_step_together():
    rng = np.random.default_rng(4)
    data = [" ".join(f"w{i}" for i in rng.integers(0, 50, n)).encode() for n in (20_000, *[700] * 40, 0, 1, 64, 63)]
    bounds = np.cumsum([0, *map(len, data)])
    w = textops.split_words(np.frombuffer(b"".join(data), np.uint8), bounds, textops.SPACE_WORDS, True)
    t = lm_score.Tokens(w, code_of(np.unique(w.hashes())))
    turns = list(lm_score._turns(t))
    assert sorted(np.concatenate([some for some, _ in turns]).tolist()) == list(range(len(t.hash)))
    order, seen, n = [], set(), 0
    for some, first in turns:
        for a, b in zip(first, [*first[1:], len(some)]):
            step, doc = t.at[some[a:b]] // lm_score.STEP, t.doc[some[a:b]]
            assert len(set(step)) == 1 and (np.diff(doc) >= 0).all()
            assert all(np.count_nonzero(doc == d) == np.count_nonzero((t.doc == d) & (t.at // lm_score.STEP == step[0])) for d in set(doc))
            order.append(step[0])
            n += 1
    assert order == sorted(order)
    # the long text has 313 steps; those of all others go along with its first ones
    assert n < 313 + 60


def test_bit_counts_need_no_match_model():
    w = textops.split_words(np.frombuffer(b"a b c a b c", np.uint8), np.array([0, 11]), textops.SPACE_WORDS, True)
    code = code_of(np.unique(w.hashes()))
    t, whole = lm_score.Tokens(w, code, match=False), lm_score.Tokens(w, code)
    assert not hasattr(t, "match") and (whole.match >= 0).any()
    a, b = lm_score.Counts(16), lm_score.Counts(16)
    assert list(a.add(t, code)) == list(b.add(whole, code)) == [] and (a.total == b.total).all() and a.total.any()
