"""Sums of the gradients of LM scoring in lanes."""

import numpy as np
import pytest

from loomveil.llm import lm_score


@pytest.mark.parametrize("n, size", [(1, 1), (7, 2), (36, 5000)])
def test_sums_in_lanes_are_those_of_bincount(n, size):
    rng = np.random.default_rng(n)
    at, weights = rng.integers(0, n, size), rng.normal(size=size).astype(np.float32)
    lanes = at + np.arange(size) % lm_score._LANES * n
    assert (lm_score.summed(lanes, None, n) == np.bincount(at, minlength=n)).all()
    assert lm_score.summed(lanes, weights, n) == pytest.approx(np.bincount(at, weights, n))
