"""Anchoring and refining kernels."""

import itertools

import numpy as np
import pytest

from strandline.operators import refinement as R


def test_window():
    assert R.signal_window(range(100), 50, 4, 6) == list(range(46, 56))
    out = R.signal_window(range(10), 1, 3, 3, mask_before=2)
    assert np.isnan(out[:4]).all() and out[4:] == [2, 3]
    assert R.signal_window(range(5), 50, 2, 2) is None


def test_lines():
    assert R.line_through([0, 1, 2], [1, 3, 5]) == pytest.approx((2.0, 1.0))
    assert R.line_through([0, 1, 2], [5, 3, 1]) == (1.0, 0.0) and R.line_through([1, 1], [0, 2]) == (1.0, 0.0)
    x = np.random.default_rng(1).standard_normal(500)
    got = R.rough_rescale(x, 3 * x + 2)
    assert got["scale"] == pytest.approx(3) and got["shift"] == pytest.approx(2)


def test_refine_finds_the_steps():
    rng = np.random.default_rng(2)
    levels = rng.permutation(np.linspace(-2, 2, 12))
    true = np.concatenate([[0], np.cumsum(rng.integers(6, 16, 12))])
    x = np.concatenate([np.full(b - a, v) for a, b, v in zip(true, true[1:], levels)]) * 20 + 90 + rng.standard_normal(true[-1]) * 0.5
    guess = np.clip(true + rng.integers(-3, 4, 13), 0, true[-1])
    guess[0], guess[-1] = 0, true[-1]
    found = R.refine_map(x, np.maximum.accumulate(guess), levels)
    assert len(found) == 13 and np.abs(np.array(found) - true).max() <= 1


def test_fold_and_call():
    got = R.fold_features([1, 10, 3, float("nan")], 2)
    assert got["x"] == [-1, 1, 0, 0] and got["mask"] == [1, 1, 1, 0]
    assert R.call_from_probabilities([0.4, 0.2, 0.4], [0, 0, 0]) == 2
    assert R.call_from_probabilities([0.5, 0.4, 0.1], [0.2, 0, 0]) == -1 and R.call_from_probabilities([], []) == -1
