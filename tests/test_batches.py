"""Moving bands against the full alignment, prefix cells against all paths of a small lattice."""

import itertools

import numpy as np
import pytest

from strandline.operators import batches as B
from strandline.operators import kernels as K

LEVELS = [0.0, 1.0, -0.5, 0.5, -1.0]


def full(x, levels):
    return K.banded_path(x, levels, np.zeros(len(levels), int), np.full(len(levels), len(x)), stay_wins=False)


def test_step_signals():
    x = np.repeat(LEVELS, 10)[None]
    true = np.arange(0, 51, 10)
    for guess, width in ((true, 11), (np.r_[0, true[1:-1] - 5, 50], 15)):
        assert B.moving_band_paths(x, np.array([LEVELS]), guess[None], width)[0].tolist() == true.tolist()


def test_equals_the_full_alignment_where_the_band_holds_it():
    rng = np.random.default_rng(1)
    reads, m = 40, 8
    levels = rng.normal(size=(reads, m)) + np.where(np.arange(m) % 2, 2.0, -2.0)
    dwell = rng.integers(4, 12, size=(reads, m))
    dwell[:, -1] += 100 - dwell.sum(1)
    x = np.stack([np.repeat(v, d) for v, d in zip(levels, dwell)]) + rng.normal(scale=0.2, size=(reads, 100))
    guess = np.tile(np.linspace(0, 100, m + 1).astype(int), (reads, 1))
    want = [full(a, b) for a, b in zip(x, levels)]
    assert B.moving_band_paths(x, levels, guess, 200).tolist() == want
    narrow = B.moving_band_paths(x, levels, guess, 40)
    assert sum(a.tolist() == b for a, b in zip(narrow, want)) >= 38
    assert (np.diff(narrow, axis=1) > 0).all() and (narrow[:, 0] == 0).all() and (narrow[:, -1] == 100).all()


def test_short_and_failing_reads_keep_their_guess():
    one = lambda x, levels, guess, *a: B.moving_band_paths(np.array([x], float), np.array([levels], float), np.array([guess]), *a)[0].tolist()
    assert one([1.0], [1.0, 2.0], [0, 0, 1], 5) == [0, 0, 1]
    assert one([1.0, 2.0], [1.0, 2.0], [0, 2, 2], 2) == [0, 1, 2]
    noisy = np.random.default_rng(3).normal(scale=9, size=60)
    assert one(noisy, LEVELS, [0, 12, 24, 36, 48, 60], 9, 1.0) == [0, 12, 24, 36, 48, 60]


def test_bands_in_spark(spark):
    rows = [(1, np.repeat(LEVELS, 10).tolist(), LEVELS, list(range(0, 51, 10))), (2, np.repeat(LEVELS[:3], 7).tolist(), LEVELS[:3], [0, 5, 12, 21]), (3, None, LEVELS, [0]), (4, [], [], [0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, levels array<double>, boundaries array<long>")
    got = {r["id"]: r["boundaries"] for r in B.align_moving_band(df, 12).collect()}
    assert got == {1: list(range(0, 51, 10)), 2: [0, 7, 14, 21], 3: None, 4: [0]}


def emissions(s, n_base, state_len):
    """log of the summed weight of every emitted sequence, over all paths."""
    steps, states, _ = s.shape
    total = {}
    for start in range(states):
        for choice in itertools.product(range(n_base + 1), repeat=steps):
            state, weight, out = start, 0.0, ""
            for t, c in enumerate(choice):
                if c == 0:
                    weight += s[t, state, 0]
                else:  # a base is emitted, the oldest one is dropped
                    dropped = state * n_base // states
                    state = state * n_base % states + c - 1
                    weight += s[t, state, 1 + dropped]
                    out += "ACGT"[c - 1]
            total[out] = np.logaddexp(total.get(out, -np.inf), weight)
    return total


@pytest.mark.parametrize(("n_base", "state_len", "steps"), [(2, 1, 5), (2, 2, 5), (2, 3, 4), (3, 2, 4)])
def test_panel_scores_equal_all_paths(n_base, state_len, steps):
    rng = np.random.default_rng(4)
    alphabet = "NACGT"[: n_base + 1]
    lattice = rng.normal(size=(3, steps, n_base**state_len, n_base + 1))
    panel = ["".join(p) for n in range(state_len, steps + 1) for p in itertools.product(alphabet[1:], repeat=n)]
    cells = B.PrefixCells(panel, n_base, state_len, alphabet)
    got = cells.scores(lattice)
    for read in range(3):
        weights = emissions(lattice[read], n_base, state_len)
        whole = np.logaddexp.reduce(list(weights.values()))
        assert got[read] == pytest.approx([weights[r] - whole for r in panel])
    assert len(cells.state) < cells.unshared


def test_panels_share_prefixes_and_refuse_bad_references(spark):
    rng = np.random.default_rng(5)
    panel = ["ACGTACGT" + "".join(rng.choice(list("ACGT"), 12)) for _ in range(200)]
    cells = B.PrefixCells(panel, 4, 2)
    assert len(cells.state) <= 16 + 4 + 7 + 200 * 12 and cells.unshared == 200 * (16 + 4 + 19)
    lattice = rng.normal(size=(2, 30, 16, 5))
    got = cells.scores(lattice)
    alone = np.stack([B.PrefixCells([r], 4, 2).scores(lattice)[:, 0] for r in panel], 1)
    assert got == pytest.approx(alone)
    rows = [(i, x.ravel().tolist()) for i, x in enumerate(lattice)] + [(7, None)]
    spread = {r["id"]: r["log_p"] for r in B.score_panel(spark.createDataFrame(rows, "id long, scores array<double>"), panel, 4, 2).collect()}
    assert spread[7] is None and spread[0] == pytest.approx(got[0]) and spread[1] == pytest.approx(got[1])
    for bad in ([], ["A"], ["AXA"]):
        with pytest.raises(ValueError):
            B.PrefixCells(bad, 4, 2)
