"""Sequential kernels against slow, plain versions."""

import itertools

import numpy as np
import pytest

from strandline.operators import kernels as K


def plain_dtw(a, b, window=None, penalty=0.0):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if window is None or abs(i - j) <= window:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j] + penalty**2, d[i, j - 1] + penalty**2)
    return np.sqrt(d[-1, -1]) if len(a) and len(b) else np.inf


@pytest.mark.parametrize("window,penalty", [(None, 0.0), (None, 0.5), (3, 0.2), (1, 0.0)])
def test_dtw(window, penalty):
    rng = np.random.default_rng(1)
    for n, m in [(5, 5), (7, 6), (1, 4), (9, 9)]:
        a, bank = rng.standard_normal(n), rng.standard_normal((4, m))
        want = [plain_dtw(a, b, window, penalty) for b in bank]
        assert K.dtw_many(a, bank, window, penalty) == pytest.approx(want)
    assert K.dtw([], [1.0]) == np.inf and K.dtw([0, 0, 0], [0], penalty=2.0) == pytest.approx(np.sqrt(8.0))


def test_ttest_and_maxima():
    x = np.concatenate([np.ones(50), np.full(50, 10.0)])
    scores = K.ttest_scores(x, 10)
    assert len(scores) == 80 and abs(int(scores.argmax()) - 40) <= 10 and not K.ttest_scores(np.full(50, 5.0), 10).any()
    assert K.strict_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3, 3])).tolist() == [1, 4]
    rng = np.random.default_rng(2)
    x = rng.standard_normal(60)
    for i, s in enumerate(K.ttest_scores(x, 6)):
        a, b = x[i : i + 6], x[i + 6 : i + 12]
        assert s == pytest.approx(abs(a.mean() - b.mean()) / np.sqrt(((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()))


def test_change_points_are_greedy_and_apart():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal(8) * 5, 12) + rng.standard_normal(96) * 0.01
    cuts = K.change_points(x, 4, 7, 6)
    assert len(cuts) == 7 and min(np.diff(cuts)) >= 6
    assert all(min(abs(c - t) for t in range(12, 96, 12)) <= 1 for c in cuts)
    assert [(s["start"], s["end"], s["mean"]) for s in K.segments([1, 1, 5, 5, 5, 2, 2], [2, 5])] == [(0, 2, 1.0), (2, 5, 5.0), (5, 7, 2.0)]


def test_likelihood_split():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(40), 6 + rng.standard_normal(30)])
    at, gain = K.likelihood_split(x, 0, 70, 5, 5)
    want = max(((70 * np.log(x.var()) - i * np.log(x[:i].var()) - (70 - i) * np.log(x[i:].var())), -i) for i in range(5, 65))
    assert gain == pytest.approx(want[0]) and at == -want[1]
    assert K.likelihood_split(np.ones(20), 0, 20, 2, 2) is None and K.adapter_parts([np.ones(30)], 5, 2) == [None]


def test_banded_path_is_least_cost():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, m = 9, 4
        x, levels = rng.standard_normal(n), rng.standard_normal(m)
        got = K.banded_path(x, levels, np.zeros(m, int), np.full(m, n))
        cost = lambda c: sum(((x[a:b] - v) ** 2).sum() for a, b, v in zip(c, c[1:], levels))
        best = min(cost([0, *c, n]) for c in itertools.combinations(range(1, n), m - 1))
        assert len(got) == m + 1 and cost(got) == pytest.approx(best)
    assert K.banded_path([1.0], [1.0, 2.0], [0, 0], [1, 1]) == []


def test_coupling_and_trees():
    p = np.array([0.6, 0.3, 0.1])
    pairwise = p[:, None] / (p[:, None] + p[None, :])
    assert K.couple(pairwise) == pytest.approx(p, abs=0.01)
    tree = {"feature": [0, -1, -1], "threshold": [0.5, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, 1.0, -1.0], "missing_left": [True, True, True], "class": 0}
    assert K.tree_ensemble([0.5], [tree], np.zeros(1))[1] == pytest.approx(1 / (1 + np.exp(-1)))
    assert K.tree_ensemble([float("nan")], [tree], np.zeros(1))[1] > 0.5 > K.tree_ensemble([0.6], [tree], np.zeros(1))[1]


def test_lattice_prefers_the_scored_path():
    scores = np.full((6, 4, 5), -9.0)
    scores[:, :, 0] = -1.0
    for t, state in [(1, 2), (3, 0), (5, 3)]:
        scores[t, state, 1:] = 8.0
    assert K.lattice_decode(scores.tolist(), 4, 1).endswith("GAT")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 5000])
def test_codec(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-32768, 32768, n).astype(np.int16) if n != 5000 else np.cumsum(rng.integers(-90, 90, n)).astype(np.int16)
    assert np.array_equal(K.decompress_signal(K.compress_signal(x), n), x)
    if n > 1:
        with pytest.raises(ValueError):
            K.decompress_signal(K.compress_signal(x), n - 1)


def test_theil_sen():
    fit = K.theil_sen([0, 1, 2, 3, 4], [1, 3, 5, 7, 100])
    assert fit == {"slope": 2.0, "intercept": 1.0}


def test_exploded_arrays_are_made_once(spark):
    from strandline.plans.registry import _exploded

    pack = K.column(lambda x: [v * 2 for v in x], "array<double>")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None), (4, [3.0])], "id long, x array<double>")
    found = _exploded(df.select("id", pack("x").alias("y")))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2.0), (1, 2, 4.0), (4, 1, 6.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
