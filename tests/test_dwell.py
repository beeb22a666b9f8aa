"""Alignment with dwell costs against all ways to cut, and running totals over blocks against plain sums."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import evaluation as E
from strandline.operators import kernels as K
from strandline.operators import refinement as N
from strandline.operators import summary as M


def cost(x, levels, cuts, target, weight):
    near, total = min(256, max(8, math.ceil(2 * target))), 0.0
    for level, a, b in zip(levels, cuts, cuts[1:]):
        total += sum((v - level) ** 2 for v in x[a:b])
        past = b - a - 1
        if b - a <= near:
            total += weight * ((target - past) ** 2 if past < target else math.log(1 + past / target))
    return total


@pytest.mark.parametrize("target,weight", [(3.0, 0.0), (3.0, 0.2), (2.0, 1.5), (6.0, 0.05)])
def test_dwell_path_is_least_cost(target, weight):
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (4, 4), (9, 2), (14, 3), (22, 2)]:
        x, levels = rng.normal(size=n), rng.normal(size=m)
        got = K.dwell_path(x, levels, np.zeros(m, int), np.full(m, n), target, weight)
        assert got[0] == 0 and got[-1] == n and len(got) == m + 1
        least = min(cost(x, levels, (0, *c, n), target, weight) for c in itertools.combinations(range(1, n), m - 1))
        assert cost(x, levels, got, target, weight) == pytest.approx(least)
        if not weight:
            assert got == K.banded_path(x, levels, np.zeros(m, int), np.full(m, n))


def test_dwell_path_keeps_to_its_band():
    x = np.r_[np.zeros(10), np.ones(30)]
    guess = [0, 20, 40]
    assert K.dwell_path(x, [0.0, 1.0], [0, 15], [25, 40], 4.0, 0.0) == [0, 15, 40]
    assert K.dwell_path(x, [0.0, 1.0], *K.half_band(guess, 1, 40), 4.0, 0.0) == [0, 10, 40]
    assert K.dwell_path([1.0], [1.0, 2.0], [0, 0], [1, 1], 4.0, 1.0) == [] and K.dwell_path([], [], [], [], 4.0, 1.0) == []
    assert K.dwell_path(x, [0.0, 1.0], [0, 30], [20, 40], 4.0, 0.0) == []  # the bands do not meet


def test_dwell_costs_stop_collapse():
    rng = np.random.default_rng(2)
    levels = np.array([0.0, 1.0, 0.1, 1.2, 0.2, 0.9])
    x = np.repeat(levels, 12) + rng.normal(scale=0.05, size=72)
    found = N.refine_map(x, np.linspace(0, 72, 7).astype(int), levels, dwell=(6.0, 0.01))
    assert len(found) == 7 and np.abs(np.array(found) - np.arange(0, 73, 12)).max() <= 2


def test_running_totals_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(v)) for g, v in zip(rng.choice(["a", "b"], 400), rng.integers(0, 60_000, 400))] + [(None, 7), (None, 9000), ("c", 0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v long")

    def plain(values):
        run, values = 0, sorted(values, reverse=True)
        for v in values:
            run += v
            if run >= sum(values) // 2:
                return v

    want = {g: plain([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", "c", None)}
    assert {r.g: r.n50 for r in M.n50(df, "v", ["g"]).collect()} == want
    assert M.n50(df, "v").collect()[0].n50 == plain([v for _, v in rows if v is not None])
    assert [r.n50 for r in M.n50(df.limit(0), "v").collect()] == [None] and M.n50(df.limit(0), "v", ["g"]).count() == 0


def test_boundary_differences_over_many_blocks(spark):
    values = [int(v) for v in np.random.default_rng(4).integers(-20_000, 20_000, 300)]
    got = E.boundary_differences(spark.createDataFrame([(v,) for v in [*values, None]], "difference long").where(F.lit(True))).collect()[0]
    order = sorted(map(abs, values))
    assert (got.median_abs, got.p95_abs) == (order[150], order[int(0.95 * 300)])
