"""Built-in forms of change points, fingerprints, windows and slopes against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import preparation as P
from strandline.operators import kernels as K
from strandline.operators import refinement as R
from strandline.operators import segmentation as G


def signals(seed=1):
    rng = np.random.default_rng(seed)
    out = {i: np.repeat(rng.normal(size=9), rng.integers(1, 14, 9)) + rng.normal(scale=0.1, size=1) for i in range(12)}
    out |= {i: rng.normal(size=int(rng.integers(1, 90))) for i in range(20, 40)}
    return out | {50: np.ones(40), 51: np.array([1.0]), 52: np.r_[np.zeros(20), np.ones(20)]}


@pytest.mark.parametrize(("width", "count", "separation"), [(4, 6, 4), (3, 2, 9), (5, 50, 1)])
def test_change_points(spark, width, count, separation):
    # Without noise the spread inside the windows is rounding alone, which the two forms round differently.
    noisy = {k: x + np.random.default_rng(k).normal(scale=0.01, size=len(x)) for k, x in signals().items()}
    rows = [(k, i, float(v)) for k, x in noisy.items() for i, v in enumerate(x)]
    got = {r["id"]: r["cuts"] for r in G.change_points(spark.createDataFrame(rows, "id long, i long, v double"), width, count, separation).collect()}
    assert got == {k: K.change_points(x, width, count, separation) for k, x in noisy.items()}


def test_fingerprints(spark):
    noisy = {k: x + np.random.default_rng(k).normal(scale=0.05, size=len(x)) for k, x in signals(2).items()}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in noisy.items()], "id long, x array<double>")
    for n, keep in ((4, None), (6, 3)):
        got = {r["id"]: r["values"] for r in G.fingerprints(df, n, 4, keep=keep).collect()}
        for k, x in noisy.items():
            want = K.fingerprint(x, n, 4, keep=keep)
            assert (got[k] is None) == (want is None) and (want is None or got[k] == pytest.approx(want))


def test_windows_and_slopes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([1, 2, 3, 9, 12, 30])] + [(9, [])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    for anchor, left, right, mask in ((5, 3, 4, 0), (0, 2, 2, 0), (10, 4, 4, 9), (2, 2, 30, 4)):
        got = {r["id"]: r["w"] for r in df.select("id", P.signal_window(F.col("x"), anchor, left, right, mask).alias("w")).collect()}
        for i, x in rows:
            want = R.signal_window(x, anchor, left, right, mask)
            assert (got[i] is None) == (want is None) and (want is None or np.array_equal(got[i], want, equal_nan=True))
    slopes = {r["id"]: r["s"] for r in df.select("id", P.median_slope(F.col("x")).alias("s")).collect()}
    for i, x in rows:
        assert slopes[i] == pytest.approx(K.theil_sen(np.arange(len(x)), x)["slope"])
