"""Statistics by running counts against plain Python, and without gathering rows."""

import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from strandline.operators import calls, summary


def n50(values):
    run = 0
    for v in sorted(values, reverse=True):
        run += v
        if run >= sum(values) // 2:
            return v
    return 0


@pytest.mark.parametrize("block", [3, 4096])
def test_statistics(spark, monkeypatch, block):
    monkeypatch.setattr(summary, "BLOCK", block)
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.randrange(1, 60), rng.randrange(1, 10**6)])) for g in "abc" for _ in range(151)] + [("none", None), (None, 4), (None, 7)]
    got = {r["g"]: r for r in summary.statistics(spark.createDataFrame(rows, "g string, v long"), "v", ["g"]).collect()}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        r = got[g]
        if not v:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0.0, 0, 0)
        else:
            assert (r["n"], r["total"], r["least"], r["most"], r["median"], r["n50"]) == (len(v), sum(v), min(v), max(v), int(st.median(v)), n50(v))
            assert r["mean"] == pytest.approx(sum(v) / len(v))
    assert tuple(summary.statistics(spark.createDataFrame([], "v long"), "v").first()) == (0, 0, 0, 0, 0.0, 0, 0)


def test_medians_and_no_gathering(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5])) for g in "xy" for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in summary.medians(df, "v", ["g"], width=1 / 8).collect()}
    assert got == {g: pytest.approx(st.median([v for k, v in rows if k == g])) for g in "xy"}
    scored = df.select(F.lit(None).cast("string").alias("no_call"), F.col("v").alias("p"))
    plan = calls.classify_stats(scored, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    empty = calls.classify_stats(spark.createDataFrame([], "no_call string, p double"), 0.5).first()
    assert empty["n"] == 0 and empty["median_p"] is None and empty["percent_over"] == 0.0
