"""Robust statistics and normalisation of numeric arrays, as column expressions in double precision.

An empty array has median 0. Each function states its rule for a zero spread, since the kernels that
share a formula differ in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TO_SIGMA = 1.4826


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(0.0)


def population_sd(x: Column) -> Column:
    spread = bound(mean(x), lambda m: F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)))
    return F.when(F.size(x) > 0, spread).otherwise(0.0)


def median(x: Column) -> Column:
    n = F.size(x)
    middle = bound(F.array_sort(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return F.when(n > 0, middle).otherwise(0.0)


def mad(x: Column) -> Column:
    """Median absolute deviation, unscaled."""
    return bound(median(x), lambda c: median(F.transform(x, lambda v: F.abs(v - c))))


def mad_normalise(x: Column) -> Column:
    """(x - median) / MAD; a zero MAD only shifts."""
    return _by(x, median(x), mad(x), 0.0)


def mad_normalise_robust(x: Column) -> Column:
    """(x - median) / (1.4826 MAD); a spread under 1e-10 only shifts."""
    return _by(x, median(x), mad(x) * TO_SIGMA, 1e-10)


def _by(x: Column, centre: Column, scale: Column, least: float) -> Column:
    p = F.struct(centre.alias("c"), scale.alias("s"))
    return F.get(F.transform(F.array(p), lambda q: F.transform(x, lambda v: (v - q["c"]) / F.when(q["s"] > least, q["s"]).otherwise(1.0))), F.lit(0))


def clip_outliers(x: Column, sigmas: float) -> Column:
    """Values beyond median +- sigmas * MAD are moved to that bound; under 2 values or a zero MAD nothing changes."""
    p = F.struct(median(x).alias("c"), mad(x).alias("s"))
    clipped = F.get(F.transform(F.array(p), lambda q: F.when((q["s"] > 0) & (F.size(x) > 1), F.transform(x, lambda v: F.least(F.greatest(v, q["c"] - sigmas * q["s"]), q["c"] + sigmas * q["s"]))).otherwise(x)), F.lit(0))
    return clipped


def z_score(x: Column) -> Column:
    """By mean and population standard deviation; a zero spread leaves the values as they are."""
    p = F.struct(mean(x).alias("c"), population_sd(x).alias("s"))
    return F.get(F.transform(F.array(p), lambda q: F.when(q["s"] > 0, F.transform(x, lambda v: (v - q["c"]) / q["s"])).otherwise(x)), F.lit(0))


def min_max(x: Column) -> Column:
    """To 0..1; a zero range leaves the values as they are."""
    p = F.struct(F.array_min(x).alias("c"), (F.array_max(x) - F.array_min(x)).alias("s"))
    return F.get(F.transform(F.array(p), lambda q: F.when(q["s"] > 0, F.transform(x, lambda v: (v - q["c"]) / q["s"])).otherwise(x)), F.lit(0))


def dwell_log_z(x: Column) -> Column:
    """z-score of ln(max(d, 1)); a spread under 1e-6 gives zeros."""
    logs = F.transform(x, lambda v: F.ln(F.greatest(v, F.lit(1.0))))
    p = F.struct(mean(logs).alias("c"), population_sd(logs).alias("s"))
    return F.get(F.transform(F.array(p), lambda q: F.transform(logs, lambda v: F.when(q["s"] >= 1e-6, (v - q["c"]) / q["s"]).otherwise(0.0))), F.lit(0))


def mean_pool(x: Column, factor: int, tail: str = "keep") -> Column:
    """Means of runs of ``factor`` values. A partial tail is kept as its own mean, dropped, or ("full") divided by the whole factor."""
    factor = max(factor, 1)
    n = F.size(x)
    runs = F.floor(n / factor).cast("int") if tail == "drop" else F.ceil(n / factor).cast("int")
    cut = lambda i: F.slice(x, i * factor + 1, F.lit(factor))
    pooled = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: total(cut(i)) / (F.lit(factor) if tail == "full" else F.size(cut(i))))
    return F.when(runs > 0, pooled).otherwise(F.array().cast("array<double>"))


def calibrate(x: Column, offset: Column, scale: Column) -> Column:
    """Current from ADC values."""
    return F.transform(x, lambda v: (v + offset) * scale)


def softmax(x: Column) -> Column:
    """Shifted by the maximum; an empty array stays empty."""
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    return F.get(F.transform(F.array(total(e)), lambda t: F.transform(e, lambda v: v / t)), F.lit(0))


def top_two_margin(p: Column) -> Column:
    """Largest minus second largest; 1 for one value, 0 for none."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) == 0, 0.0).when(F.size(p) == 1, 1.0).otherwise(F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def gated_call(p: Column, thresholds: list[float] | Column) -> Column:
    """Index of the last largest probability, or -1 if its lead over the next is under its threshold or there is none."""
    at = F.size(p) - F.array_position(F.reverse(p), F.array_max(p))
    limits = thresholds if isinstance(thresholds, Column) else F.array(*map(F.lit, thresholds))
    return F.when((F.size(p) > 0) & (top_two_margin(p) >= F.get(limits, at.cast("int"))), at.cast("long")).otherwise(F.lit(-1).cast("long"))


def interleave(values: Column, dwells: Column, weight: float) -> Column:
    return F.flatten(F.zip_with(values, dwells, lambda a, b: F.array(a, b * weight)))


def rbf(distance: Column, gamma: float, power: float = 2.0) -> Column:
    return F.exp(-gamma * F.pow(distance, F.lit(power)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def span_stats(x: Column, spans: Column) -> Column:
    """For each span (start, end): dwell, mean and population sd; an invalid span gives nulls.

    The mean adds a span from its last sample. Where samples cancel, the order decides on which side of 0
    the rounded sum falls, and the SQL of the classified reads adds in this one.
    """

    def one(s: Column) -> Column:
        n = s["end"] - s["start"]
        part = F.slice(x, s["start"] + 1, n)
        ok = (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.size(x))
        return F.struct(F.when(ok, n.cast("double")).alias("dwell"), F.when(ok, total(F.reverse(part)) / n).alias("mean"), F.when(ok, population_sd(part)).alias("sd"))

    return F.transform(F.transform(spans, lambda s: F.when((s["start"] >= 0) & (s["end"] > s["start"]), s).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))), one)


def scale_probability(p: Column) -> Column:
    """0..255, half away from zero; null for null."""
    return F.when(p.isNotNull(), F.round(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def quantiles(x: Column, qs: list[float]) -> Column:
    """Linear interpolation between sorted values."""
    s, n = F.array_sort(x), F.size(x)

    def one(q: float) -> Column:
        h = F.lit(q) * (n - 1)
        lo = F.floor(h).cast("int")
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, n - 1))
        return a + (b - a) * (h - lo)

    return F.array(*[one(q) for q in qs])
