"""Scale, shift and drift of a read's signal against expected levels, as column expressions over its arrays.

A sample x at time t is (x - shift - drift * t) / scale; a fit levels = a + b * normalised + c * t turns this into
scale / b, shift - a * scale / b and drift - c * scale / b.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import arrays as A

#: A fitted slope below this, or one that is not finite, changes nothing.
LEAST_SLOPE = 0.01
SINGULAR = 1e-12


def initial_scaling(calibration_scale: Column, calibration_offset: Column, scale: Column, shift: Column) -> Column:
    """struct(scale, shift) for raw samples from those of picoampere values."""
    return F.struct((scale / calibration_scale).alias("scale"), (shift / calibration_scale - calibration_offset).alias("shift"))


def _usable(slope: Column) -> Column:
    return slope.isNotNull() & ~F.isnan(slope) & (F.abs(slope) < float("inf")) & (slope >= LEAST_SLOPE)


def _line(points: Column) -> Column:
    """struct(b, a) of y = a + b * x over points (x, t, y)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])

    def fit(m: Column) -> Column:
        top = A.total(F.transform(points, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"])))
        spread = A.total(F.transform(points, lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"])))
        b = F.when(spread > SINGULAR, top / spread).otherwise(0.0)
        return F.struct(b.alias("b"), (m["y"] - b * m["x"]).alias("a"))

    return A.bound(F.struct(A.mean(x).alias("x"), A.mean(y).alias("y")), fit)


def _plane(points: Column) -> Column:
    """struct(b, a, c) of y = a + b * x + c * t by the normal equations about the means; null if they are singular."""
    each = lambda f: A.total(F.transform(points, f))

    def fit(m: Column) -> Column:
        x, t, y = (lambda p: p["x"] - m["x"]), (lambda p: p["t"] - m["t"]), (lambda p: p["y"] - m["y"])
        sums = F.struct(each(lambda p: x(p) * x(p)).alias("xx"), each(lambda p: t(p) * t(p)).alias("tt"), each(lambda p: x(p) * t(p)).alias("xt"), each(lambda p: x(p) * y(p)).alias("xy"), each(lambda p: t(p) * y(p)).alias("ty"))

        def solve(s: Column) -> Column:
            det = s["xx"] * s["tt"] - s["xt"] * s["xt"]
            b, c = (s["xy"] * s["tt"] - s["ty"] * s["xt"]) / det, (s["ty"] * s["xx"] - s["xy"] * s["xt"]) / det
            return F.when(F.abs(det) > SINGULAR, F.struct(b.alias("b"), (m["y"] - b * m["x"] - c * m["t"]).alias("a"), c.alias("c")))

        return A.bound(sums, solve)

    return A.bound(F.struct(each(lambda p: p["x"]).alias("x"), each(lambda p: p["t"]).alias("t"), each(lambda p: p["y"]).alias("y"), F.size(points).alias("n")), lambda s: A.bound(F.struct((s["x"] / s["n"]).alias("x"), (s["t"] / s["n"]).alias("t"), (s["y"] / s["n"]).alias("y")), fit))


def base_points(x: Column, bounds: Column, levels: Column, now: Column, low: float, high: float, least_distance: float, clip: int) -> Column:
    """(x, t, y) of the bases that a rescale uses: normalised mean, middle sample, expected level.

    Left out are ``clip`` bases at either end, dwells not strictly inside the two quantiles of all dwells, and
    levels within ``least_distance`` of their mean.
    """
    dwells = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda b, i: (F.get(bounds, i + 1) - b).cast("double"))

    def pick(p: Column) -> Column:
        def one(level: Column, i: Column) -> Column:
            a, b = F.get(bounds, i), F.get(bounds, i + 1)
            inside = (i >= clip) & (i < F.size(levels) - clip) & (b - a > p["q"][0]) & (b - a < p["q"][1]) & (F.abs(level - p["m"]) > least_distance)
            t = (a + b) / 2.0
            mean = A.total(F.slice(x, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))) / (b - a)
            return F.when(inside, F.struct(((mean - now["shift"] - now["drift"] * t) / now["scale"]).alias("x"), t.alias("t"), level.cast("double").alias("y")))

        return F.filter(F.transform(levels, one), lambda p: p.isNotNull())

    return A.bound(F.struct(A.quantiles(dwells, [low, high]).alias("q"), A.mean(levels).alias("m")), pick)


def rescale(x: Column, bounds: Column, levels: Column, now: Column, low: float = 0.1, high: float = 0.9, least_distance: float = 0.2, clip: int = 10, least_points: int = 10, drift: bool = True) -> Column:
    """struct(shift, scale, drift) after one least-squares fit of the bases' means to their levels; null where too few bases are left.

    now: struct(shift, scale, drift). A singular fit with drift falls back to one without, and a slope under
    LEAST_SLOPE changes nothing. Arrays that do not fit each other give null.
    """
    points = base_points(x, bounds, levels, now, low, high, least_distance, clip)

    def moved(f: Column, c: Column) -> Column:
        new = F.struct((now["shift"] - f["a"] * now["scale"] / f["b"]).alias("shift"), (now["scale"] / f["b"]).alias("scale"), (now["drift"] - c * now["scale"] / f["b"]).alias("drift"))
        return F.when(_usable(f["b"]), new).otherwise(F.struct(now["shift"].alias("shift"), now["scale"].alias("scale"), now["drift"].alias("drift")))

    def fit(p: Column) -> Column:
        flat = A.bound(_line(p), lambda f: moved(f, F.lit(0.0)))
        best = A.bound(_plane(p), lambda f: F.when(f.isNull(), flat).otherwise(moved(f, f["c"]))) if drift else flat
        return F.when(F.size(p) >= least_points, best)

    return F.when((F.size(bounds) == F.size(levels) + 1) & (F.size(levels) - 2 * clip >= least_points), A.bound(points, fit))


def rough_rescale(x: Column, bounds: Column, levels: Column, now: Column, quantiles: Sequence[float], clip: int = 10, centres: bool = True) -> Column:
    """struct(shift, scale) that bring quantiles of the normalised signal to those of the levels, by a line.

    centres: the signal is one sample, the middle one, of each base, else all samples between the first
    and the last bound. ``clip`` values are left out at both ends where there are more than twice as many levels. Drift is not used.
    """
    middles = F.filter(F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda b, i: F.floor((b + F.get(bounds, i + 1)) / 2)), lambda k: k < F.size(x))
    first, last = F.get(bounds, F.lit(0)), F.least(F.get(bounds, F.size(bounds) - 1), F.size(x))
    signal = F.transform(middles, lambda k: F.get(x, k.cast("int"))) if centres else F.slice(x, (first + 1).cast("int"), (last - first).cast("int"))
    n = F.size(levels) - 2 * clip
    clipped = lambda v: F.when(n > 0, F.slice(v, clip + 1, F.greatest(n, F.lit(0)))).otherwise(v) if clip else v
    normal = F.transform(clipped(signal), lambda v: (v.cast("double") - now["shift"]) / now["scale"])
    pairs = F.arrays_zip(A.quantiles(normal, list(quantiles)).alias("x"), A.quantiles(F.transform(clipped(levels), lambda v: v.cast("double")), list(quantiles)).alias("y"))
    points = F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), F.lit(0.0).alias("t"), p["y"].alias("y")))

    def fit(f: Column) -> Column:
        new = F.struct((now["shift"] - f["a"] * now["scale"] / f["b"]).alias("shift"), (now["scale"] / f["b"]).alias("scale"))
        return F.when(_usable(f["b"]), new).otherwise(F.struct(now["shift"].alias("shift"), now["scale"].alias("scale")))

    return A.bound(points, lambda p: A.bound(_line(p), fit))
