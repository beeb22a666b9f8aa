"""Preparation of signals and features for classifiers, as column expressions in double precision.

The variants differ in order (normalise, then pool, or the reverse), in the treatment of short
signals and of a zero spread; each function states its rule. A null array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import arrays as A

#: Signals of at most so many samples are not normalised.
SHORT = 10
#: Value that short windows are filled with, and that replaces non-finite values.
PAD = -5.0
#: Samples that must precede a lattice model's window.
LATTICE_MARGIN = 200
#: Window of raw samples, and pooling factor, of the boundary model's input.
WINDOW_START, WINDOW_END, POOL = 1000, 16000, 10


def normalise_signal(x: Column) -> Column:
    """(x - median) / MAD; signals of at most SHORT samples stay as they are, a zero MAD only shifts."""
    return F.when(F.size(x) > SHORT, A.mad_normalise(x)).otherwise(x)


def normalise_then_pool(x: Column, factor: int) -> Column:
    """``normalise_signal``, then means of whole runs of ``factor``; a partial tail is dropped."""
    return A.mean_pool(normalise_signal(x), factor, "drop")


def pool_then_normalise(x: Column, factor: int) -> Column:
    """Means of whole runs of ``factor``, then ``normalise_signal`` of those."""
    return A.bound(A.mean_pool(x, factor, "drop"), normalise_signal)


def mad_normalise_clipped(x: Column, sigmas: float) -> Column:
    """Clipped to median +- sigmas * MAD, then (x - median) / MAD by the unclipped median and MAD; a zero MAD only shifts."""
    p = F.struct(A.median(x).alias("c"), A.mad(x).alias("s"))

    def scaled(q: Column) -> Column:
        near = F.transform(x, lambda v: F.least(F.greatest(v, q["c"] - sigmas * q["s"]), q["c"] + sigmas * q["s"]))
        return F.when(q["s"] > 0, F.transform(near, lambda v: (v - q["c"]) / q["s"])).otherwise(F.transform(x, lambda v: v - q["c"]))

    return A.bound(p, scaled)


def dwell_log_mad(x: Column) -> Column:
    """ln(max(d, 1)) less its median, by its MAD; a MAD under 1e-6 gives zeros."""
    logs = F.transform(x, lambda v: F.ln(F.greatest(v, F.lit(1.0))))
    p = F.struct(A.median(logs).alias("c"), A.mad(logs).alias("s"))
    return A.bound(p, lambda q: F.transform(logs, lambda v: F.when(q["s"] >= 1e-6, (v - q["c"]) / q["s"]).otherwise(0.0)))


def normalise_fingerprint(x: Column, how: str) -> Column:
    """``z_score``, ``min_max``, ``median_mad``, ``mean`` (shift by the mean) or ``none``; a zero scale leaves the values as they are."""
    if how == "median_mad":
        p = F.struct(A.median(x).alias("c"), A.mad(x).alias("s"))
        return A.bound(p, lambda q: F.when(q["s"] > 0, F.transform(x, lambda v: (v - q["c"]) / q["s"])).otherwise(x))
    if how == "mean":
        return A.bound(A.mean(x), lambda m: F.transform(x, lambda v: v - m))
    rules = {"z_score": A.z_score, "min_max": A.min_max, "none": lambda v: v}
    if how not in rules:
        raise ValueError(f"unknown normalisation: {how}")
    return rules[how](x)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def normalise_model_input(x: Column, pad: float = PAD) -> Column:
    """(x - median) / MAD with scale 1 for a zero MAD; what is not finite then becomes ``pad``."""
    p = F.struct(A.median(x).alias("c"), A.mad(x).alias("s"))
    value = lambda q, v: (v - q["c"]) / F.when(q["s"] > 0, q["s"]).otherwise(1.0)
    return A.bound(p, lambda q: F.transform(F.transform(x, lambda v: value(q, v)), lambda v: F.when(is_finite(v), v).otherwise(pad)))


def boundary_model_input(x: Column, start: int = WINDOW_START, end: int = WINDOW_END, factor: int = POOL, pad: float = PAD) -> Column:
    """Samples start..end pooled (the tail divided by the whole factor), normalised and padded to (end - start) / factor values.

    Null for a signal of at most ``start`` samples.
    """
    width = (end - start) // factor
    part = F.slice(x, start + 1, F.lit(end - start))
    filled = lambda y: F.concat(F.slice(y, 1, width), F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(y), F.lit(0))))
    return F.when(F.size(x) > start, A.bound(normalise_model_input(A.mean_pool(part, factor, "full"), pad), filled))


def adapter_end(scores: Column, start: int = WINDOW_START, factor: int = POOL) -> Column:
    """Raw sample where the first largest score stands; null for none, or where that is the first value."""
    at = F.array_position(scores, F.array_max(scores)) - 1
    return F.when(at > 0, at * factor + start)


def calibrate_standardise(adc: Column, offset: Column, scale: Column, centre: float, spread: float) -> Column:
    """((adc + offset) * scale - centre) / spread in one pass."""
    return F.transform(adc, lambda v: (v * scale + offset * scale - centre) / spread)


def lattice_window_start(n: Column, end: Column, width: int, margin: int = LATTICE_MARGIN, most_shift: int = 0) -> Column:
    """First of the ``width`` samples that a lattice model reads before ``end``, in a signal of ``n`` samples; null where it must not be read.

    An end needs ``margin`` samples more than the width before it. An end before the width is, where
    ``most_shift`` allows it, read from sample 0 on, which lets at most so many samples behind the end
    in. No end (null or 0), one past the signal, and a signal shorter than the width give null.
    """
    whole = F.when(end >= width + margin, end - width)
    clamped = F.when((end > 0) & (end < width) & (n >= width) & (F.lit(width) - end <= most_shift), F.lit(0))
    return F.when(end <= n, F.coalesce(whole, clamped))


def lattice_input(adc: Column, end: Column, offset: Column, scale: Column, centre: float, spread: float, width: int, margin: int = LATTICE_MARGIN, most_shift: int = 0) -> Column:
    """The window before ``end``, calibrated and standardised; only its samples are calibrated. Null without a window or signal."""
    start = lattice_window_start(F.size(adc), end, width, margin, most_shift)
    return F.when(start.isNotNull(), calibrate_standardise(F.slice(adc, F.coalesce(start, F.lit(0)).cast("int") + 1, F.lit(width)), offset, scale, centre, spread))


def feature_vector(values: Column, dwells: Column, weight: float) -> Column:
    """All values, then all dwells times ``weight``."""
    return F.concat(values, F.transform(dwells, lambda d: d * weight))


def select_cells(grid: Column, cells: list[int]) -> Column:
    """The cells of a flat grid, in the order asked for; a cell that is not there gives null."""
    return F.array(*[F.get(grid, F.lit(c)) for c in cells])


def reverse_map(boundaries: Column, length: Column) -> Column:
    """Boundaries of the reversed signal."""
    return F.reverse(F.transform(boundaries, lambda b: length - b))


def fix_gauge(levels: Column) -> Column:
    """(x - median) / (1.4826 MAD); a zero MAD is an error."""
    return F.when(A.mad(levels) > 0, A.mad_normalise_robust(levels)).otherwise(F.raise_error(F.lit("levels without a spread")).cast("array<double>"))


def expected_levels_z(levels: Column, positions: Column, least: int = 20) -> Column:
    """z-scores of the levels at the positions (0-based), by the read's finite non-zero levels.

    Null at a position that is out of range or has no such level, and everywhere if there are fewer
    than ``least`` of them or they have no spread.
    """
    usable = lambda v: is_finite(v) & (v != 0.0)
    valid = F.filter(levels, usable)
    p = F.struct(A.mean(valid).alias("c"), A.population_sd(valid).alias("s"), F.size(valid).alias("n"))

    def at(q: Column, i: Column) -> Column:
        v = F.when(i >= 0, F.get(levels, i.cast("int")))
        return F.when((q["n"] >= least) & (q["s"] > 0) & usable(v), (v - q["c"]) / q["s"])

    return A.bound(p, lambda q: F.transform(positions, lambda i: at(q, i)))


def junction_features(x: Column, spans: Column, expected: Column) -> Column:
    """For each span four values in a row: dwell, mean, sd and mean - expected, of the signal less its median by 1.4826 MAD.

    With a MAD up to 1e-3 the scale is 1. An invalid span gives nulls, as does a missing expectation for the last value.
    """
    p = F.struct(A.median(x).alias("c"), A.mad(x).alias("s"))
    gauged = A.bound(p, lambda q: F.transform(x, lambda v: (v - q["c"]) / F.when(q["s"] > 1e-3, q["s"] * A.TO_SIGMA).otherwise(1.0)))
    stats = A.bound(gauged, lambda g: A.span_stats(g, spans))
    none = F.lit(None).cast("double")
    return F.flatten(F.zip_with(stats, expected, lambda s, e: F.array(F.coalesce(s["dwell"], none), s["mean"], s["sd"], s["mean"] - e)))


def stay_cost(past: Column, target: float, weight: float) -> Column:
    """Cost of a base by the samples past its first: quadratic in what lacks to the target, logarithmic from there on."""
    return weight * F.when(past < target, F.pow(target - past, F.lit(2.0))).otherwise(F.log1p(past / target))


def dwell_penalty(dwell: Column, target: float, weight: float, limit: float) -> Column:
    """Quadratic below the target, logarithmic above, at most ``limit``."""
    below = weight * F.pow((dwell - target) / target, F.lit(2.0))
    return F.least(F.when(dwell < target, below).otherwise(weight * F.ln(dwell / target)), F.lit(limit))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def platt(decision: Column, a: Column | float, b: Column | float) -> Column:
    """Probability of the first class of a pair from its decision value."""
    return 1.0 / (1.0 + F.exp(decision * a + b))


def vote_probabilities(decisions: Column, n_classes: int) -> Column:
    """Class probabilities from the pairwise decision values in the order (0, 1), (0, 2), ..: sums of sigmoids, normalised.

    Used where no pairwise scaling was fitted.
    """
    pairs = [(i, j) for i in range(n_classes) for j in range(i + 1, n_classes)]
    p = lambda k: sigmoid(F.get(decisions, F.lit(k)))
    score = lambda c: sum((p(k) if i == c else 1.0 - p(k) for k, (i, j) in enumerate(pairs) if c in (i, j)), F.lit(0.0))
    return A.bound(F.array(*[score(c) for c in range(n_classes)]), lambda s: F.transform(s, lambda v: v / A.total(s)))


def trees(x: Column, forest: list[dict], baseline: list[float]) -> Column:
    """Probabilities of a boosted ensemble as nested conditions: sums of leaves by class, then softmax, or a sigmoid for one output.

    A tree has arrays feature (-1 at leaves), threshold, left, right, value and missing_left, and a class.
    """

    def node(t: dict, at: int) -> Column:
        if t["feature"][at] < 0:
            return F.lit(float(t["value"][at]))
        v = F.get(x, F.lit(t["feature"][at]))
        missing = v.isNull() | F.isnan(v)
        left = F.when(missing, F.lit(bool(t["missing_left"][at]))).otherwise(v <= t["threshold"][at])
        return F.when(left, node(t, t["left"][at])).otherwise(node(t, t["right"][at]))

    raw = [sum((node(t, 0) for t in forest if t["class"] == c), F.lit(float(b))) for c, b in enumerate(baseline)]
    return F.array(1.0 - sigmoid(raw[0]), sigmoid(raw[0])) if len(raw) == 1 else A.bound(F.array(*raw), A.softmax)


def check_trees(forest: list[dict], n_features: int, n_classes: int) -> None:
    """Refuse trees whose arrays differ in length, or that point to features, nodes or classes that are not there or backwards."""
    for k, t in enumerate(forest):
        n = len(t["feature"])
        if not n or any(len(t[c]) != n for c in ("threshold", "left", "right", "value", "missing_left")):
            raise ValueError(f"tree {k}: arrays of different lengths")
        if not 0 <= t["class"] < n_classes:
            raise ValueError(f"tree {k}: no class {t['class']}")
        for i, f in enumerate(t["feature"]):
            if f >= n_features:
                raise ValueError(f"tree {k}: no feature {f}")
            if f >= 0 and not (i < t["left"][i] < n and i < t["right"][i] < n):
                raise ValueError(f"tree {k}: node {i} points backwards or out of the tree")


def probability_columns(p: Column, names: list[int]) -> list[Column]:
    """One column for each class, named p00, p01, .. by its number."""
    return [F.get(p, F.lit(k)).alias(f"p{n:02d}") for k, n in enumerate(names)]


def kernel_width(distances: Column) -> Column:
    """1 / (2 median^2) of the positive finite distances; 1 if there are none."""
    usable = F.filter(distances, lambda d: is_finite(d) & (d > 0))
    return F.when(F.size(usable) > 0, A.bound(A.median(usable), lambda m: 1.0 / (2.0 * m * m))).otherwise(1.0)


# --- text of numbers and dates ---


def bytes_text(n: Column) -> Column:
    """Binary units with one decimal, halves to even; plain bytes below 1024."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    k = F.least(F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(0)), F.lit(4)).cast("int")
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(F.format_string("%.1f %s", F.bround(n / F.pow(F.lit(1024.0), k), 1), F.get(units, k)))


def thousands_text(n: Column) -> Column:
    return F.format_number(n, 0)


def start_text(ms: Column) -> Column:
    """Milliseconds since the epoch as a UTC minute."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm 'UTC'")


def hours_text(samples: Column, rate: Column) -> Column:
    return F.when(rate == 0, "N/A").otherwise(F.format_string("%.1f hrs", samples / rate / 3600.0))


def compact_text(n: Column) -> Column:
    """1.2M, 500K, or the number itself below 1000."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1))).when(n >= 1000, F.format_string("%.0fK", F.bround(n / 1e3, 0))).otherwise(n.cast("string"))


# --- windows and slopes ---


def signal_window(x: Column, anchor: int, left: int, right: int, mask_before: int = 0) -> Column:
    """Samples [anchor - left, anchor + right), with NaN past the ends and before ``mask_before``; null if no sample is left."""
    places = F.sequence(F.lit(anchor - left), F.lit(anchor + right - 1))
    there = lambda k: (k >= max(mask_before, 0)) & (k < F.size(x))
    made = F.transform(places, lambda k: F.when(there(k), F.get(x, k).cast("double")).otherwise(F.lit(float("nan"))))
    return F.when((F.size(x) > max(anchor - left, mask_before, 0)) & (anchor + right > max(mask_before, 0)), made)


def median_slope(y: Column) -> Column:
    """Median of the slopes of all pairs of a series with steps of 1 (Theil and Sen); 1 for fewer than two values."""
    later = lambda a, i: F.transform(F.slice(y, i + 2, F.greatest(F.size(y) - i - 1, F.lit(0))), lambda b, k: (b - a).cast("double") / (k + 1))
    return F.when(F.size(y) > 1, A.median(F.flatten(F.transform(y, later)))).otherwise(1.0)
