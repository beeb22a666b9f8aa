"""Segmentation of sampled signals: change points, log-likelihood splits, spans.

Signals stored as rows (id, i, v) use windows over the sample index; signals stored as arrays go to
Arrow-batched kernels (``strandline.operators.kernels``), one signal a row, since the greedy choice of
change points is sequential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays as A


def windowed_ttest(samples: DataFrame, width: int) -> DataFrame:
    """(id, i, score): difference of the means of two neighbouring windows over the root of their summed squares; 0 where these vanish. i runs over whole windows only."""
    w = Window.partitionBy("id").orderBy("i")
    a, b = w.rowsBetween(0, width - 1), w.rowsBetween(width, 2 * width - 1)
    v = F.col("v").cast("double")
    seen = samples.select(
        "id", "i", F.count("v").over(b).alias("n"), F.avg(v).over(a).alias("m1"), F.avg(v).over(b).alias("m2"), F.sum(v * v).over(a).alias("q1"), F.sum(v * v).over(b).alias("q2"),
        F.count("v").over(w.rowsBetween(2 * width, 2 * width)).alias("after"),
    )
    spread = F.col("q1") - width * F.col("m1") * F.col("m1") + F.col("q2") - width * F.col("m2") * F.col("m2")
    return seen.where((F.col("n") == width) & (F.col("after") == 1)).select("id", "i", F.when(spread > 1e-9, F.abs(F.col("m1") - F.col("m2")) / F.sqrt(spread)).otherwise(0.0).alias("score"))


def local_maxima(samples: DataFrame) -> DataFrame:
    """(id, i, v) of strict maxima; a plateau gives its left midpoint; the ends are never maxima. i counts from 0 without gaps."""
    w = Window.partitionBy("id").orderBy("i")
    runs = samples.withColumn("new", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plateaus = runs.groupBy("id", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("v").alias("v"))
    p = Window.partitionBy("id").orderBy("run")
    beside = plateaus.withColumns({"left": F.lag("v").over(p), "right": F.lead("v").over(p)})
    return beside.where((F.col("left") < F.col("v")) & (F.col("right") < F.col("v"))).select("id", F.expr("(a + b) div 2").alias("i"), "v")


def segment_means(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, start, end, mean) of the segments that the cuts (id, i) leave."""
    marked = samples.join(cuts.select("id", "i", F.lit(1).alias("cut")).distinct(), ["id", "i"], "left")
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = marked.withColumn("segment", F.sum(F.coalesce("cut", F.lit(0))).over(w))
    return parts.groupBy("id", "segment").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.avg(F.col("v").cast("double")).alias("mean")).drop("segment")


def best_split(samples: DataFrame, least: int, trim: int) -> DataFrame:
    """(id, i, gain) of the split with the largest log-likelihood gain n ln v - n_h ln v_h - n_t ln v_t, the first of equals; none without a positive gain."""
    v = F.col("v").cast("double")
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    sums = samples.select("id", F.col("i"), F.sum(v).over(w).alias("s"), F.sum(v * v).over(w).alias("q"), F.count("*").over(whole).alias("n"), F.sum(v).over(whole).alias("total"), F.sum(v * v).over(whole).alias("squares"))
    head, rest = F.col("i").cast("double"), (F.col("n") - F.col("i")).cast("double")
    var = lambda q, s, n: q / n - (s / n) * (s / n)
    sums = sums.where((F.col("i") >= least) & (F.col("i") < F.col("n") - trim) & (F.col("i") > 0))
    sums = sums.withColumns({"vf": var(F.col("squares"), F.col("total"), F.col("n")), "vh": var(F.col("q"), F.col("s"), head), "vt": var(F.col("squares") - F.col("q"), F.col("total") - F.col("s"), rest)})
    gain = F.col("n") * F.ln("vf") - head * F.ln("vh") - rest * F.ln("vt")
    gains = sums.where("vf > 1e-12 and vh > 1e-12 and vt > 1e-12").withColumn("gain", F.round(gain, 6)).where("gain > 0")
    return gains.groupBy("id").agg(F.max_by("i", F.struct("gain", -F.col("i"))).alias("i"), F.max("gain").alias("gain"))


def boundaries_from_moves(moves: DataFrame) -> DataFrame:
    """Base boundaries from a move table (id, moves, stride, trim, n): positions of ones times the stride plus the trim, then n."""
    ones = F.filter(F.transform("moves", lambda m, i: F.when(m == 1, i * F.col("stride") + F.col("trim"))), lambda x: x.isNotNull())
    return moves.select("id", F.concat(ones.cast("array<bigint>"), F.array(F.col("n").cast("bigint"))).alias("boundaries"))


def running_band(df: DataFrame) -> DataFrame:
    """(id, i, low, high): a monotone band from rows (id, i, lo, hi): cumulative maximum forward, cumulative minimum backward."""
    w = Window.partitionBy("id").orderBy("i")
    return df.select("id", "i", F.max("lo").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("low"), F.min("hi").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("high"))


def early_stopped_gains(samples: DataFrame, least: int, trim: int, window: int, check: int, stride: int = 1) -> DataFrame:
    """(id, i, gain): the log-likelihood gains of a scan every ``stride`` samples that ends where the trace falls.

    From ``window`` samples on, at every ``check``-th, the scan looks back over the window: if the gains fall on
    average, over the steps that arrive at a positive gain, it ends before that sample. The trace before
    its end does not depend on the end, so it is the first failed check over the whole trace. Splits
    without a positive variance on both sides have gain 0, as has a signal without variance.
    """
    v = F.col("v").cast("double")
    w, whole = Window.partitionBy("id").orderBy("i"), Window.partitionBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = samples.select("id", "i", F.sum(v).over(before).alias("s"), F.sum(v * v).over(before).alias("q"), F.count("*").over(whole).alias("n"), F.sum(v).over(whole).alias("t"), F.sum(v * v).over(whole).alias("tt"))
    head, rest = F.col("i").cast("double"), (F.col("n") - F.col("i")).cast("double")
    var = lambda q, s, n: q / n - (s / n) * (s / n)
    place = F.col("i") - least
    scanned = sums.where((F.col("i") >= least) & (F.col("i") > 0) & (F.col("i") < F.col("n") - trim) & (place % stride == 0))
    scanned = scanned.withColumns({"vf": var(F.col("tt"), F.col("t"), F.col("n")), "vh": var(F.col("q"), F.col("s"), head), "vt": var(F.col("tt") - F.col("q"), F.col("t") - F.col("s"), rest)})
    ok = (F.col("vf") > 1e-12) & (F.col("vh") > 1e-12) & (F.col("vt") > 1e-12)
    gains = scanned.select("id", "i", F.when(ok, F.round(F.col("n") * F.ln("vf") - head * F.ln("vh") - rest * F.ln("vt"), 6)).otherwise(0.0).alias("gain"))
    after = F.lead("gain").over(w)
    steps = gains.withColumn("step", F.when(after > 0, after - F.col("gain")))
    # Steps that start and end inside the window of the samples before this one.
    back = w.rowsBetween(-(-(-window // stride)), -2)
    failed = (place >= window) & (place % check == 0) & (F.avg("step").over(back) < 0)
    ended = steps.withColumn("stop", F.min(F.when(failed, F.col("i"))).over(whole))
    return ended.where("stop is null or i < stop").select("id", "i", "gain")


def change_points(samples: DataFrame, width: int, count: int, separation: int) -> DataFrame:
    """(id, cuts): up to ``count`` best maxima of the t-test scores of each signal, none nearer than ``separation`` to a better one, in order.

    Scores and maxima are set operations; only a signal's maxima meet in its row, where they are taken
    greedily, of equal scores the first. A signal without a maximum has no cuts.
    """
    peaks = local_maxima(windowed_ttest(samples, width).select("id", "i", F.col("score").alias("v")))
    ranked = peaks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), F.col("i").cast("long").alias("i")))).alias("ranked"))
    fits = lambda taken, p: (F.size(taken) < count) & ~F.exists(taken, lambda a: F.abs(a - p["i"]) < separation)
    none = F.array().cast("array<bigint>")
    taken = F.aggregate("ranked", none, lambda taken, p: F.when(fits(taken, p), F.concat(taken, F.array(p["i"]))).otherwise(taken))
    found = ranked.select("id", F.array_sort(F.transform(taken, lambda i: i + width)).alias("cuts"))
    return samples.select("id").distinct().join(found, "id", "left").withColumn("cuts", F.coalesce("cuts", none))


def fingerprints(signals: DataFrame, n_segments: int, width: int, separation: int | None = None, keep: int | None = None) -> DataFrame:
    """(id, values): means of the segments of the MAD-normalised signal (id, x), the last ``keep``; null if there are fewer.

    The scores do not change with the signal's scale, so the cuts are those of the signal as it is.
    """
    samples = signals.select("id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    cuts = change_points(samples, width, n_segments - 1, width if separation is None else separation)
    scaled = signals.select("id", F.col("x").cast("array<double>").alias("x")).join(cuts, "id")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.size("x").cast("long")))
    x, wanted = F.col("x"), keep or n_segments

    def means(m):
        spread = F.when(m["d"] > 0, m["d"]).otherwise(1.0)
        part = lambda e, k: (A.mean(F.slice(x, (e + 1).cast("int"), (F.get("_edges", k + 1) - e).cast("int"))) - m["m"]) / spread
        return F.transform(F.slice("_edges", 1, F.size("_edges") - 1), part)

    made = scaled.withColumn("_edges", edges).withColumn("_all", A.bound(F.struct(A.median(x).alias("m"), A.mad(x).alias("d")), means))
    return made.select("id", F.when(F.size("_all") >= wanted, F.slice("_all", -wanted, wanted)).alias("values"))
