"""Comparison of two classifications or boundary sets of the same reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.summary import running_totals


def agreement(calls: DataFrame, floor: float = 0.5) -> DataFrame:
    """One row over (reference, ours, confidence): n, percent equal, and the same where the reference confidence is at least ``floor``."""
    equal, sure = F.coalesce(F.col("reference") == F.col("ours"), F.lit(False)), F.coalesce(F.col("confidence") >= floor, F.lit(False))
    counts = calls.agg(F.count("*").alias("n"), F.count_if(equal).alias("same"), F.count_if(sure).alias("n_sure"), F.count_if(equal & sure).alias("same_sure"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0)
    return counts.select("n", share("same", "n").alias("percent"), "n_sure", share("same_sure", "n_sure").alias("percent_sure"))


def confusion(calls: DataFrame) -> DataFrame:
    return calls.groupBy("reference", "ours").agg(F.count("*").alias("n"))


def per_class(calls: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where a ratio has no denominator."""
    cells = confusion(calls)
    sides = cells.select(F.col("reference").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("reference") == F.col("ours"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("ours").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit"))
    )
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rated = sums.withColumns({"precision": ratio(F.col("hit"), F.col("called")), "recall": ratio(F.col("hit"), F.col("support"))})
    return rated.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def confidence_correlation(calls: DataFrame) -> DataFrame:
    """Pearson correlation of two confidences; null where one doesn't vary."""
    return calls.agg(F.corr("confidence", "our_confidence").alias("correlation"), F.count("*").alias("n"))


def agreement_by_bin(calls: DataFrame, edges: tuple[float, ...] = (0.0, 0.5, 0.8, 0.95, 1.01)) -> DataFrame:
    """n and percent equal in half-open bins of the reference confidence."""
    which = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        which = F.when((F.col("confidence") >= edges[i]) & (F.col("confidence") < edges[i + 1]), i).otherwise(which)
    binned = calls.withColumn("bin", which).where(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg(F.count("*").alias("n"), (F.avg((F.col("reference") == F.col("ours")).cast("double")) * 100).alias("percent"))


def boundary_differences(pairs: DataFrame) -> DataFrame:
    """Over the column ``difference``: mean, mean absolute, upper median absolute and the absolute value at int(0.95 n).

    The order statistics come from counts per value, not from a list of all rows.
    """
    absolute = F.abs("difference")
    counted = pairs.where(F.col("difference").isNotNull()).groupBy(absolute.alias("a")).agg(F.count("*").alias("c"))
    running = running_totals(counted, "a", "c").select("a", F.col("_upto").alias("upto"), F.col("_total").alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("a")))
    order = running.agg(at(F.floor(F.col("n") / 2)).alias("median_abs"), at(F.floor(F.col("n") * 0.95)).alias("p95_abs"))
    means = pairs.agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.avg(absolute).alias("mean_abs"))
    return means.join(F.broadcast(order))


def ovo_votes(decisions: DataFrame) -> DataFrame:
    """Votes per class from pairwise decisions (id, i, j, decision): above 0 for i, else for j."""
    return decisions.groupBy("id", F.when(F.col("decision") > 0, F.col("i")).otherwise(F.col("j")).alias("label")).agg(F.count("*").alias("votes"))


def array_votes(scores: Column) -> Column:
    """Array of (label, votes) of the classes with a vote, from one array of class scores; labels count from 1.

    The decision of a pair is the difference of its scores: above 0 it votes for the first, else for the second.
    """
    wins = lambda v, p: F.size(F.filter(scores, lambda w, j: ((j > p) & (v > w)) | ((j < p) & (w <= v))))
    each = F.transform(scores, lambda v, p: F.struct((p + 1).cast("long").alias("label"), wins(v, p).cast("long").alias("votes")))
    return F.filter(each, lambda e: e["votes"] > 0)
