"""Summary statistics of read archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Values of a range of this width are one block of ``running_totals``.
BLOCK = 4096


def running_totals(counted: DataFrame, value: str, weight: str | list[str], groups: list[str] | None = None, descending: bool = False, width: float = BLOCK) -> DataFrame:
    """``counted`` (one row per group and value) with ``_upto``, the running sum of ``weight`` in the order of ``value``, and ``_total``.

    Several weights give ``_upto_<weight>`` and ``_total_<weight>`` each. Blocks of values, ``width`` wide,
    are summed first: one window runs over the blocks' totals, another inside each block, so no task
    holds all values of a group. Null groups are a group of their own, null values come first.
    """
    groups, order = groups or [], F.desc_nulls_last if descending else F.asc
    weights = {weight: ""} if isinstance(weight, str) else {w: f"_{w}" for w in weight}
    blocked = counted.withColumn("_block", F.floor(F.col(value) / width))
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*groups, "_block").agg(*[F.sum(w).alias(f"_sum{k}") for w, k in weights.items()])
    blocks = sums.select(
        *[F.col(g).alias(f"_group{i}") for i, g in enumerate(groups)],
        F.col("_block").alias("_other"),
        *[F.coalesce(F.sum(f"_sum{k}").over(before), F.lit(0)).alias(f"_before{k}") for k in weights.values()],
        *[F.sum(f"_sum{k}").over(of_group).alias(f"_total{k}") for k in weights.values()],
    )
    same = F.col("_block").eqNullSafe(F.col("_other"))
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_group{i}"))
    inside = Window.partitionBy(*groups, "_block").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(blocks, same).withColumns({f"_upto{k}": F.col(f"_before{k}") + F.sum(w).over(inside) for w, k in weights.items()})


def at_rank(rank: Column, value: str, upto: str = "_upto") -> Column:
    """Aggregate over running counts: the value of the row with this rank, from 0."""
    return F.min(F.when(F.col(upto) > rank, F.col(value)))


def medians(df: DataFrame, value: str, groups: list[str] | None = None, width: float = BLOCK) -> DataFrame:
    """Per group ``n`` and the exact ``median`` (mean of the middle two) of the values that are not null, by selection over running counts."""
    groups = groups or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    running = running_totals(counted, value, "_n", groups, width=width)
    n = F.col("_total")
    found = running.groupBy(*groups).agg(F.max("_total").alias("n"), at_rank(F.floor((n - 1) / 2), value).alias("_low"), at_rank(F.floor(n / 2), value).alias("_high"))
    return found.select(*groups, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def n50(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """The value at which the running total from the largest down first reaches half of the total (integer division).

    Values are counted first, so distinct values are sorted and not rows.
    """
    groups = groups or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n")).withColumn("_t", F.col(value) * F.col("_n"))
    running = running_totals(counted, value, "_t", groups, descending=True)
    return running.where(F.expr("_upto >= _total div 2")).groupBy(*groups).agg(F.max(value).alias("n50"))


def statistics(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """n, total, least, most, mean, median (integer mean of the middle two) and n50 of integer values; zeros where there are none.

    Rows are counted by value once; all figures follow from the running sums over these counts.
    """
    groups = groups or []
    v, n, total = F.col(value), F.col("_total_n"), F.col("_total_t")
    counted = df.groupBy(*groups, value).agg(F.count(value).alias("n")).withColumn("t", F.coalesce(v * F.col("n"), F.lit(0)))
    running = running_totals(counted, value, ["n", "t"], groups)
    down = total - F.col("_upto_t") + F.col("t")  # the sum from the largest value to this one
    here = lambda rank: F.min(F.when(v.isNotNull() & (F.col("_upto_n") > rank), v))
    found = running.groupBy(*groups).agg(
        F.max(n).alias("n"), F.max(total).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), here(F.floor((n - 1) / 2)).alias("_low"), here(F.floor(n / 2)).alias("_high"),
        F.max(F.when(v.isNotNull() & (down >= F.expr("_total_t div 2")), v)).alias("n50"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select(
        *groups, zero(F.col("n")).alias("n"), zero(F.col("total")).alias("total"), zero(F.col("least")).alias("least"), zero(F.col("most")).alias("most"),
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"), zero(F.floor((F.col("_low") + F.col("_high")) / 2)).alias("median"), zero(F.col("n50")).alias("n50"),
    )


def channels_of_device(most: Column) -> Column:
    """Channels of the device whose largest channel number was seen (fixed sizes of devices)."""
    return F.when(most <= 512, 512).when(most <= 2675, 2675).when(most <= 3000, 3000).otherwise(most)


def channel_activity(reads: DataFrame, channel: str = "channel") -> DataFrame:
    """One row: active channels, the largest number, the device's channels and the active share in percent."""
    seen = reads.agg(F.count_distinct(channel).alias("active"), F.coalesce(F.max(channel), F.lit(0)).cast("long").alias("largest"))
    total = channels_of_device(F.col("largest")).cast("long")
    return seen.withColumn("total", total).withColumn("active_percent", F.when(F.col("total") > 0, F.col("active") * 100.0 / F.col("total")).otherwise(0.0))


def histogram(reads: DataFrame, column: str) -> DataFrame:
    """Count and share in percent of each value."""
    counted = reads.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def top_values(reads: DataFrame, column: str, n: int = 4) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    return reads.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def length_histogram(reads: DataFrame, value: str, width: int) -> DataFrame:
    """Bars for ``width`` buckets over the range of the values: bucket, n (0 for empty ones) and height 0..7."""
    bounds = reads.agg(F.min(value).alias("lo"), F.greatest(F.max(value) - F.min(value), F.lit(1)).alias("range"))
    placed = reads.where(F.col(value).isNotNull()).join(F.broadcast(bounds)).select(F.floor((F.col(value) - F.col("lo")) / F.col("range") * (width - 1) + 0.5).cast("long").alias("bucket"))
    counted = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    every = reads.sparkSession.range(width).select(F.col("id").alias("bucket"))
    filled = every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    most = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    return filled.withColumn("height", F.floor(F.col("n") / most * 7 + 0.5).cast("long"))


def consensus(fingerprints: DataFrame) -> DataFrame:
    """Per barcode and position the median and the population sd around it, over fingerprints of the most frequent length (the shorter of equals).

    fingerprints: (barcode, values).
    """
    sized = fingerprints.select("barcode", F.size("values").alias("size"), "values")
    modal = sized.groupBy("barcode", "size").agg(F.count("*").alias("n")).groupBy("barcode").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))
    cells = sized.join(modal, ["barcode", "size"]).select("barcode", F.posexplode(F.col("values").cast("array<double>")).alias("position", "value"))
    middle = medians(cells, "value", ["barcode", "position"], width=1 / 16).select("barcode", "position", F.col("median").alias("consensus"))
    # The spread is around the median, so moments are not enough: join the medians back.
    return (
        cells.join(middle, ["barcode", "position"])
        .groupBy("barcode", "position")
        .agg(F.first("consensus").alias("consensus"), F.sqrt(F.avg(F.pow(F.col("value") - F.col("consensus"), F.lit(2.0)))).alias("sd"), F.count("*").alias("n"))
    )


def reservoir(df: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per label, chosen by a seeded hash of the key: the sampling operator."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
