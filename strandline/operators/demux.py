"""Demultiplexing as one plan: boundary, fingerprint, nearest reference, gate and route."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import kernels as K
from strandline.operators.calls import UNCLASSIFIED


def adapter(x: Column, least: int, trim: int, pool: int = 1) -> Column:
    """struct(start, end) of the adapter, in samples; (0, 0) if there is none.

    The signal may be pooled first; ``least`` and ``trim`` are then divided by the factor (1 at least)
    and the bounds scaled back.
    """
    pool = max(pool, 1)
    pooled = x if pool == 1 else _pooled(x, pool)
    parts = K.batched(lambda rows: K.adapter_parts(rows, max(least // pool, 1), max(trim // pool, 1)), K.PARTS)(pooled)
    return F.get(F.transform(F.array(parts), lambda p: adapter_from_parts(p, pool)), F.lit(0))


def _pooled(x: Column, factor: int) -> Column:
    from strandline.functions.arrays import mean_pool

    return mean_pool(x, factor)


def adapter_from_parts(p: Column, pool: int = 1) -> Column:
    """The decision over the three best splits and the four medians.

    A rise across the main split ends the adapter there; it starts at the split before, if the level
    before that is no lower than the mean of all four, else at 0. Without a rise the adapter lies
    behind the main split, if the split there gains more than the one before.
    """
    bounds = lambda a, b: F.struct((a * pool).cast("long").alias("start"), (b * pool).cast("long").alias("end"))
    high = p["before"] >= (p["before"] + p["head"] + p["tail"] + p["after"]) / 4
    rise = F.when(high, bounds(p["first"], p["main"])).otherwise(bounds(F.lit(0), p["main"]))
    none = bounds(F.lit(0), F.lit(0))
    return F.when(p["main"].isNull(), none).when(p["tail"] > p["head"], rise).when(p["last_gain"] > p["first_gain"], bounds(p["main"], p["last"])).otherwise(none)


def demultiplex(
    signals: DataFrame,
    bank: np.ndarray,
    labels: Sequence[str],
    least: int,
    trim: int,
    n_segments: int,
    width: int,
    window: int | None = None,
    penalty: float = 0.0,
    most_ratio: float = 0.8,
    keep_unsure: bool = False,
) -> DataFrame:
    """One row per read: id, adapter_start, adapter_end, barcode, distance, second, ratio, confident.

    signals: (id, x). The fingerprint is cut from the adapter; reads without an adapter or with too
    few segments are ``unclassified``, as are calls whose ratio of best to second distance is over
    ``most_ratio``, unless ``keep_unsure`` (then the barcode stays and only ``confident`` is false).
    The bank of reference fingerprints is a model of bounded size and travels with the tasks.
    """
    found = signals.withColumn("b", adapter(F.col("x"), least, trim))
    cut = found.withColumn("part", F.slice("x", F.col("b.start").cast("int") + 1, (F.col("b.end") - F.col("b.start")).cast("int")))
    printed = cut.withColumn("f", K.column(lambda x: K.fingerprint(x, n_segments, width), "array<double>")("part"))
    called = printed.withColumn("c", K.batched(lambda rows: K.nearest_of(rows, bank, list(labels), window, penalty, most_ratio), K.CALL)("f"))
    sure = F.coalesce(F.col("c.confident"), F.lit(False))
    barcode = F.when(F.col("c.label").isNotNull() & (sure | F.lit(keep_unsure)), F.col("c.label")).otherwise(UNCLASSIFIED)
    return called.select("id", F.col("b.start").alias("adapter_start"), F.col("b.end").alias("adapter_end"), barcode.alias("barcode"), "c.distance", "c.second", "c.ratio", sure.alias("confident"))
