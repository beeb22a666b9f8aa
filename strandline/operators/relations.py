"""Relational operators over reads: selection, merging, routing, annotation and design tables.

All are plans of built-in operators. Lists of ids and mappings may be as large as the reads, so
joins are left to the optimiser, which broadcasts what it measures as small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.sequences import end_reason

FIELDS = ["read_id", "channel", "well", "pore_type", "read_number", "start_sample", "median_before", "end_reason", "end_reason_forced", "num_samples", "num_minknow_events",
          "calibration_offset", "calibration_scale", "run_info", "open_pore_level", "expected_open_pore_level", "selected_read_level"]
DEFAULT_FIELDS = ["read_id", "channel", "well", "read_number", "start_sample", "num_samples", "end_reason"]
#: Decimals of numeric fields in text output.
DECIMALS = {"median_before": 2, "open_pore_level": 2, "expected_open_pore_level": 2, "selected_read_level": 2, "calibration_offset": 4, "calibration_scale": 6}


def resolve_fields(include: Sequence[str] | None = None, exclude: Sequence[str] = (), ids_only: bool = False, known: Sequence[str] = FIELDS) -> list[str]:
    """The columns of a view: ``ids_only`` wins; ``include`` replaces the defaults, ``exclude`` subtracts. Unknown names and an empty result are errors."""
    if ids_only:
        return ["read_id"]
    unknown = [f for f in [*(include or ()), *exclude] if f not in known]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    chosen = [f for f in (DEFAULT_FIELDS if include is None else include) if f not in set(exclude)]
    if not chosen:
        raise ValueError("no fields are left")
    return chosen


def view(reads: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Text columns of the fields, with the decimals of the format."""
    return reads.select(*[(F.format_string(f"%.{DECIMALS[f]}f", F.col(f).cast("double")) if f in DECIMALS else F.col(f).cast("string")).alias(f) for f in fields])


def matches(min_samples: int | None = None, max_samples: int | None = None, end_reasons: Sequence[str] = (), not_end_reasons: Sequence[str] = ()) -> Column:
    """Predicate: all of the given criteria hold. Unknown end-reason texts mean ``unknown``."""
    tests = [F.lit(True)]
    if min_samples is not None:
        tests.append(F.col("num_samples") >= min_samples)
    if max_samples is not None:
        tests.append(F.col("num_samples") <= max_samples)
    reason = end_reason(F.col("end_reason"))
    if end_reasons:
        tests.append(reason.isin(*end_reasons))
    if not_end_reasons:
        tests.append(~reason.isin(*not_end_reasons))
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found


def filter_reads(reads: DataFrame, ids: DataFrame | None = None, **criteria) -> DataFrame:
    """Reads that match all criteria and, if given, whose id is in ``ids``. Without any criterion it is an error."""
    if ids is None and not any(v not in (None, ()) for v in criteria.values()):
        raise ValueError("no filter criteria")
    found = reads.where(matches(**criteria))
    return found if ids is None else found.join(ids.select("read_id").distinct(), "read_id", "left_semi")


def missing_ids(ids: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct ids that no read has."""
    return ids.select("read_id").distinct().join(reads.select("read_id"), "read_id", "left_anti")


def with_labels(reads: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Reads whose annotations match: any label of one name, all names together."""
    test = F.lit(True)
    for name, labels in wanted.items():
        test = test & F.col(name).isin(*labels)
    return reads.where(test)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order, by a map-side combined minimum instead of a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)])
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return least.select(*keys, "_row.*").select(*df.columns)


def merge(inputs: Sequence[DataFrame], keep_duplicates: bool = False, order: Sequence[str] = ("batch_idx", "row_idx")) -> DataFrame:
    """All reads of the inputs; of repeated ids the first in (input, ``order``) stays unless duplicates are kept."""
    numbered = None
    for i, df in enumerate(inputs):
        part = df.withColumn("_input", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    return (numbered if keep_duplicates else first_by(numbered, ["read_id"], ["_input", *order])).drop("_input")


def deduplicate_run_infos(run_infos: DataFrame, order: str = "run_info") -> DataFrame:
    """One row per acquisition, the first, with its new index in first-seen order. Acquisitions are few, so one window numbers them."""
    first = first_by(run_infos, ["acquisition_id"], [order])
    return first.withColumn("new_index", (F.row_number().over(Window.orderBy(order, "acquisition_id")) - 1).cast("int"))


def remap_run_info(reads: DataFrame, run_infos: DataFrame, compatible: bool = False) -> DataFrame:
    """``new_index`` of each read's acquisition; an unknown one gives null, or 0 in compatible mode."""
    index = deduplicate_run_infos(run_infos).select("acquisition_id", "new_index")
    found = reads.join(index, "acquisition_id", "left")
    return found.withColumn("new_index", F.coalesce("new_index", F.lit(0))) if compatible else found


def one_per_id(mapping: DataFrame, value: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """(read_id, value) with one row per id: of repeated ids the last in ``order`` wins, or the largest value where no order is given."""
    return last_wins(mapping, "read_id", value, [*order, value])


def route(reads: DataFrame, mapping: DataFrame, value: str, unclassified: str | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    """Reads with their group. Unmapped reads are dropped, or go to ``unclassified``, as do empty values. Write with ``partitionBy``.

    A read has one group: of repeated ids in the mapping the last in ``order`` wins.
    """
    mapping = one_per_id(mapping, value, order)
    if unclassified is None:
        return reads.join(mapping.where(F.col(value) != ""), "read_id")
    found = reads.join(mapping, "read_id", "left")
    return found.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(unclassified)))


def last_wins(mapping: DataFrame, key: str, value: str, order: Sequence[Column | str]) -> DataFrame:
    """One value per key: that of the last row in ``order``; rows without a key are skipped."""
    return mapping.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def annotate(reads: DataFrame, labels: DataFrame, column: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Reads with one more nullable column; ids that no read has are ignored, empty labels are no labels.

    Reads are not multiplied: of repeated ids in ``labels`` the last in ``order`` wins.
    """
    own = one_per_id(labels, column, order)
    return reads.drop(column).join(own.select("read_id", F.nullif(F.col(column), F.lit("")).alias(column)), "read_id", "left")


def derive_design(reads: DataFrame, design: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value columns of a design table by exact match of all keys; no match, a missing key or an empty cell gives null.

    Two rows of the design with the same keys are an error, raised when the join runs; ``check_design``
    finds them before.
    """
    values = [c for c in design.columns if c not in keys]
    one = design.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(F.nullif(F.col(v), F.lit(""))).alias(v) for v in values])
    checked = one.select(*keys, *[F.when(F.col("_n") == 1, F.col(v)).otherwise(F.raise_error(F.lit("the design has two rows with the same keys")).cast(one.schema[v].dataType)).alias(v) for v in values])
    return reads.drop(*values).join(checked, list(keys), "left")


def check_design(design: DataFrame, keys: Sequence[str]) -> None:
    if design.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("the design has two rows with the same keys")


def best_alignment(alignments: DataFrame, quality: str = "mapq", order: str = "ord") -> DataFrame:
    """One alignment per read: the highest quality, the first of equals."""
    return first_by(alignments, ["read_id"], [-F.coalesce(F.col(quality), F.lit(255)).cast("long"), order])


def include_alignment(min_quality: int = 0, mapped_only: bool = False) -> Column:
    """A missing quality passes only where none is asked for."""
    test = F.coalesce(F.col("mapq") >= min_quality, F.lit(min_quality == 0))
    return test & F.col("mapped") if mapped_only else test


def skip_reason(min_quality: int = 0) -> Column:
    """Why an alignment is not scanned, null if it is; a missing quality counts as 255."""
    return (
        F.when(~F.col("mapped"), "unmapped")
        .when(F.col("reverse"), "reverse")
        .when(F.col("secondary"), "secondary")
        .when(F.col("supplementary"), "supplementary")
        .when(F.coalesce(F.col("mapq"), F.lit(255)) < min_quality, "low_mapq")
    )


def in_region(start: int, end: int) -> Column:
    """Overlap of closed intervals."""
    return (F.col("start") <= end) & (F.col("end") >= start)


def orientation(votes: DataFrame, least: int = 50) -> DataFrame:
    """One row: n, share reversed, and the decision for all reads: forward below 5 %, reversed above 95 %, else mixed; too_few under ``least``."""
    n, share = F.col("n"), F.col("share_reversed")
    counted = votes.where(F.col("reversed").isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("reversed").cast("double")), F.lit(0.0)).alias("share_reversed"))
    return counted.withColumn("decision", F.when(n < least, "too_few").when(share < 0.05, "forward").when(share > 0.95, "reversed").otherwise("mixed"))


def running_offsets(reads: DataFrame, group: str | Sequence[str], order: Sequence[str], size: str, out: str) -> DataFrame:
    """Exclusive running sum of ``size`` in ``order`` within each group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reads.withColumn(out, F.sum(size).over(w) - F.col(size))


def batched_offsets(reads: DataFrame, group: str, batch: str, order: Sequence[str], size: str, out: str) -> DataFrame:
    """``running_offsets`` in the order of ``batch``, then ``order``: prefix sums over the batches' totals, and a window inside each batch, so a large group is not one task."""
    before = Window.partitionBy("_group").orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    totals = reads.groupBy(F.col(group).alias("_group"), F.col(batch).alias("_batch")).agg(F.sum(size).alias("_total"))
    bases = totals.select("_group", "_batch", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = running_offsets(reads.withColumns({"_g": F.col(group), "_b": F.col(batch)}), ["_g", "_b"], order, size, out)
    joined = inside.join(bases, F.col("_g").eqNullSafe(F.col("_group")) & F.col("_b").eqNullSafe(F.col("_batch")))
    return joined.withColumn(out, F.col(out) + F.col("_base")).drop("_g", "_b", "_group", "_batch", "_base")


def chunks_for_prefix(signal: DataFrame, n: int) -> DataFrame:
    """The chunks that the first ``n`` samples of each read need, with how many samples to take of each."""
    before = running_offsets(signal, "read_id", ["chunk_idx"], "samples", "before")
    return before.where(F.col("before") < n).withColumn("take", F.least(F.col("samples"), F.lit(n) - F.col("before")))


def nonuniform_batches(batches: DataFrame, group: str = "source_file") -> DataFrame:
    """For each file the first batch, the last excepted, whose rows differ from the first batch's; files of under three batches have none."""
    w = Window.partitionBy(group)
    sized = batches.select(group, "batch_idx", "rows", F.first("rows").over(w.orderBy("batch_idx")).alias("first_rows"), F.max("batch_idx").over(w).alias("last"), F.count("*").over(w).alias("n"))
    odd = (F.col("rows") != F.col("first_rows")) & (F.col("batch_idx") < F.col("last")) & (F.col("n") >= 3)
    return sized.groupBy(group).agg(F.min(F.when(odd, F.col("batch_idx"))).alias("nonuniform_batch"))
