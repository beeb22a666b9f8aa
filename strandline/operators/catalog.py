"""Lookups over archives: single reads, selections, signal rows, batches, storage order, the id index and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.sequences import normalise_uuid

STORED = ("source_file", "batch_idx", "row_idx")


def find_read(reads: DataFrame, read_id) -> DataFrame:
    """The first row, in storage order, of one read; no row if there is none. The filter reaches the scan."""
    return reads.where(F.col("read_id") == read_id).orderBy(*STORED).limit(1)


def read_batch(reads: DataFrame, source_file: str, batch: int) -> DataFrame:
    """The rows of one batch of a file; a batch that is not there is an error."""
    found = reads.where((F.col("source_file") == source_file) & (F.col("batch_idx") == batch))
    if found.isEmpty():
        raise IndexError(f"{source_file} has no batch {batch}")
    return found


def select_reads(reads: DataFrame, ids: DataFrame, missing_ok: bool = False) -> DataFrame:
    """The reads of a selection; ids that no read has are an error unless ``missing_ok``."""
    wanted = ids.select("read_id").distinct()
    if not missing_ok:
        absent = [r.read_id for r in wanted.join(reads.select("read_id"), "read_id", "left_anti").limit(5).collect()]
        if absent:
            raise KeyError(f"not in the archive: {', '.join(map(str, absent))} ..")
    return reads.join(wanted, "read_id", "left_semi")


def storage_order(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """The selected ids in the order in which they are stored."""
    return select_reads(reads, ids, missing_ok=True).select("read_id", *STORED).orderBy(*STORED)


def signal_rows(reads: DataFrame, signal: DataFrame, ids: DataFrame) -> DataFrame:
    """(read_id, chunks) of the selected reads: their chunk numbers in order, empty for a read without signal."""
    chosen = select_reads(reads, ids, missing_ok=True).select("read_id")
    chunks = signal.join(chosen, "read_id", "left_semi").groupBy("read_id").agg(F.array_sort(F.collect_list("chunk_idx")).alias("chunks"))
    return chosen.join(chunks, "read_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<int>")))


def signal_row_count(signal: DataFrame) -> DataFrame:
    return signal.agg(F.count("*").alias("signal_rows"))


def chunk_batches(signal: DataFrame, rows_per_batch: int, order: Sequence[str] = ("read_id", "chunk_idx")) -> DataFrame:
    """Signal rows with the batch and the row in it where a file of batches of ``rows_per_batch`` holds them, in ``order``.

    Rows are spread by ranges of ``order``, so ids of any kind will do, and stay cached, so that a row keeps its
    partition; a prefix sum over the partitions' totals and a window inside each partition number them.
    """
    ranged = signal.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    # One row per partition: their number bounds this window and the broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_i", inside).join(F.broadcast(bases), "_part").withColumn("_row", F.col("_base") + F.col("_i"))
    return numbered.withColumns({"batch": F.expr(f"_row div {rows_per_batch}"), "row": F.col("_row") % rows_per_batch}).drop("_part", "_base", "_i", "_row")


def dictionary_values(reads: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value): the different values of dictionary columns over all inputs, without null."""
    found = None
    for c in columns:
        part = reads.select(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")).where("value is not null").distinct()
        found = part if found is None else found.unionByName(part)
    return found


def checked_dictionary(reads: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Reads unchanged; a value outside ``allowed`` raises when the rows are computed."""
    bad = F.raise_error(F.concat(F.lit(f"{column} has no value "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return reads.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(bad))


def build_index(reads: DataFrame) -> DataFrame:
    """(read_id, source_file, batch_idx, row_idx): where each read is stored, sorted by id within its files' partitions.

    Write it partitioned by ``source_file``. Canonical lower-case ids sort as their bytes do.
    """
    return reads.select("read_id", *STORED).repartition("source_file").sortWithinPartitions("source_file", "read_id")


def verify_index(index: DataFrame, reads: DataFrame) -> DataFrame:
    """Index rows whose place holds another read or none (read_id, found); an index that fits gives no row."""
    there = reads.select(*STORED, F.col("read_id").alias("found"))
    return index.join(there, list(STORED), "left").where(~F.col("read_id").eqNullSafe(F.col("found"))).select("read_id", "found")


def check_binding(manifest: DataFrame, files: DataFrame) -> None:
    """Error if a file that the manifest binds (source_file, file_id, size) is gone or has another id or size."""
    now = files.select("source_file", F.col("file_id").alias("_id"), F.col("size").alias("_size"))
    stale = manifest.join(now, "source_file", "left").where(~F.col("file_id").eqNullSafe(F.col("_id")) | ~F.col("size").eqNullSafe(F.col("_size")))
    names = [r.source_file for r in stale.select("source_file").limit(5).collect()]
    if names:
        raise ValueError(f"stale for {', '.join(names)}")


def alignment_ids(alignments: DataFrame, column: str = "name") -> DataFrame:
    """Distinct read ids among the names of alignments; names that are no UUID are skipped."""
    return alignments.select(normalise_uuid(F.col(column)).alias("read_id")).where("read_id is not null").distinct()


def filter_by_alignments(reads: DataFrame, alignments: DataFrame, column: str = "name") -> DataFrame:
    """The reads that have an alignment; no usable name at all, or no read in common, is an error."""
    ids = alignment_ids(alignments, column)
    if ids.isEmpty():
        raise ValueError("no alignment is named by a read id")
    found = reads.join(ids, "read_id", "left_semi")
    if found.isEmpty():
        raise ValueError("no read has an alignment")
    return found


def with_signal(alignments: DataFrame, reads: DataFrame, order: Sequence[str] = STORED) -> DataFrame:
    """Alignments whose read has signal, with its number of samples; of repeated reads the last in ``order`` counts."""
    last = reads.groupBy("read_id").agg(F.max_by("num_samples", F.struct(*order)).alias("num_samples"))
    return alignments.join(last, "read_id")
