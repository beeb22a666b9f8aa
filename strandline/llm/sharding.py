"""Balanced contiguous shards by global byte-size prefix sums (built-in functions only).

Documents are put in one global order (doc_id, then checksum, then size). A range partitioning of
three narrow columns gives the order; each partition's totals are summed, a prefix sum over these
few totals gives every partition its base, and a window inside the partition adds the rest. The
order is then cut at equal byte targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import documents, materialize, table

N_SHARDS = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. A document belongs to the shard in
    whose byte range it starts, so shards are contiguous in the global order and differ from the
    equal target by less than one document. ``slot`` counts a shard's documents from 0.

    Null ids come first in the order; repeated ids and repeated rows each keep a row and a slot of
    their own (rows alike in all columns are interchangeable). An empty table gives no rows.
    """
    sized = documents(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    # Stored, since a partition's number must be the same in all that follows.
    ranged = materialize(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).drop("tie"))
    order = order[:-1]

    # One row per partition: their number bounds this window and the broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
            F.sum("part_bytes").over(Window.partitionBy()).alias("total_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.select(
            "*",
            (F.sum("size").over(inside) - F.col("size")).alias("bytes_before"),
            (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("rows_before"),
        )
        .join(F.broadcast(bases), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast(least({n_shards - 1}, (base_bytes + bytes_before) * {n_shards} div total_bytes) as int)").alias("shard"),
            (F.col("base_rows") + F.col("rows_before")).alias("row"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
