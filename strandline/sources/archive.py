"""The archive as a folder of three Parquet tables: reads, signal chunks and run information.

Signal stays compressed in row-level operations (filter, subset, merge copy the bytes); it is
decoded in Arrow batches where samples are asked for. Writing goes through the output committer, so
nothing is visible before a job has succeeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import kernels
from strandline.schema import CHUNK_SAMPLES, DEFAULTS

TABLES = ("reads", "signal", "run_info")


def open_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables; columns that an older archive lacks are filled with their defaults."""
    found = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    missing = {c: F.lit(v) for c, v in DEFAULTS.items() if c not in found["reads"].columns}
    found["reads"] = found["reads"].withColumns(missing) if missing else found["reads"]
    return found


def split_chunks(reads: DataFrame, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Compressed chunks (read_id, chunk_idx, samples, data) of reads with a ``signal`` array of ADC values."""
    compress = kernels.column(kernels.compress_signal, "binary")
    starts = F.sequence(F.lit(0), F.greatest(F.size("signal") - 1, F.lit(0)), F.lit(chunk_samples))
    parts = reads.select("read_id", "signal", F.posexplode(starts).alias("chunk_idx", "at"))
    cut = parts.select("read_id", "chunk_idx", F.slice("signal", F.col("at") + 1, F.lit(chunk_samples)).alias("part"))
    return cut.select("read_id", "chunk_idx", F.size("part").alias("samples"), compress("part").alias("data"))


def signal_of(signal: DataFrame, reads: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(read_id, signal) of the given reads, or all; with ``first`` only so many samples, and only the chunks they need are decoded."""
    chosen = signal if reads is None else signal.join(reads.select("read_id"), "read_id", "left_semi")
    if first is not None:
        before = F.sum("samples").over(Window.partitionBy("read_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("samples")
        chosen = chosen.withColumn("before", before).where(F.col("before") < first).drop("before")
    decode = kernels.column(lambda data, n: kernels.decompress_signal(data, int(n)).tolist(), "array<smallint>")
    decoded = chosen.select("read_id", F.struct("chunk_idx", decode("data", "samples").alias("part")).alias("c"))
    joined = decoded.groupBy("read_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["part"])).alias("signal"))
    return joined if first is None else joined.withColumn("signal", F.slice("signal", 1, first))


def write_archive(tables: dict[str, DataFrame], path: str, group: str | None = None) -> None:
    """Write the tables; with ``group`` the reads go to one folder per value."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(group) if group and name == "reads" else writer).parquet(f"{path}/{name}")


def byte_counts(signal: DataFrame) -> DataFrame:
    """Compressed bytes and samples of each read."""
    return signal.groupBy("read_id").agg(F.sum(F.octet_length("data")).alias("bytes"), F.sum("samples").alias("samples"))
