"""Text and table sinks. Spark's committer publishes a folder only when its job has succeeded."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _located(path: str):
    """The path's file system and the path with its scheme, as Spark resolves them."""
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def exists(path: str) -> bool:
    system, where = _located(path)
    return system.exists(where)


def check_output(path: str, inputs: Sequence[str], force: bool = False) -> None:
    """Refuse an output that is one of the inputs (however written), holds one or lies in one, or that exists without ``force``."""
    own = _located(path)[1].toString().rstrip("/")
    for source in inputs:
        other = _located(source)[1].toString().rstrip("/")
        if f"{own}/".startswith(f"{other}/") or f"{other}/".startswith(f"{own}/"):
            raise ValueError(f"{path} is also an input" if own == other else f"{path} and the input {source} lie in each other")
    if exists(path) and not force:
        raise FileExistsError(path)


def view_lines(table: DataFrame, separator: str = "\t", header: bool = True) -> tuple[str | None, DataFrame]:
    """The header line, if wanted, and one text line (value) per row; null cells are empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
    return (separator.join(table.columns) if header else None), table.select(F.concat_ws(separator, *cells).alias("value"))


def write_view(table: DataFrame, path: str, separator: str = "\t", header: bool = True, force: bool = False) -> None:
    """Delimited text parts; each part starts with the header, as Spark's writer has it. An id listing has none."""
    table.write.mode("overwrite" if force else "errorifexists").csv(path, sep=separator, header=header, emptyValue="", nullValue="")


def write_fingerprints(table: DataFrame, path: str, width: int, force: bool = False) -> None:
    """(read_id, barcode, values): Parquet as an array if ``path`` ends so, else CSV with a column fp_0, fp_1, .. for each value."""
    writer = lambda df: df.write.mode("overwrite" if force else "errorifexists")
    if path.endswith(".parquet"):
        writer(table).parquet(path)
    else:
        writer(table.select("read_id", "barcode", *[F.get("values", F.lit(k)).alias(f"fp_{k}") for k in range(width)])).csv(path, header=True)


def summary_json(summary: DataFrame) -> str:
    """A summary of few rows as indented JSON: one object, or a list of them."""
    rows = [json.loads(r.j) for r in summary.select(F.to_json(F.struct(*summary.columns)).alias("j")).limit(10_000).collect()]
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2)


def write_annotations(table: DataFrame, path: str, force: bool = False) -> None:
    """An annotation table, one folder per source file if it has that column, rows sorted by id within each."""
    by = [c for c in ("source_file",) if c in table.columns]
    spread = table.repartition(*by) if by else table
    writer = spread.sortWithinPartitions(*by, "read_id").write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_per_barcode(reads: DataFrame, path: str, barcode: str = "barcode", classified_only: bool = False, force: bool = False) -> None:
    """Reads in one folder per barcode; null and empty barcodes go to ``unclassified`` or are left out."""
    named = reads.withColumn(barcode, F.coalesce(F.nullif(F.col(barcode), F.lit("")), F.lit("unclassified")))
    named = named.where(F.col(barcode) != "unclassified") if classified_only else named
    named.write.mode("overwrite" if force else "errorifexists").partitionBy(barcode).parquet(path)


def repack(spark, source: str, target: str, rows_per_file: int, force: bool = False) -> bool:
    """Rewrite a table with files of at most ``rows_per_file`` rows; an existing target is skipped (false) without ``force``."""
    if exists(target) and not force:
        return False
    check_output(target, [source], force=True)
    spark.read.parquet(source).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(target)
    return True
