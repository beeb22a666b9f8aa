"""Text sources: id lists, mapping tables, design tables, reference sequences and k-mer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequences import normalise_uuid


def _fail(problem: F.Column, ok: F.Column, value: F.Column) -> F.Column:
    return F.when(ok, value).otherwise(F.raise_error(problem).cast("string"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids (read_id), one UUID a line; blank lines and lines from # on are skipped, any other line is an error."""
    line = F.trim(F.col("value"))
    lines = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    found = normalise_uuid(F.col("line"))
    return lines.select(_fail(F.concat(F.lit("not a read id: "), F.col("line")), found.isNotNull(), found).alias("read_id")).distinct()


def read_mapping(spark: SparkSession, path: str, values: Sequence[str] = ("output",), keep_empty: bool = False) -> DataFrame:
    """(read_id, value) from a CSV with a header; the first of ``values`` that is a column counts.

    Rows without an id are skipped, of repeated ids the last line wins (file, then offset), and empty values are dropped unless kept.
    """
    table = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip(): c for c in table.columns}
    chosen = next((v for v in values if v in names), None)
    if "read_id" not in names or chosen is None:
        raise ValueError(f"{path} needs the columns read_id and one of {', '.join(values)}")
    rows = table.select(F.trim(F.col(f"`{names['read_id']}`")).alias("id"), F.coalesce(F.trim(F.col(f"`{names[chosen]}`")), F.lit("")).alias(chosen), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"))
    rows = rows.where(F.coalesce(F.col("id"), F.lit("")) != "")
    last = rows.groupBy(normalise_uuid(F.col("id")).alias("read_id")).agg(F.max_by(chosen, "at").alias(chosen)).where("read_id is not null")
    return last if keep_empty else last.where(F.col(chosen) != "")


def read_design(spark: SparkSession, path: str, annotations: Sequence[str], keys: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A design table and its key columns: those named, or the headers that are existing annotations. No key or no value column is an error."""
    table = spark.read.option("header", True).csv(path)
    keys = list(keys) if keys else [c for c in table.columns if c in annotations]
    if not keys or not set(keys) <= set(table.columns) or len(keys) == len(table.columns):
        raise ValueError("a design needs key columns and value columns")
    return table, keys


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record: the first token of its header, its lines joined in upper case."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    return records.select(F.split(F.get(lines, F.lit(0)), r"\s")[0].alias("name"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")).alias("sequence"))


def read_kmer_levels(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, level) of a tab-separated table, lenient: comments, headers, short and non-numeric rows are skipped, k-mers upper-cased, of repeats the last wins."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.upper(F.trim(F.get(cells, F.lit(0)))).alias("kmer"), F.get(cells, F.lit(1)).try_cast("double").alias("level"), F.monotonically_increasing_id().alias("at"))
    return rows.where(F.col("kmer").rlike("^[ACGTU]+$") & F.col("level").isNotNull()).groupBy("kmer").agg(F.max_by("level", "at").alias("level"))
