"""Finding inputs: files, folders, patterns; several archives read as one; text tables of fingerprints, boundaries and barcodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names: the columns of a boundaries table and their other spellings.
BOUNDARY_COLUMNS = {
    "read_id": ("read_id", "id", "uuid"),
    "adapter_start": ("adapter_start", "start", "rna_adapter_start"),
    "adapter_end": ("adapter_end", "end", "rna_adapter_end"),
}


def resolve_inputs(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.parquet", recursive: bool = False) -> list[str]:
    """The input files, sorted, each once: a file as it is, of a folder the files that fit ``pattern``.

    A path that is not there and a folder without such a file are errors. Files are listed by the
    file system of the path, so any store that Spark reads will do.
    """
    from fnmatch import fnmatch

    found: set[str] = set()
    for path in [paths] if isinstance(paths, str) else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            raise FileNotFoundError(path)
        if not system.getFileStatus(where).isDirectory():
            found.add(path)
            continue
        listed, own = system.listFiles(where, recursive), set()
        while listed.hasNext():
            entry = listed.next().getPath()
            if fnmatch(entry.getName(), pattern):
                own.add(entry.toString())
        if not own:
            raise FileNotFoundError(f"{path} has no {pattern}")
        found |= own
    return sorted(found)


def open_dataset(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.parquet", recursive: bool = False) -> DataFrame:
    """The reads of several files as one table; ``source_file`` names each row's file."""
    files = resolve_inputs(spark, paths, pattern, recursive)
    return spark.read.option("mergeSchema", True).parquet(*files).withColumn("source_file", F.input_file_name())


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, adapter_start, adapter_end) from a CSV, plain or gzip, whose columns may have other spellings."""
    table = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    chosen = {name: next((s for s in spellings if s in table.columns), None) for name, spellings in BOUNDARY_COLUMNS.items()}
    missing = [n for n, c in chosen.items() if c is None]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return table.select(F.col(chosen["read_id"]).alias("read_id"), *[F.col(chosen[c]).try_cast("long").alias(c) for c in ("adapter_start", "adapter_end")])


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, barcode, values) from CSV or Parquet, told by the ending; number columns in order are the values.

    ``read_id`` and ``barcode`` may be missing (null then). Rows with a value that is no number are dropped.
    """
    table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    names = [c for c in table.columns if c not in ("read_id", "barcode")]
    text = lambda c: (F.col(c) if c in table.columns else F.lit(None)).cast("string").alias(c)
    if len(names) == 1 and table.schema[names[0]].dataType.typeName() == "array":
        values = F.col(names[0]).cast("array<double>")
    else:
        values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in names])
    return table.select(text("read_id"), text("barcode"), values.alias("values")).where(~F.exists("values", lambda v: v.isNull()))


def read_labelled_fingerprints(spark: SparkSession, path: str, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled fingerprints of one width, and one row (dropped) that counts those of another; the width is the first row's unless given."""
    rows = read_fingerprints(spark, path).where(F.coalesce(F.col("barcode"), F.lit("")) != "")
    if width is None:
        first = rows.select(F.size("values").alias("n")).first()
        width = first.n if first else 0
    return rows.where(F.size("values") == width), rows.agg(F.count_if(F.size("values") != width).alias("dropped"))


def read_barcodes(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """(name, ref_sequence, ord) of a barcode panel in the order of the file; other letters than ACGT and repeated names are errors.

    A panel has at most ``most`` rows, so it is checked on the driver.
    """
    table = spark.read.option("header", True).csv(path)
    if not {"name", "sequence"} <= set(table.columns):
        raise ValueError(f"{path} needs the columns name and sequence")
    rows = table.select(F.trim("name").alias("name"), F.upper(F.trim("sequence")).alias("s")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} barcodes are no panel")
    names = [r.name for r in rows]
    repeated = sorted({n for n in names if names.count(n) > 1})
    wrong = [r.name for r in rows if not r.s or set(r.s) - set("ACGT")]
    if repeated or wrong:
        raise ValueError(f"repeated names: {', '.join(repeated) or 'none'}; not ACGT: {', '.join(map(str, wrong)) or 'none'}")
    return spark.createDataFrame([(r.name, r.s, i) for i, r in enumerate(rows)], "name string, ref_sequence string, ord int")


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, level) of a strict table, plain or gzip: two tab-separated columns, one odd k, every k-mer once, 4**k rows at least; anything else is an error."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value") != "").select(F.size(cells).alias("n"), F.upper(F.get(cells, F.lit(0))).alias("kmer"), F.get(cells, F.lit(1)).try_cast("double").alias("level"))
    seen = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("kmer").alias("kmers"), F.min(F.length("kmer")).alias("k"), F.max(F.length("kmer")).alias("most"),
        F.count_if((F.col("n") != 2) | F.col("level").isNull() | ~F.col("kmer").rlike("^[ACGT]+$")).alias("bad"),
    ).first()
    if not seen["rows"] or seen["bad"] or seen["k"] != seen["most"] or seen["k"] % 2 == 0 or seen["kmers"] != seen["rows"] or seen["rows"] < 4 ** seen["k"]:
        raise ValueError(f"{path} is no complete k-mer table")
    return rows.select("kmer", "level")
