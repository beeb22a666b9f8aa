"""Functions on identifiers, sequences and barcodes, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.schema import END_REASONS


def normalise_uuid(text: Column) -> Column:
    """Lower-case dashed form of a UUID given with dashes or as 32 hex digits; null if it is none."""
    hexes = F.lower(F.when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.replace(text, F.lit("-"), F.lit(""))).when(text.rlike("^[0-9a-fA-F]{32}$"), text))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(hexes.isNotNull(), F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in cuts]))


def end_reason(text: Column, strict: bool = False) -> Column:
    """A known end reason; other texts become ``unknown``, or raise in strict mode."""
    other = F.raise_error(F.concat(F.lit("unknown end reason: "), text)).cast("string") if strict else F.lit("unknown")
    return F.when(text.isin(*END_REASONS), text).otherwise(other)


def encode_kmer(kmer: Column) -> Column:
    """Two bits per base, first base highest; U counts as T, case is ignored, other letters give null."""
    digits = F.translate(F.upper(kmer), "ACGTU", "01233")
    return F.when(digits.rlike("^[0-3]+$"), F.conv(digits, 4, 10).cast("long"))


def kmer_levels(sequences: DataFrame, table: DataFrame, k: int, centre: int | None = None) -> DataFrame:
    """``levels`` of each (id, sequence): the level of the k-mer around each base, 0 at the edges and for unknown k-mers.

    ``table`` (kmer, level) has at most 4**k rows and is joined, not collected.
    """
    centre = k // 2 if centre is None else centre
    bases = sequences.select("id", F.upper(F.translate("sequence", "uU", "TT")).alias("s")).select("id", "s", F.posexplode(F.sequence(F.lit(1), F.length("s"))).alias("position", "_"))
    start = F.col("position") - centre + 1
    inside = (start >= 1) & (start + k - 1 <= F.length("s"))
    keyed = bases.select("id", "position", F.when(inside, F.substring("s", start, F.lit(k))).alias("kmer"))
    return keyed.join(table, "kmer", "left").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("level", F.lit(0.0)).alias("level")))), lambda x: x["level"]).alias("levels"))


def junction(sequence: Column, motif: str, arm: str) -> Column:
    """struct(motif_start, arm_start, tail): where the motif starts (0-based), where the arm follows, and the poly-A tail's length.

    Null unless the motif occurs exactly once and the arm comes after it.
    """
    at = F.instr(sequence, motif)
    arm_at = F.locate(arm, sequence, 1)
    once = F.regexp_count(sequence, F.lit(motif)) == 1
    tail = F.length(sequence) - F.length(F.rtrim(sequence, F.lit("A")))
    return F.when(once & (arm_at > at), F.struct((at - 1).cast("int").alias("motif_start"), (arm_at - 1).cast("int").alias("arm_start"), tail.cast("int").alias("tail")))


def nearest_barcodes(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Best and second-best reference by edit distance, the first listed of equals, with margin.

    queries: (id, sequence); references: (name, ref_sequence, ord), a panel of barcodes sent whole to
    the executors, so it is checked to be small.
    """
    panel = references.count()
    if panel > 10_000:
        raise ValueError(f"{panel} references are no barcode panel")
    scored = queries.join(F.broadcast(references)).select("id", "name", "ord", F.levenshtein("sequence", "ref_sequence").alias("distance"))
    top = scored.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "ord", "name"))), 1, 2).alias("top"))
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return top.select("id", best["name"].alias("best"), best["distance"].alias("best_distance"), second["distance"].alias("second_distance"), (second["distance"] - best["distance"]).alias("margin"))


def least_pairwise_distance(references: DataFrame) -> DataFrame:
    """The smallest edit distance between two references of a panel."""
    other = references.select(F.col("ord").alias("_o"), F.col("ref_sequence").alias("_s"))
    return references.join(F.broadcast(other), F.col("ord") < F.col("_o")).agg(F.min(F.levenshtein("ref_sequence", "_s")).alias("least_distance"))


def ranked(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def dominant_base(table: DataFrame, k: int) -> DataFrame:
    """One row (position, h): the place in the k-mer whose base orders the levels most (Kruskal and Wallis), the first of equals.

    table: (kmer, level), 4^k rows at most, so one window ranks them; equal levels by k-mer.
    """
    placed = table.select("kmer", F.row_number().over(Window.orderBy("level", "kmer")).alias("r"))
    bases = placed.select("r", F.posexplode(F.split("kmer", "")).alias("position", "base")).where(F.col("position") < k)
    n = F.sum("c").over(Window.partitionBy("position")).cast("double")
    summed = bases.groupBy("position", "base").agg(F.count("*").alias("c"), F.sum("r").cast("double").alias("s"))
    parts = summed.select("position", n.alias("n"), (F.col("s") * F.col("s") / F.col("c")).alias("part"))
    tests = parts.groupBy("position").agg((12.0 / (F.first("n") * (F.first("n") + 1)) * F.sum("part") - 3.0 * (F.first("n") + 1)).alias("h"))
    return tests.agg(F.min_by("position", F.struct(-F.round("h", 9), "position")).alias("position"), F.max("h").alias("h"))
