"""Searches as equi-joins: alignments of many regions, and sequences within an edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of level 0 are 2^14 bases wide, each further level's are 2^3 times as wide.
BIN_SHIFT, LEVEL_SHIFT, LEVELS = 14, 3, 6


def _bin(position: Column, level: int, shift: int) -> Column:
    return F.shiftright(position.cast("long"), min(shift + LEVEL_SHIFT * level, 62))


def placed_alignments(alignments: DataFrame, shift: int = BIN_SHIFT, levels: int = LEVELS) -> DataFrame:
    """``alignments`` with _level and _bin: one row each, but those longer than all levels' bins one for each bin of the further level."""
    start, end = F.col("start").cast("long"), F.col("end_pos").cast("long")
    level = F.lit(levels)
    for k in reversed(range(levels)):
        level = F.when(_bin(end - start, k, shift) == 0, k).otherwise(level)
    placed = alignments.where("end_pos >= start").withColumn("_level", level.cast("int"))
    own = F.sequence(_bin(start, levels, shift), _bin(end, levels, shift))
    for k in range(levels):
        own = F.when(F.col("_level") == k, F.array(_bin(start, k, shift))).otherwise(own)
    return placed.withColumn("_bin", F.explode(own))


def region_hits(alignments: DataFrame, regions: DataFrame, shift: int = BIN_SHIFT, levels: int = LEVELS) -> DataFrame:
    """Every pair of an alignment and a region that overlap: the columns of ``alignments`` with region_id.

    alignments: contig, start, end_pos and others; regions: region_id, contig, from_pos, to_pos; both
    intervals closed. The level of an alignment is the first whose bins are as wide as it is long, its bin
    that of its start; a region asks on every level for the bins that it touches and the one before, so a
    pair meets once, by an equi-join on (contig, level, bin), and no place gathers alignments of elsewhere.
    Those longer than all levels' bins are on a further level, in each bin that they touch, and count in
    the first bin of both. Intervals that end before they start, and null positions or contigs, meet nothing.
    The regions' bins are many times their rows, so they are never broadcast.
    """
    start, end = F.col("start").cast("long"), F.col("end_pos").cast("long")
    placed = placed_alignments(alignments, shift, levels)
    lowest = lambda k: _bin(F.col("from_pos"), k, shift) - (1 if k < levels else 0)
    touched = [F.sequence(lowest(k), _bin(F.col("to_pos"), k, shift)) for k in range(levels + 1)]
    asked = regions.where("to_pos >= from_pos").select("region_id", F.col("contig").alias("_contig"), "from_pos", "to_pos", F.explode(F.concat(*[F.transform(t, _tag(k)) for k, t in enumerate(touched)])).alias("_b"))
    asked = asked.select("region_id", "_contig", "from_pos", "to_pos", F.col("_b.level").alias("_region_level"), F.col("_b.bin").alias("_region_bin"))
    met = placed.join(asked.hint("merge"), (F.col("contig") == F.col("_contig")) & (F.col("_level") == F.col("_region_level")) & (F.col("_bin") == F.col("_region_bin")))
    first = (F.col("_level") < levels) | (F.col("_bin") == _bin(F.greatest(start, F.col("from_pos").cast("long")), levels, shift))
    return met.where((start <= F.col("to_pos")) & (end >= F.col("from_pos")) & first).select(*alignments.columns, "region_id")


def _tag(level: int):
    return lambda b: F.struct(F.lit(level).alias("level"), b.cast("long").alias("bin"))


def within_distance(queries: DataFrame, references: DataFrame, limit: int) -> DataFrame:
    """(id, name, distance) of all pairs of (id, sequence) and (name, ref_sequence) within ``limit`` edits.

    A reference is cut into limit + 1 pieces: ``limit`` edits leave one of them whole, at most ``limit``
    places from its own. Queries are cut at these places, so only pairs that share a piece are compared,
    by the banded distance that gives up past the limit; queries x references is never formed. Each
    different sequence is cut and compared once, however many ids have it. References
    of ``limit`` characters and fewer have empty pieces and are compared with the queries short enough.
    Null sequences and names or ids match nothing.
    """
    pieces = limit + 1
    panel = references.where("name is not null and ref_sequence is not null").select("name", "ref_sequence").distinct()
    texts = queries.where("id is not null and sequence is not null").select("id", "sequence")
    asked = panel.select("ref_sequence").distinct().withColumn("_n", F.length("ref_sequence"))
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda i: F.expr("_n").cast("long") * i)
    cuts = asked.withColumn("_at", F.transform(at, lambda x: F.floor(x / pieces).cast("int")))
    seeds = cuts.select("ref_sequence", F.explode(F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.struct(F.get("_at", i).alias("at"), (F.get("_at", i + 1) - F.get("_at", i)).alias("size")))).alias("_p"))
    seeds = seeds.select("ref_sequence", F.col("_p.at").alias("at"), F.col("_p.size").alias("size"), F.substring("ref_sequence", F.col("_p.at") + 1, F.col("_p.size")).alias("_piece"))
    # The few places and sizes at which references of the panel are cut, as one row; a panel has few lengths.
    shapes = seeds.select("at", "size").distinct().agg(F.collect_set(F.struct("at", "size")).alias("_shapes"))
    own = texts.select("sequence").distinct().join(F.broadcast(shapes))
    places = F.flatten(F.transform("_shapes", lambda s: F.transform(F.sequence(F.greatest(s["at"] - limit, F.lit(0)), F.greatest(F.least(s["at"] + limit, F.length("sequence") - s["size"]), F.greatest(s["at"] - limit, F.lit(0)))), lambda p: F.struct(s["at"].alias("at"), s["size"].alias("size"), F.substring("sequence", p + 1, s["size"]).alias("_piece")))))
    cut = own.select("sequence", F.explode(F.array_distinct(F.filter(places, lambda x: F.length(x["_piece"]) == x["size"]))).alias("_q"))
    # A panel and its pieces, several times its rows, grow with the input: no broadcast.
    met = cut.select("sequence", F.col("_q.at").alias("at"), F.col("_q.size").alias("size"), F.col("_q._piece").alias("_piece")).join(seeds.hint("merge"), ["at", "size", "_piece"])
    near = met.where(F.abs(F.length("sequence") - F.length("ref_sequence")) <= limit).select("sequence", "ref_sequence").distinct()
    near = near.withColumn("distance", F.levenshtein("sequence", "ref_sequence", limit)).where("distance >= 0")
    return texts.distinct().join(near.join(panel.hint("merge"), "ref_sequence"), "sequence").select("id", "name", "distance")
