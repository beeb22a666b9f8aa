"""Barcode calls and classifications of reads: gates, no-call reasons, joins with signals, statistics and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.summary import at_rank, running_totals

UNCLASSIFIED = "unclassified"


def passes_gates(margin: Column, least_margin: float, log_p: Column | None = None, lattice_margin: Column | None = None, least_lattice_margin: float | None = None, least_probability: float | None = None) -> Column:
    """All gates that are set: a missing margin (no runner-up) passes, as does a missing lattice score."""
    ok = F.coalesce(margin >= least_margin, F.lit(True))
    if least_lattice_margin is not None and lattice_margin is not None:
        ok = ok & F.coalesce(lattice_margin >= least_lattice_margin, F.lit(True))
    if least_probability is not None and log_p is not None:
        ok = ok & F.coalesce(F.exp(log_p) >= least_probability, F.lit(True))
    return ok


def call_barcode(matches: DataFrame, least_margin: float) -> DataFrame:
    """(id, barcode, confidence) of the reads whose best match leads by ``least_margin``; the others have no row.

    matches: (id, best, margin). Confidence is the margin, 0 for a lone reference.
    """
    return matches.where(F.col("best").isNotNull() & passes_gates(F.col("margin"), least_margin)).select("id", F.col("best").alias("barcode"), F.coalesce(F.col("margin"), F.lit(0)).cast("double").alias("confidence"))


def call_barcode_scored(matches: DataFrame, least_margin: float, least_lattice_margin: float | None = None, least_probability: float | None = None) -> DataFrame:
    """One row per read: the match, or ``unclassified`` where a gate rejects it; confidence and scores stay as they are.

    matches: (id, best, margin, log_p, lattice_margin). Lattice gates only ever reject.
    """
    ok = F.col("best").isNotNull() & passes_gates(F.col("margin"), least_margin, F.col("log_p"), F.col("lattice_margin"), least_lattice_margin, least_probability)
    return matches.select("id", F.when(ok, F.col("best")).otherwise(UNCLASSIFIED).alias("barcode"), F.coalesce(F.col("margin"), F.lit(0)).cast("double").alias("confidence"), "log_p", "lattice_margin")


def valid_boundaries(boundaries: DataFrame) -> DataFrame:
    """Boundaries whose adapter ends after it starts."""
    return boundaries.where("adapter_end > adapter_start")


def joined_boundaries(reads: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Reads that have a valid boundary, with it."""
    return reads.join(valid_boundaries(boundaries).select("read_id", "adapter_start", "adapter_end"), "read_id")


def anchored_signals(anchored: DataFrame, reads: DataFrame) -> DataFrame:
    """Anchored alignments with ``no_call``: ``no_signal`` without a read, ``ns_mismatch`` for another number of samples, ``abstain`` without aligner depth; else null.

    anchored: (read_id, ns, depth, ..); reads: (read_id, num_samples), each id once.
    """
    n = F.col("num_samples")
    reason = F.when(n.isNull(), "no_signal").when(n != F.col("ns"), "ns_mismatch").when(F.col("depth") == 0, "abstain")
    return anchored.join(reads.select("read_id", "num_samples"), "read_id", "left").withColumn("no_call", reason)


def classify_stats(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: how many reads, how many of each no-call reason, the upper median of P and the percentage at or over the operating point.

    scored: (no_call, p), p null where there is no call.
    """
    n = F.count("p")
    count = lambda reason: F.count_if(F.col("no_call") == reason)
    counts = scored.agg(
        F.count("*").alias("n"),
        n.alias("scored"),
        *[count(r).alias(r) for r in ("no_signal", "ns_mismatch", "abstain")],
        F.when(n > 0, F.count_if(F.col("p") >= threshold) * 100.0 / n).otherwise(0.0).alias("percent_over"),
    )
    running = running_totals(scored.where("p is not null").groupBy("p").agg(F.count("*").alias("c")), "p", "c", width=1 / 4096)
    return counts.join(F.broadcast(running.agg(at_rank(F.floor(F.col("_total") / 2), "p").alias("median_p"))), F.lit(True), "left")


def match_percentage(matched: Column, total: Column) -> Column:
    return F.when(total > 0, matched * 100.0 / total).otherwise(0.0)


def tagged(alignments: DataFrame, calls: DataFrame, tag: str = "cl") -> DataFrame:
    """Every alignment, with its read's call on the 0..255 scale, null where there is none."""
    return alignments.join(calls.select("read_id", F.round(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias(tag)), "read_id", "left")


def comparison(reference: DataFrame, ours: DataFrame, disagreements_only: bool = False) -> DataFrame:
    """(read_id, reference, ours, agree) of the reads in both, or only of those that differ."""
    both = reference.select("read_id", F.col("barcode").alias("reference")).join(ours.select("read_id", F.col("barcode").alias("ours")), "read_id")
    found = both.withColumn("agree", F.col("reference").eqNullSafe(F.col("ours")))
    return found.where(~F.col("agree")) if disagreements_only else found


def group_outcomes(calls: DataFrame) -> DataFrame:
    """Reads of each barcode, by name."""
    return calls.groupBy("barcode").agg(F.count("*").alias("n")).orderBy("barcode")


# --- tables of classifications, as text ---


def distance_table(calls: DataFrame) -> DataFrame:
    """read_id, barcode, distance, second_best_distance, ratio, confident, with four decimals."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double")).alias(c)
    return calls.select("read_id", "barcode", four("distance"), four("second_best_distance"), four("ratio"), F.col("confident").cast("string").alias("confident"))


def class_table(calls: DataFrame, classes: list[int], probabilities: bool = False) -> DataFrame:
    """read_id, barcode (BC and two digits, or unclassified for -1), confidence, and one column per class if asked."""
    name = F.when(F.col("call") >= 0, F.format_string("BC%02d", F.col("call"))).otherwise(UNCLASSIFIED).alias("barcode")
    wanted = [F.format_string("%.4f", F.get("p", F.lit(k))).alias(f"p{c:02d}") for k, c in enumerate(classes)] if probabilities else []
    return calls.select("read_id", name, F.format_string("%.4f", F.array_max("p")).alias("confidence"), *wanted)


def fused_table(calls: DataFrame, scored: bool = False) -> DataFrame:
    """read_id, barcode, confidence; with ``scored`` also the lattice's columns, empty where it gave none."""
    text = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("")).alias(c)
    more = [F.when(F.col(c).isNotNull(), text(c)).otherwise("").alias(c) for c in ("crf_logp", "crf_margin", "mean_logpost")] + [F.coalesce("crf_best", F.lit("")).alias("crf_best")]
    return calls.select("read_id", "barcode", F.format_string("%.4f", "confidence").alias("confidence"), *(more if scored else []))


# --- alignment coordinates ---


def aligned_bases(alignments: DataFrame) -> DataFrame:
    """(read_id, ref_pos, query_pos), 0-based, of every aligned base.

    alignments: read_id, start (0-based) and ops, an array of (op, len) in order. M, = and X align, I
    and S consume the query, D and N the reference, H and P nothing.
    """
    consumes = lambda letters: F.transform("ops", lambda o: F.when(o["op"].isin(*letters), o["len"]).otherwise(0))
    upto = lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: F.aggregate(F.slice(x, 1, k - 1), F.lit(0).cast("long"), lambda a, v: a + v))
    placed = alignments.where(F.size("ops") > 0).select("read_id", "start", "ops", upto(consumes("M=XDN")).alias("r"), upto(consumes("M=XIS")).alias("q"))
    each = placed.select("read_id", "start", F.posexplode("ops").alias("k", "o"), "r", "q").where(F.col("o.op").isin("M", "=", "X") & (F.col("o.len") > 0))
    return each.select("read_id", (F.col("start") + F.get("r", F.col("k"))).alias("r0"), F.get("q", F.col("k")).alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.len").cast("long") - 1)).alias("i")).select("read_id", (F.col("r0") + F.col("i")).alias("ref_pos"), (F.col("q0") + F.col("i")).alias("query_pos"))


def reference_to_query(aligned: DataFrame, wanted: DataFrame, slop: int = 2, barrier: int | None = None) -> DataFrame:
    """(read_id, ref_pos, query_pos, donor): for each wanted position the nearest aligned one within ``slop``.

    Of equals the higher reference position wins; a position below ``barrier`` is never filled from one
    at or above it. wanted: (read_id, ref_pos). Positions without a donor have no row. The join is an
    equi-join: each wanted position asks for its 2 * slop + 1 neighbours.
    """
    asked = wanted.select("read_id", F.col("ref_pos").alias("wanted"), F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("d")).withColumn("ref_pos", F.col("wanted") + F.col("d"))
    found = aligned.join(asked, ["read_id", "ref_pos"])
    if barrier is not None:
        found = found.where(~((F.col("wanted") < barrier) & (F.col("ref_pos") >= barrier)))
    best = F.min_by(F.struct("query_pos", F.col("ref_pos").alias("donor")), F.struct(F.abs("d"), -F.col("d")))
    return found.groupBy("read_id", "wanted").agg(best.alias("b")).select("read_id", F.col("wanted").alias("ref_pos"), "b.query_pos", "b.donor")
