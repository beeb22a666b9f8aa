"""Anchoring reads on references, and classifying them: reference to query to signal inside the row.

Two monotone maps are composed: the alignment's runs take a reference position to a base, the move table
takes a base to its samples. Both stay arrays of the read's row; only the runs near the wanted positions
are kept, so nothing is exploded, joined or shuffled by base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import preparation as P

#: How far off the nearest aligned base may be that stands for a position without one.
SLOP = 2
GEOMETRY = ("cca_a", "junction", "divergent", "body_mid", "polya_mid")
_RUNS = "array<struct<r:bigint,q:bigint,n:bigint>>"


def aligned_runs(ops: Column, start: Column, low: Column, high: Column) -> Column:
    """The aligned runs (r, q, n: reference start, query start, length; 0-based) that touch reference positions ``low`` to ``high``.

    ops: array of (op, len). M, = and X align, I and S consume the query, D and N the reference.
    """
    zero = F.lit(0).cast("long")
    first = F.struct(start.cast("long").alias("r"), zero.alias("q"), F.array().cast(_RUNS).alias("runs"))

    def step(s: Column, o: Column) -> Column:
        n = o["len"].cast("long")
        both, on_ref, on_query = o["op"].isin("M", "=", "X"), o["op"].isin("M", "=", "X", "D", "N"), o["op"].isin("M", "=", "X", "I", "S")
        run = F.struct(s["r"].alias("r"), s["q"].alias("q"), n.alias("n"))
        near = both & (n > 0) & (s["r"] <= high) & (s["r"] + n > low)
        return F.struct((s["r"] + F.when(on_ref, n).otherwise(zero)).alias("r"), (s["q"] + F.when(on_query, n).otherwise(zero)).alias("q"), F.when(near, F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(ops, first, step, lambda s: s["runs"])


def nearest_base(runs: Column, r: Column, cap: Column | None = None) -> Column:
    """struct(off, below, base): the aligned reference position nearest to ``r``, the higher of equals, by how far it is off, and its base; null without runs.

    No position above ``cap`` is used (null: any). Every run has one nearest position, so this is one pass
    over the runs.
    """

    def of_run(x: Column) -> Column:
        last = x["r"] + x["n"] - 1
        at = F.least(F.greatest(r, x["r"]), last if cap is None else F.least(last, cap))
        # Bound, or it would be made anew for each field.
        return A.bound(at, lambda at: F.when(at >= x["r"], F.struct(F.abs(at - r).alias("off"), (at < r).alias("below"), (x["q"] + at - x["r"]).alias("base"))))

    return F.array_min(F.transform(runs, of_run))


def below_barrier(r: Column, barrier: Column) -> Column:
    """The cap of a position below the barrier, which is never filled from one at or above it; others have none."""
    return F.when(r < barrier, barrier - 1)


def within(near: Column, slop: int = SLOP) -> Column:
    return F.when(near["off"] <= slop, near["base"])


def reference_positions(alignments: DataFrame, wanted: Column, slop: int = SLOP, barrier: Column | None = None) -> DataFrame:
    """``alignments`` (start, ops) with ``query``: for each position of the array ``wanted`` the nearest base within ``slop`` as struct(base, donor), with the position it is aligned to, or null."""

    def one(found: Column, r: Column) -> Column:
        donor = lambda n: r + F.when(n["below"], -n["off"]).otherwise(n["off"])
        return A.bound(nearest_base(found, r, None if barrier is None else below_barrier(r, barrier)), lambda n: F.when(n["off"] <= slop, F.struct(n["base"].alias("base"), donor(n).alias("donor"))))

    runs = aligned_runs(F.col("ops"), F.col("start"), F.array_min(wanted) - slop, F.array_max(wanted) + slop)
    return alignments.withColumn("query", A.bound(runs, lambda found: F.transform(wanted, lambda r: one(found, r.cast("long")))))


def signal_map(moves: Column, stride: Column, trim: Column, ns: Column) -> Column:
    """First samples of the bases, and the number of samples behind them."""
    starts = F.filter(F.transform(moves, lambda m, i: F.when(m == 1, i.cast("long") * stride + trim)), lambda x: x.isNotNull())
    return F.concat(starts, F.array(ns.cast("long")))


def anchor_reads(alignments: DataFrame, geometry: DataFrame, offsets: list[int], least_mapq: int = 0, whole: bool = True) -> DataFrame:
    """One row per alignment with its anchors, or the reason (``skip``) why it has none; not ``whole``: only those without a reason.

    alignments: read_id, reference, mapped, reverse, secondary, supplementary, mapq, start, ops, moves,
    stride, ts, ns (moves or ns null: no move table; ts null: 0); other columns stay. geometry: reference
    (once each) with GEOMETRY. Reasons in the order of the tests: filtered, low_mapq, no_geometry, no_tags,
    unanchored, query_out_of_range, bad_name (a null id). Reads gather on few references, so the
    geometry is broadcast and no read moves.

    Added: seq_to_sig, nb, q_junction, q_cca_a, q_div_m1, q_body_mid, q_polya_mid (nearest base within
    SLOP, the last three null where there is none) and qf, for each offset from the junction the base
    aligned exactly there, or -1.
    """
    mark = {c: F.col(c).cast("long") for c in GEOMETRY}
    barrier, junction = mark["divergent"], mark["junction"]
    marks = {"q_cca_a": mark["cca_a"], "q_junction": junction, "q_div_m1": barrier - 1, "q_body_mid": mark["body_mid"], "q_polya_mid": mark["polya_mid"]}
    wanted = F.array(*marks.values(), *[junction + o for o in offsets])
    # What depends on the reference only is made once for it, not for each read.
    named = geometry.select(
        "reference", junction.alias("_junction"), (F.array_min(wanted) - SLOP).alias("_low"), (F.array_max(wanted) + SLOP).alias("_high"),
        F.transform(wanted, lambda r: F.struct(r.alias("r"), below_barrier(r, barrier).alias("cap"))).alias("_wanted"),
    )
    none = F.array_repeat(F.lit(None).cast("struct<r:bigint,cap:bigint>"), len(marks) + len(offsets))
    runs = aligned_runs(F.col("ops"), F.col("start"), F.col("_low"), F.col("_high"))
    early = (
        F.when(~F.col("mapped") | F.col("reverse") | F.col("secondary") | F.col("supplementary"), "filtered")
        .when(F.coalesce("mapq", F.lit(255)) < least_mapq, "low_mapq")
        .when(F.col("_junction").isNull(), "no_geometry")
        .when(F.col("moves").isNull() | F.col("ns").isNull() | F.col("stride").isNull(), "no_tags")
    )
    joined = alignments.join(F.broadcast(named), "reference", "left")
    # Bound, or the runs would be made anew for each position.
    found = (joined if whole else joined.where(early.isNull())).withColumns(
        {
            "_near": A.bound(runs, lambda found: F.transform(F.coalesce("_wanted", none), lambda w: nearest_base(found, w["r"], w["cap"]))),
            "seq_to_sig": signal_map(F.col("moves"), F.col("stride"), F.coalesce("ts", F.lit(0)), F.col("ns")),
            # Counted, not the map's size: a query that takes no samples makes no map.
            "nb": F.size(F.filter("moves", lambda m: (m == 1) & F.col("stride").isNotNull())).cast("long"),
        }
    )
    exact = F.transform(F.slice("_near", len(marks) + 1, len(offsets)), lambda x: F.when(x["off"] == 0, x["base"]).otherwise(-1))
    found = found.withColumns({"qf": exact} | {name: within(F.get("_near", F.lit(i))) for i, name in enumerate(marks)})
    outside = F.array_max(F.transform("_near", lambda x: within(x))) >= F.col("nb")
    skip = (
        early.when(F.col("q_junction").isNull() | F.col("q_cca_a").isNull(), "unanchored")
        .when(outside, "query_out_of_range")
        .when(F.col("read_id").isNull(), "bad_name")
    )
    # Always true, but not deterministic: else a test of skip would move below the anchors and make them anew for each of its terms.
    kept = F.when(F.monotonically_increasing_id() >= 0, skip)
    made = found.withColumn("skip", kept).drop("_near", "_junction", "_low", "_high", "_wanted")
    return made if whole else made.where("skip is null")


def orientation_votes(anchored: DataFrame) -> DataFrame:
    """(reversed) of the reads that show it: whether the junction's samples come after the body's."""
    informative = anchored.where("skip is null and q_body_mid is not null and q_body_mid < nb")
    return informative.select((~(F.get("seq_to_sig", F.col("q_junction").cast("int")) < F.get("seq_to_sig", F.col("q_body_mid").cast("int")))).alias("reversed"))


def feature_bases(offsets: list[int], arm_bases: int = 0) -> Column:
    """The base of each offset: qf, or with ``arm_bases`` those of offsets 1 to arm_bases counted from the junction, and -1 beyond."""
    one = lambda i, o: F.get("qf", F.lit(i)) if not arm_bases or o < 1 else (F.col("q_junction") + o if o <= arm_bases else F.lit(-1).cast("long"))
    return F.array(*[one(i, o) for i, o in enumerate(offsets)])


def signal_coordinates(anchored: DataFrame, offsets: list[int], reversed_signal: bool, arm_bases: int = 0) -> DataFrame:
    """Anchored reads with their places in the signal, in the order of time.

    spans: (start, end) of each offset's base, (-1, -1) without one; junction_sig, junction_dwell,
    cca_a_sig, cca_a_dwell; body_mid_sig, polya_mid_sig (-1 without); arm_depth and aligner_depth, the
    deepest offset from 1 with a span, and with an exactly aligned base; common_start_sig, from where
    samples may be read, and mask_source, how it was found: counted or exact, arm_fallback (the earliest
    span of an offset from 1), junction_fallback (none: the read can't be judged).
    """
    nb, s2s = F.col("nb"), F.col("seq_to_sig")

    def span(q: Column) -> Column:
        a, b = F.get(s2s, q.cast("int")), F.get(s2s, q.cast("int") + 1)
        a, b = (F.col("ns") - b, F.col("ns") - a) if reversed_signal else (a, b)
        return F.struct(F.least(a, b).cast("long").alias("start"), F.greatest(a, b).cast("long").alias("end"))

    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    spans = F.transform(feature_bases(offsets, arm_bases), lambda q: F.when((q >= 0) & (q < nb), span(q)).otherwise(none))
    placed = anchored.withColumns({"spans": spans, "_junction": span(F.col("q_junction")), "_cca": span(F.col("q_cca_a"))})
    deep = lambda ok: F.coalesce(F.array_max(F.array(F.lit(0), *[F.when(ok(i), F.lit(o)) for i, o in enumerate(offsets) if o >= 1])), F.lit(0))
    starts = [F.when(F.col("spans")[i]["start"] >= 0, F.col("spans")[i]["start"]) for i, o in enumerate(offsets) if o >= 1]
    arm = F.array_min(F.array(*starts)) if starts else F.lit(None).cast("long")
    last = F.col("q_junction") + arm_bases if arm_bases else F.col("q_div_m1")
    exact = F.when((last >= 0) & (last < nb), span(last)["start"])
    return placed.withColumns(
        {
            "junction_sig": F.col("_junction.start"), "junction_dwell": F.col("_junction.end") - F.col("_junction.start"), "cca_a_sig": F.col("_cca.start"), "cca_a_dwell": F.col("_cca.end") - F.col("_cca.start"),
            **{f"{c}_sig": F.coalesce(F.when(F.col(f"q_{c}") < nb, span(F.col(f"q_{c}"))["start"]), F.lit(-1).cast("long")) for c in ("body_mid", "polya_mid")},
            "arm_depth": deep(lambda i: F.col("spans")[i]["start"] >= 0), "aligner_depth": deep(lambda i: (F.get("qf", F.lit(i)) >= 0) & (F.get("qf", F.lit(i)) < nb)),
            "common_start_sig": F.coalesce(exact, arm, F.col("_junction.start")),
            "mask_source": F.when(exact.isNotNull(), "counted" if arm_bases else "exact").when(arm.isNotNull(), "arm_fallback").otherwise("junction_fallback"),
        }
    ).drop("_junction", "_cca")


def classify_reads(anchored: DataFrame, signals: DataFrame, offsets: list[int], cells: list[int], forest: list[dict], baseline: list[float], reversed_signal: bool, arm_bases: int = 0, abstain: bool = True, threshold: float = 0.5) -> tuple[DataFrame, Observation]:
    """Every anchored read with its probability ``p`` and ``cl`` (0 to 255), or the reason why it has none; and the counts of both.

    anchored: of ``anchor_reads``, those without ``skip``, with ``levels`` (expected level of each base, or
    null); signals: read_id (once each), signal (ADC values), offset, scale. Reasons: no_signal,
    ns_mismatch (another number of samples), no_aligned_arm (with ``abstain``: the aligner reached no arm base).
    The score is the boosted trees' second class over the feature grid's ``cells``.

    The observation has n, scored, each reason and over (p at or over the threshold); it is filled by
    whatever action reads the calls, so statistics cost no second pass.
    """
    held = signals.select("read_id", A.calibrate(F.col("signal"), F.col("offset"), F.col("scale")).alias("_pa"))
    joined = signal_coordinates(anchored.where("skip is null"), offsets, reversed_signal, arm_bases).join(held, "read_id", "left")
    reason = F.when(F.col("_pa").isNull(), "no_signal").when(F.size("_pa") != F.col("ns"), "ns_mismatch")
    reason = reason.when(F.lit(abstain) & (F.col("aligner_depth") == 0), "no_aligned_arm")
    expected = P.expected_levels_z(F.col("levels"), feature_bases(offsets, arm_bases))
    expected = F.coalesce(expected, F.array(*[F.lit(None).cast("double") for _ in offsets]))
    graded = joined.withColumn("reason", reason).withColumn("_grid", F.when(F.col("reason").isNull(), P.junction_features(F.col("_pa"), F.col("spans"), expected)))
    scored = graded.withColumn("_x", P.select_cells(F.col("_grid"), cells)).withColumn("p", F.when(F.col("reason").isNull(), F.get(P.trees(F.col("_x"), forest, baseline), F.lit(1))))
    calls = scored.withColumn("cl", A.scale_probability(F.col("p"))).drop("_pa", "_grid", "_x")
    seen = Observation("classify_reads")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in ("no_signal", "ns_mismatch", "no_aligned_arm")]
    return calls.observe(seen, F.count(F.lit(1)).alias("n"), F.count("p").alias("scored"), *counts, F.count_if(F.col("p") >= threshold).alias("over")), seen


def ordered_calls(calls: DataFrame) -> DataFrame:
    """The calls, and the reads without one, sorted by id over all partitions."""
    return calls.orderBy("read_id")
