"""Further queries: signal preparation, calls, alignment coordinates, annotations, lookups and demultiplexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import preparation as P
from strandline.operators import anchoring as N
from strandline.operators import annotations as T
from strandline.operators import calls as C
from strandline.operators import catalog as L
from strandline.operators import demux as D
from strandline.operators import kernels as K
from strandline.operators import relations as R
from strandline.operators import summary as M
from strandline.plans.bindings import relation
from strandline.plans.registry import ORACLE_SQL, QUERIES, _CELLS, _exploded, _rounded, _vectors, query

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- preparation ---------------------------------------------------------------------------------

_MAD = f"(select id, median(v) as m, mad(v) as d from {_CELLS} group by id)"


@query(f"""select id, 'whole' as part, p, round((v - m) / d, 6) as y from {_CELLS} join {_MAD} using (id)
  union all select id, 'short' as part, p, round(v, 6) as y from {_CELLS} where p > 54""")
def normalise_signal(spark, sf):
    """The whole array is normalised; its last ten values, taken as a signal of their own, are too short to be."""
    v = _vectors(spark, sf)
    whole = _exploded(v.select("id", P.normalise_signal(F.col("x")).alias("y"))).select("id", F.lit("whole").alias("part"), "p", "y")
    short = _exploded(v.select("id", P.normalise_signal(F.slice("x", -10, 10)).alias("y"))).select("id", F.lit("short").alias("part"), F.col("p") + 54, "y")
    return whole.unionByName(short.toDF("id", "part", "p", "y"))


@query(f"select id, (p - 1) // 10 + 1 as p, round(avg((v - m) / d), 6) as y from {_CELLS} join {_MAD} using (id) where p <= 60 group by id, (p - 1) // 10")
def normalise_then_pool(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.normalise_then_pool(F.col("x"), 10).alias("y")))


@query(f"""with pooled as (select id, (p - 1) // 5 + 1 as p, avg(v) as v from {_CELLS} where p <= 60 group by id, (p - 1) // 5)
  select id, p, round((v - m) / d, 6) as y from pooled join (select id, median(v) as m, mad(v) as d from pooled group by id) using (id)""")
def pool_then_normalise(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.pool_then_normalise(F.col("x"), 5).alias("y")))


@query(f"select id, p, round(greatest(least((v - m) / d, 2.0), -2.0), 6) as y from {_CELLS} join {_MAD} using (id)")
def mad_normalise_clipped(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.mad_normalise_clipped(F.col("x"), 2.0).alias("y")))


_LOGS = f"(select id, p, ln(greatest(abs(v) * 100, 1)) as w from {_CELLS})"


@query(f"select id, p, round(case when d >= 1e-6 then (w - m) / d else 0 end, 6) as y from {_LOGS} join (select id, median(w) as m, mad(w) as d from {_LOGS} group by id) using (id)")
def dwell_log_mad(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.dwell_log_mad(F.transform("x", lambda v: F.abs(v) * 100)).alias("y")))


@query(f"""select id, p, round((v - a) / s, 6) as z_score, round((v - lo) / (hi - lo), 6) as min_max, round((v - m) / d, 6) as median_mad, round(v - a, 6) as mean, round(v, 6) as none from {_CELLS}
  join (select id, avg(v) as a, stddev_pop(v) as s, min(v) as lo, max(v) as hi, median(v) as m, mad(v) as d from {_CELLS} group by id) using (id)""")
def fingerprint_normalisations(spark, sf):
    modes = ("z_score", "min_max", "median_mad", "mean", "none")
    made = _vectors(spark, sf).select("id", F.arrays_zip(*[P.normalise_fingerprint(F.col("x"), m).alias(m) for m in modes]).alias("y"))
    return _rounded(made.select("id", F.posexplode("y").alias("p", "y")).select("id", (F.col("p") + 1).cast("long").alias("p"), "y.*"))


@query(f"""select id, i as p, round(coalesce((v - m) / d, -5.0), 6) as y from (select id, unnest(range(1, 31)) as i from <vectors>) left join (
  select id, (p - 1) // 4 + 1 - 4 as i, avg(v) as v from {_CELLS} where p > 16 group by id, (p - 1) // 4) using (id, i)
  left join (select id, median(v) as m, mad(v) as d from (select id, avg(v) as v from {_CELLS} where p > 16 group by id, (p - 1) // 4) group by id) using (id)""")
def boundary_model_input(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.boundary_model_input(F.col("x"), 16, 136, 4).alias("y")))


@query(f"select id, case when k > 1 then cast((k - 1) * 10 + 1000 as bigint) end as adapter_end from (select id, min(p) as k from (select id, p, v, max(v) over (partition by id) as m from {_CELLS}) where v = m group by id)")
def adapter_end_decode(spark, sf):
    return _vectors(spark, sf).select("id", P.adapter_end(F.col("x")).cast("long").alias("adapter_end"))


@query(f"select id, p, round(((v + label) * 0.15 - 0.3) / 2.5, 6) as y from {_CELLS}")
def calibrate_standardise(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.calibrate_standardise(F.col("x"), F.col("label"), F.lit(0.15), 0.3, 2.5).alias("y")))


@query(f"""select id, p - s as p, round(((v + label) * 0.15 - 0.3) / 2.5, 6) as y from {_CELLS} join (
    select id, case when e > 64 or e = 0 then null when e >= 20 then e - 16 when e >= 16 then null when 16 - e <= 8 then 0 end as s
    from (select id, list_position(x, list_max(x)) - 1 + label as e from <vectors>)) using (id) where p > s and p <= s + 16""")
def lattice_input(spark, sf):
    """Windows of 16 samples before the place of the largest, moved on by the label, with a margin of 4 and a shift of at most 8."""
    end = F.array_position("x", F.array_max("x")) - 1 + F.col("label")
    return _exploded(_vectors(spark, sf).select("id", P.lattice_input(F.col("x"), end, F.col("label"), F.lit(0.15), 0.3, 2.5, 16, 4, 8).alias("y")))


@query(f"select id, p + k as p, round(case when k = 0 then v else abs(v) * 12 end, 6) as y from {_CELLS}, (select unnest([0, 64]) as k)")
def feature_vectors(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.feature_vector(F.col("x"), F.transform("x", lambda v: F.abs(v)), 12.0).alias("y")))


@query(f"select id, cast(k as bigint) as p, round(max(case when p = c + 1 then v end), 6) as y from {_CELLS}, (select unnest([1, 2, 3, 4]) as k, unnest([63, 0, 90, 7]) as c) group by id, k")
def select_cells(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.select_cells(F.col("x"), [63, 0, 90, 7]).alias("y")))


@query(f"select id, 65 - p as p, 100 - p as y from {_CELLS}")
def reverse_maps(spark, sf):
    boundaries = F.transform("x", lambda v, i: (i + 1).cast("long"))
    made = _vectors(spark, sf).select("id", P.reverse_map(boundaries, F.lit(100).cast("long")).alias("y"))
    return made.select("id", F.posexplode("y").alias("p", "y")).select("id", (F.col("p") + 1).cast("long").alias("p"), "y")


@query(f"select id, p, round((v - m) / (1.4826 * d), 6) as y from {_CELLS} join {_MAD} using (id)")
def gauge_levels(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.fix_gauge(F.col("x")).alias("y")))


_KEPT = f"(select id, p, case when p % 5 = 0 then 0.0 else v end as v from {_CELLS})"


@query(f"""select id, cast(k as bigint) as p, round(case when v <> 0 then (v - m) / s end, 6) as y from (select id, k, c, m, s from (select id, avg(v) as m, stddev_pop(v) as s from {_KEPT} where v <> 0 group by id),
  (select unnest([1, 2, 3, 4]) as k, unnest([1, 10, 64, 70]) as c)) left join {_KEPT} g using (id) where g.p = c union all select id, 4 as p, null as y from <vectors>""")
def expected_levels(spark, sf):
    """Positions 0, 9, 63 and 69 (none); every fifth level is zero, so is no level."""
    levels = F.transform("x", lambda v, i: F.when((i + 1) % 5 == 0, 0.0).otherwise(v))
    positions = F.array(*map(F.lit, (0, 9, 63, 69)))
    return _exploded(_vectors(spark, sf).select("id", P.expected_levels_z(levels, positions).alias("y")))


@query(f"""with g as (select id, p, (v - m) / (1.4826 * d) as v from {_CELLS} join {_MAD} using (id)), s as (select id, a, avg(v) as mean, stddev_pop(v) as sd from g, (select unnest([0, 16, 32, 48]) as a) where p > a and p <= a + 16 group by id, a)
  select id, cast(a // 4 + k + 1 as bigint) as p, round(case k when 0 then 16.0 when 1 then mean when 2 then sd when 3 then mean - a / 100.0 end, 6) as y from s, (select unnest([0, 1, 2, 3]) as k)""")
def junction_features(spark, sf):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 16).alias("end")) for a in (0, 16, 32, 48)])
    expected = F.array(*[F.lit(a / 100.0) for a in (0, 16, 32, 48)])
    return _exploded(_vectors(spark, sf).select("id", P.junction_features(F.col("x"), spans, expected).alias("y")))


@query("select id, i, round(least(case when v < 50 then 0.5 * pow((v - 50) / 50, 2) else 0.5 * ln(v / 50) end, 0.3), 9) as cost from <samples>")
def dwell_penalties(spark, sf):
    return _rounded(relation(spark, sf, "samples").select("id", "i", P.dwell_penalty(F.col("v"), 50.0, 0.5, 0.3).alias("cost")), 9)


@query("select id, i, round(0.5 * case when v < 50 then pow(50 - v, 2) else ln(1 + v / 50) end, 6) as cost from <samples>")
def stay_costs(spark, sf):
    return _rounded(relation(spark, sf, "samples").select("id", "i", P.stay_cost(F.col("v"), 50.0, 0.5).alias("cost")))


@query()
def dwell_alignment(spark, sf):
    def align(x):
        import numpy as np

        guess = np.linspace(0, len(x), 9).astype(int)
        return K.dwell_path(x, [float(np.mean(x[a:b])) for a, b in zip(guess, guess[1:])], *K.half_band(guess, 2, len(x)), 8.0, 0.01)

    return _vectors(spark, sf).select("id", K.column(align, "array<bigint>")("x").alias("boundaries"))


@query(f"select id, p, round(1 / (1 + exp(v * -1.7 + 0.2)), 6) as y from {_CELLS}")
def platt_scaling(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", F.transform("x", lambda v: P.platt(v, -1.7, 0.2)).alias("y")))


@query(f"""select id, k as p, round(s / sum(s) over (partition by id), 6) as y from (select id, k, sum(case when i = k then q else 1 - q end) as s from (select id, i, j, 1 / (1 + exp(-v)) as q from {_CELLS}
  join (select row_number() over (order by i, j) as p, i, j from (select unnest(range(1, 5)) as i), (select unnest(range(1, 5)) as j) where i < j) using (p)), (select unnest(range(1, 5)) as k) where i = k or j = k group by id, k)""")
def vote_probabilities(spark, sf):
    """The first six components are the pairwise decisions of four classes."""
    return _exploded(_vectors(spark, sf).select("id", P.vote_probabilities(F.col("x"), 4).alias("y")))


@query(f"""select id, c + 1 as p, round(e / sum(e) over (partition by id), 6) as y from (select id, (p - 1) % 3 as c, exp(sum(case when v <= 0 then 0.5 else -0.5 end)) as e from {_CELLS} group by id, (p - 1) % 3)""")
def tree_columns(spark, sf):
    """A stump on each of the 64 components, as conditions instead of Python."""
    forest = [{"feature": [f, -1, -1], "threshold": [0.0, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, 0.5, -0.5], "missing_left": [True] * 3, "class": f % 3} for f in range(64)]
    P.check_trees(forest, 64, 3)
    return _exploded(_vectors(spark, sf).select("id", P.trees(F.col("x"), forest, [0.0, 0.0, 0.0]).alias("y")))


@query(f"select id, {', '.join(f'round(max(case when p = {k} then q end), 6) as p{k + 9:02d}' for k in (1, 2, 3))} from (select id, p, exp(v) / sum(exp(v)) over (partition by id) as q from {_CELLS}) group by id")
def probability_columns(spark, sf):
    p = _vectors(spark, sf).select("id", A.softmax(F.col("x")).alias("p"))
    return _rounded(p.select("id", *P.probability_columns(F.col("p"), [10, 11, 12])))


@query(f"select id, round(1 / (2 * median(v) * median(v)), 5) as gamma from {_CELLS} where v > 0 group by id")
def kernel_widths(spark, sf):
    return _rounded(_vectors(spark, sf).select("id", P.kernel_width(F.col("x")).alias("gamma")), 5)


@query("""select read_id, case when num_samples < 1024 then printf('%d B', num_samples) when num_samples < 1048576 then printf('%.1f KB', num_samples / 1024.0) else printf('%.1f MB', num_samples / 1048576.0) end as size,
  printf('%.1f hrs', (num_samples * 1000 + 1) / 4000.0 / 3600.0) as duration, case when num_samples >= 1000000 then printf('%.1fM', num_samples / 1e6) when num_samples >= 1000 then printf('%.0fK', num_samples / 1e3) else cast(num_samples as varchar) end as compact,
  format('{:,}', num_samples) as thousands, strftime(make_timestamp(start_sample * 1000000), '%Y-%m-%d %H:%M UTC') as started from <reads>""")
def formatted_numbers(spark, sf):
    n = F.col("num_samples")
    return relation(spark, sf, "reads").select("read_id", P.bytes_text(n).alias("size"), P.hours_text(n * 1000 + 1, F.lit(4000)).alias("duration"), P.compact_text(n).alias("compact"), P.thousands_text(n).alias("thousands"), P.start_text(F.col("start_sample") * 1000).alias("started"))


@query(f"select id, p, round_even(v * 1000, 0) as y from {_CELLS}")
def codec_samples(spark, sf):
    """Every sample after a round trip through the signal codec."""
    pack = K.column(lambda x: K.compress_signal([round(v * 1000) for v in x]), "binary")
    unpack = K.column(lambda d, n: K.decompress_signal(d, int(n)).astype(float), "array<double>")
    packed = _vectors(spark, sf).select("id", pack("x").alias("data"), F.size("x").cast("long").alias("n"))
    return _exploded(packed.select("id", unpack("data", "n").alias("y")))


# --- calls ---------------------------------------------------------------------------------------

#: Matches of reads with a margin, and scores of a lattice that lack for some.
_MATCHES = """select l_orderkey * 10 + l_linenumber as id, concat('BC', cast(l_suppkey % 4 as varchar)) as best, case when l_linenumber = 7 then null else cast(l_quantity as int) % 6 end as margin,
  case when l_linenumber < 5 then -l_discount * 10 end as log_p, case when l_linenumber < 4 then l_tax * 100 end as lattice_margin from lineitem"""


def _matches(spark, sf):
    return spark.sql(_MATCHES.replace("varchar", "string").replace("from lineitem", "from {l}"), l=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query(f"select id, best as barcode, coalesce(margin, 0)::double as confidence from ({_MATCHES}) where margin is null or margin >= 3")
def barcode_calls(spark, sf):
    return C.call_barcode(_matches(spark, sf), 3)


@query(f"""select id, case when coalesce(margin >= 3, true) and coalesce(lattice_margin >= 2, true) and coalesce(exp(log_p) >= 0.6, true) then best else 'unclassified' end as barcode, coalesce(margin, 0)::double as confidence,
  round(log_p, 6) as log_p, round(lattice_margin, 6) as lattice_margin from ({_MATCHES})""")
def barcode_calls_scored(spark, sf):
    return _rounded(C.call_barcode_scored(_matches(spark, sf), 3, 2.0, 0.6))


_BOUNDS = "select o_orderkey as read_id, cast(o_custkey % 50 as bigint) as adapter_start, cast(o_orderkey % 60 as bigint) as adapter_end from orders"


@query(f"select read_id, num_samples, adapter_start, adapter_end from <reads> join ({_BOUNDS}) using (read_id) where adapter_end > adapter_start")
def boundaries_of_reads(spark, sf):
    bounds = spark.sql(_BOUNDS.replace("from orders", "from {o}"), o=spark.read.parquet(f"{sf}/orders.parquet"))
    return C.joined_boundaries(relation(spark, sf, "reads"), bounds).select("read_id", "num_samples", "adapter_start", "adapter_end")


_ANCHORED = "select l_orderkey + l_linenumber % 2 as read_id, ord, ns, depth, p from (select l_orderkey, l_linenumber, l_linenumber * 10000000 + l_partkey as ord, l_partkey as k, cast(l_quantity as bigint) % 5 as depth, l_discount * 10 as p, cast(floor(o_totalprice) as bigint) + l_suppkey % 3 as ns from lineitem join orders on o_orderkey = l_orderkey)"


def _anchored(spark, sf):
    text = _ANCHORED.replace("from lineitem join orders", "from {l} join {o}")
    return spark.sql(text, l=spark.read.parquet(f"{sf}/lineitem.parquet"), o=spark.read.parquet(f"{sf}/orders.parquet"))


_REASONS = f"select a.*, case when num_samples is null then 'no_signal' when num_samples <> ns then 'ns_mismatch' when depth = 0 then 'abstain' end as no_call from ({_ANCHORED}) a left join <reads> using (read_id)"


@query(f"select read_id, ord, no_call from ({_REASONS})")
def no_call_reasons(spark, sf):
    return C.anchored_signals(_anchored(spark, sf), relation(spark, sf, "reads")).select("read_id", "ord", "no_call")


@query(f"""select count(*) as n, count(q) as scored, count(*) filter (no_call = 'no_signal') as no_signal, count(*) filter (no_call = 'ns_mismatch') as ns_mismatch, count(*) filter (no_call = 'abstain') as abstain,
  round(list_sort(list(q) filter (q is not null))[count(q) // 2 + 1], 6) as median_p, round(count(*) filter (q >= 0.6) * 100.0 / count(q), 6) as percent_over from (select no_call, case when no_call is null then p end as q from ({_REASONS}))""")
def classify_stats(spark, sf):
    joined = C.anchored_signals(_anchored(spark, sf), relation(spark, sf, "reads"))
    return _rounded(C.classify_stats(joined.withColumn("p", F.when(F.col("no_call").isNull(), F.col("p"))), 0.6))


@query("select read_id, ord, cl from <alignments> left join (select o_orderkey as read_id, cast(round(o_orderkey % 101 / 100.0 * 255) as int) as cl from orders where o_orderkey % 3 <> 0) using (read_id)")
def tagged_alignments(spark, sf):
    calls = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("read_id"), (F.col("o_orderkey") % 101 / 100.0).alias("p"))
    return C.tagged(relation(spark, sf, "alignments"), calls).select("read_id", "ord", "cl")


@query("select a.read_id, a.reference, b.ours, a.reference = b.ours as agree from (select read_id, ord, reference from <calls>) a join (select read_id, ord, ours from <calls>) b on a.read_id = b.read_id and a.ord = b.ord")
def call_comparison(spark, sf):
    calls = relation(spark, sf, "calls")
    ids = F.struct("read_id", "ord").alias("read_id")
    found = C.comparison(calls.select(ids, F.col("reference").alias("barcode")), calls.select(ids, F.col("ours").alias("barcode")))
    return found.select("read_id.read_id", "reference", "ours", "agree")


@query("select reference, count(*) filter (mapped) as matched, count(*) as total, round(count(*) filter (mapped) * 100.0 / count(*), 6) as percent from (select concat('BC', cast(l_suppkey % 4 as varchar)) as reference, l_returnflag <> 'N' as mapped from lineitem) group by reference")
def match_percentages(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("BC"), F.col("l_suppkey") % 4).alias("reference"), (F.col("l_returnflag") != "N").alias("mapped"))
    counted = rows.groupBy("reference").agg(F.count_if("mapped").alias("matched"), F.count("*").alias("total"))
    return _rounded(counted.withColumn("percent", C.match_percentage(F.col("matched"), F.col("total"))))


@query("select read_id, case when call >= 0 then printf('BC%02d', call) else 'unclassified' end as barcode, printf('%.4f', greatest(a, b)) as confidence, printf('%.4f', a) as p03, printf('%.4f', b) as p05 from (select o_orderkey as read_id, cast(o_custkey % 9 - 1 as int) as call, o_orderkey % 100 / 100.0::double as a, 1 - o_orderkey % 100 / 100.0::double as b from orders)")
def class_table(spark, sf):
    a = F.col("o_orderkey") % 100 / F.lit(100.0)
    calls = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 9 - 1).cast("int").alias("call"), F.array(a, 1 - a).alias("p"))
    return C.class_table(calls, [3, 5], probabilities=True)


@query("select read_id, reference as barcode, printf('%.4f', difference) as distance, printf('%.4f', difference + 1) as second_best_distance, printf('%.4f', ratio) as ratio, case when ratio <= 0.8 then 'true' else 'false' end as confident from (select read_id, reference, abs(difference)::double as difference, abs(difference) / 125.0::double as ratio from <calls>)")
def distance_table(spark, sf):
    d = F.abs("difference").cast("double")
    rows = relation(spark, sf, "calls").select("read_id", F.col("reference").alias("barcode"), d.alias("distance"), (d + 1).alias("second_best_distance"), (d / 125.0).alias("ratio"))
    return C.distance_table(rows.withColumn("confident", F.col("ratio") <= 0.8))


# --- alignment coordinates -----------------------------------------------------------------------

#: Two aligned runs with an insertion of 3 and a deletion of (quantity % 5) between them, behind a clip of 2.
_RUNS = "select cast(l_orderkey * 10 + l_linenumber as bigint) as read_id, cast(min(l_partkey) % 40 as bigint) as start, cast(min(l_quantity) as bigint) % 5 as gap from lineitem group by 1"


def _ops(spark, sf):
    rows = spark.sql(_RUNS.replace("from lineitem", "from {l}"), l=spark.read.parquet(f"{sf}/lineitem.parquet"))
    op = lambda letter, n: F.struct(F.lit(letter).alias("op"), (n if not isinstance(n, int) else F.lit(n)).cast("long").alias("len"))
    return rows.select("read_id", "start", F.array(op("S", 2), op("M", 8), op("I", 3), op("D", F.col("gap")), op("M", 6)).alias("ops"))


_BASES = f"(select read_id, start + i as ref_pos, i + 2 as query_pos from ({_RUNS}), (select unnest(range(0, 8)) as i) union all select read_id, start + 8 + gap + i as ref_pos, i + 13 as query_pos from ({_RUNS}), (select unnest(range(0, 6)) as i))"


@query(f"select read_id, ref_pos, query_pos from {_BASES}")
def aligned_bases(spark, sf):
    return C.aligned_bases(_ops(spark, sf))


@query(f"""select read_id, cast(w as bigint) as ref_pos, query_pos, donor from (select read_id, w, query_pos, b.ref_pos as donor, row_number() over (partition by read_id, w order by abs(b.ref_pos - w), b.ref_pos desc) as r
  from {_BASES} b, (select unnest([10, 20, 30]) as w) where abs(b.ref_pos - w) <= 2 and not (w < 21 and b.ref_pos >= 21)) where r = 1""")
def reference_to_query(spark, sf):
    wanted = F.array(*[F.lit(w).cast("long") for w in (10, 20, 30)])
    found = N.reference_positions(_ops(spark, sf), wanted, 2, F.lit(21)).select("read_id", F.posexplode("query").alias("k", "q"))
    return found.where("q is not null").select("read_id", F.get(wanted, F.col("k")).alias("ref_pos"), F.col("q.base").alias("query_pos"), F.col("q.donor").alias("donor"))


# --- annotations and lookups ---------------------------------------------------------------------


def _annotated(spark, sf):
    labels = relation(spark, sf, "labels").withColumn("score", F.col("read_id") % 7 / F.lit(8.0))
    own = T.write_columns(T.empty(relation(spark, sf, "reads")), labels, ["barcode", "score"])
    wells = relation(spark, sf, "reads").select("read_id", F.concat(F.lit("W"), F.col("well")).alias("well_name"))
    return T.write_annotation(own, wells, "well_name")


_ANNOTATED = "(select r.read_id, nullif(barcode, '') as barcode, score, concat('W', cast(well as varchar)) as well_name from <reads> r left join (select read_id, barcode, read_id % 7 / 8.0::double as score from <labels>) l on l.read_id = r.read_id)"


@query(f"select read_id, barcode, score, well_name from {_ANNOTATED}")
def annotation_columns(spark, sf):
    return T.read_columns(_annotated(spark, sf), ["barcode", "score", "well_name"])


@query(f"select read_id, well_name from {_ANNOTATED}")
def annotation_removed(spark, sf):
    left = T.remove_annotation(T.remove_annotation(_annotated(spark, sf), "score"), "barcode")
    return T.read_annotation(left)


@query(f"select read_id, score from {_ANNOTATED} where score is not null")
def annotation_score(spark, sf):
    return T.read_score(_annotated(spark, sf))


@query(f"""select 'barcode' as name, barcode as label, count(*) as n, null::double as least, null::double as most from {_ANNOTATED} where barcode is not null group by barcode
  union all select 'well_name' as name, well_name as label, count(*) as n, null::double as least, null::double as most from {_ANNOTATED} group by well_name
  union all select 'score' as name, null as label, count(score) as n, min(score) as least, max(score) as most from {_ANNOTATED}""")
def annotation_summary(spark, sf):
    return T.describe(_annotated(spark, sf))


_DESIGN = "(select concat('W', cast(well as varchar)) as well_name, nullif(condition, '') as condition, nullif(replicate, '') as replicate from <design>)"


@query(f"select read_id, a.well_name, condition, replicate from {_ANNOTATED} a left join {_DESIGN} d on a.well_name = d.well_name")
def annotation_design(spark, sf):
    design = relation(spark, sf, "design").select(F.concat(F.lit("W"), F.col("well")).alias("well_name"), "condition", "replicate")
    return T.read_columns(T.write_design(_annotated(spark, sf), "plate", design, ["well_name"]), ["well_name", "condition", "replicate"])


@query(f"select cast(read_id as varchar) as read_id, coalesce(barcode, '') as barcode, coalesce(printf('%.4f', score), '') as score from {_ANNOTATED}")
def annotated_view(spark, sf):
    own = _annotated(spark, sf)
    shown = R.view(relation(spark, sf, "reads"), ["read_id"])
    return T.with_annotations(shown, T.Annotations(own.table.withColumn("read_id", F.col("read_id").cast("string")), own.designs), ["barcode", "score"])


@query(f"select distinct barcode from {_ANNOTATED} where barcode is not null")
def distinct_labels(spark, sf):
    return T.distinct_labels(_annotated(spark, sf).table, "barcode")


@query("select read_id, coalesce(b, a) as barcode from (select read_id, nullif(barcode, '') as a, case when read_id % 2 = 0 then concat('X', cast(read_id % 5 as varchar)) end as b from <labels>) where coalesce(b, a) is not null")
def annotations_merged(spark, sf):
    first = relation(spark, sf, "labels")
    second = first.select("read_id", F.when(F.col("read_id") % 2 == 0, F.concat(F.lit("X"), F.col("read_id") % 5)).otherwise("").alias("barcode"))
    return T.merge_annotations([first, second], "barcode")


@query("select read_id, channel, num_samples from <reads> where read_id = (select max(read_id) from <reads> where read_id <= 100)")
def find_read(spark, sf):
    reads = relation(spark, sf, "reads")
    one = reads.where("read_id <= 100").agg(F.max("read_id")).first()[0]
    return L.find_read(reads, one).select("read_id", "channel", "num_samples")


@query("select read_id, source_file, batch_idx, row_idx from <reads> where read_id in (select read_id from <labels>)")
def storage_order(spark, sf):
    return L.storage_order(relation(spark, sf, "reads"), relation(spark, sf, "labels"))


@query("select r.read_id, coalesce(len(list(chunk_idx) filter (chunk_idx is not null)), 0) as n, list_sort(list(chunk_idx) filter (chunk_idx is not null))[1] as first_chunk from <reads> r left join <signal> s on r.read_id = s.read_id where r.read_id in (select read_id from <labels>) group by r.read_id")
def signal_rows(spark, sf):
    found = L.signal_rows(relation(spark, sf, "reads"), relation(spark, sf, "signal"), relation(spark, sf, "labels"))
    return found.select("read_id", F.size("chunks").cast("long").alias("n"), F.get("chunks", F.lit(0)).alias("first_chunk"))


@query("select count(*) as signal_rows from <signal>")
def signal_row_count(spark, sf):
    return L.signal_row_count(relation(spark, sf, "signal"))


@query("select read_id, chunk_idx, cast(i // 100 as bigint) as batch, cast(i % 100 as bigint) as row from (select read_id, chunk_idx, row_number() over (order by read_id, chunk_idx) - 1 as i from <signal>)")
def chunk_batches(spark, sf):
    found = L.chunk_batches(relation(spark, sf, "signal"), 100)
    return found.select("read_id", "chunk_idx", F.col("batch").cast("long").alias("batch"), F.col("row").cast("long").alias("row"))


@query("select distinct 'end_reason' as name, end_reason as value from <reads> union all select distinct 'pore_type' as name, pore_type as value from <reads>")
def dictionary_values(spark, sf):
    return L.dictionary_values(relation(spark, sf, "reads"), ["end_reason", "pore_type"])


@query("select r.read_id, t.read_id as found from <reads> r left join <reads> t on t.source_file = r.source_file and t.batch_idx = r.batch_idx and t.row_idx = r.row_idx + 4 where r.read_id % 97 = 0")
def index_check(spark, sf):
    """An index with every 97th read four rows off: these rows are found, with the read that is there, if any."""
    reads = relation(spark, sf, "reads")
    off = F.when(F.col("read_id") % 97 == 0, 4).otherwise(0)
    return L.verify_index(L.build_index(reads.withColumn("row_idx", F.col("row_idx") + off)), reads)


@query("select read_id, ord, num_samples from <alignments> join <reads> using (read_id)")
def alignments_with_signal(spark, sf):
    return L.with_signal(relation(spark, sf, "alignments"), relation(spark, sf, "reads")).select("read_id", "ord", "num_samples")


# --- demultiplexing ------------------------------------------------------------------------------


@query()
def demux_pipeline(spark, sf):
    """Boundary, fingerprint, nearest reference and gate in one plan, over signals with a start, an adapter of eight levels that tell the class, and a rise."""
    import numpy as np

    shape = lambda label, i: F.when(i < 12, 70.0).when(i < 44, (label + 1) * (F.floor((i - 12) / 8) + 2) * 5 % 13).otherwise(90.0)
    signals = relation(spark, sf, "vectors").select("id", "label", F.transform(F.col("x").cast("array<double>"), lambda v, i: v * 0.5 + shape(F.col("label"), i)).alias("x"))
    signals = signals.withColumn("label", F.col("label").cast("int"))
    few = sorted((r.label, r.id, r.x) for r in M.reservoir(signals, "label", "id", 3).collect())  # a fixed number per class
    prints = [(f, y) for y, _, x in few if (f := K.fingerprint(x[12:44], 4, 4))]
    return D.demultiplex(signals, np.array([f for f, _ in prints]), [f"BC{y:02d}" for _, y in prints], 8, 3, 4, 4, None, 0.1, 1.0)
