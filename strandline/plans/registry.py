"""Queries over the given tables, one or more for each operator, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import preparation as P
from strandline.functions import sequences as S
from strandline.operators import batches as B
from strandline.operators import demux as D
from strandline.operators import evaluation as E
from strandline.operators import kernels as K
from strandline.operators import refinement as N
from strandline.operators import relations as R
from strandline.operators import segmentation as G
from strandline.operators import summary as M
from strandline.operators import support_vectors as V
from strandline.plans.bindings import relation, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_relations(sql)
        return f

    return keep


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- summary -------------------------------------------------------------------------------------

_STATS = """
select {g} count(num_samples) as n, cast(sum(num_samples) as bigint) as total, min(num_samples) as least, max(num_samples) as most, round(avg(num_samples), 6) as mean,
  cast(floor(quantile_cont(num_samples, 0.5)) as bigint) as median,
  (select max(v) from (select num_samples as v, sum(num_samples) over (order by num_samples desc rows unbounded preceding) as run, sum(num_samples) over () as t from <reads> i {w}) where run >= t // 2) as n50
from <reads> o {by}"""


@query(_STATS.format(g="o.end_reason,", w="where i.end_reason = o.end_reason", by="group by o.end_reason"))
def summary_stats(spark, sf):
    return _rounded(M.statistics(relation(spark, sf, "reads"), "num_samples", ["end_reason"]))


@query(_STATS.format(g="", w="", by=""))
def summary_all(spark, sf):
    return _rounded(M.statistics(relation(spark, sf, "reads"), "num_samples"))


@query("""select channel % 10 as block, max(num_samples) as n50 from (select channel, num_samples, sum(num_samples) over (partition by channel % 10 order by num_samples desc rows unbounded preceding) as run,
  sum(num_samples) over (partition by channel % 10) as t from <reads>) where run >= t // 2 group by 1""")
def n50_by_group(spark, sf):
    return M.n50(relation(spark, sf, "reads").withColumn("block", F.col("channel") % 10), "num_samples", ["block"])


@query("""select active, largest, total, active * 100.0 / total as active_percent from (select *, cast(case when largest <= 512 then 512 when largest <= 2675 then 2675 when largest <= 3000 then 3000 else largest end as bigint) as total
  from (select count(distinct channel) as active, cast(max(channel) as bigint) as largest from <reads>))""")
def channel_activity(spark, sf):
    return M.channel_activity(relation(spark, sf, "reads"))


@query("select end_reason, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from <reads> group by end_reason")
def end_reason_histogram(spark, sf):
    return _rounded(M.histogram(relation(spark, sf, "reads"), "end_reason"))


@query("select end_reason, count(*) as n from <reads> group by end_reason order by n desc, end_reason limit 4")
def top_end_reasons(spark, sf):
    return M.top_values(relation(spark, sf, "reads"), "end_reason")


@query("""select bucket, n, cast(floor(n * 1.0 / max(n) over () * 7 + 0.5) as bigint) as height from (
  select range as bucket, (select count(*) from <reads>, (select min(num_samples) as lo, greatest(max(num_samples) - min(num_samples), 1) as r from <reads>) where cast(floor((num_samples - lo) / r * 39 + 0.5) as bigint) = range) as n from range(40))""")
def length_histogram(spark, sf):
    return M.length_histogram(relation(spark, sf, "reads"), "num_samples", 40)


@query("select source_file, count(*) as reads, count(distinct batch_idx) as batches, cast(sum(num_samples) as bigint) as samples from <reads> group by source_file")
def file_summary(spark, sf):
    return relation(spark, sf, "reads").groupBy("source_file").agg(F.count("*").alias("reads"), F.count_distinct("batch_idx").alias("batches"), F.sum("num_samples").alias("samples"))


# --- projection, filters, joins ------------------------------------------------------------------


@query("select cast(read_id as varchar) as read_id, cast(channel as varchar) as channel, end_reason, cast(num_samples as varchar) as num_samples, printf('%.2f', median_before) as median_before from <reads>")
def view_projection(spark, sf):
    return R.view(relation(spark, sf, "reads"), R.resolve_fields(include=["read_id", "channel", "end_reason", "num_samples", "median_before"]))


@query("select read_id, channel, num_samples from <reads> where num_samples >= 50000 and num_samples <= 150000 and end_reason in ('signal_positive', 'mux_change')")
def filter_criteria(spark, sf):
    return R.filter_reads(relation(spark, sf, "reads"), min_samples=50_000, max_samples=150_000, end_reasons=["signal_positive", "mux_change"]).select("read_id", "channel", "num_samples")


@query("select read_id, 'unknown' as reason from <reads> where end_reason = 'not specified'")
def filter_unknown_end_reason(spark, sf):
    return R.filter_reads(relation(spark, sf, "reads"), end_reasons=["unknown"]).select("read_id", S.end_reason(F.col("end_reason")).alias("reason"))


@query("select read_id, end_reason from <reads> where end_reason not in ('signal_positive', 'signal_negative')")
def filter_not_end_reason(spark, sf):
    return R.filter_reads(relation(spark, sf, "reads"), not_end_reasons=["signal_positive", "signal_negative"]).select("read_id", "end_reason")


@query("select read_id, num_samples from <reads> where read_id in (select read_id from <signal> where samples > 45)")
def filter_ids_semi(spark, sf):
    ids = relation(spark, sf, "signal").where("samples > 45")
    return R.filter_reads(relation(spark, sf, "reads"), ids=ids).select("read_id", "num_samples")


@query("select distinct read_id + 7 as read_id from <signal> where read_id + 7 not in (select read_id from <reads>)")
def missing_ids_anti(spark, sf):
    return R.missing_ids(relation(spark, sf, "signal").select((F.col("read_id") + 7).alias("read_id")), relation(spark, sf, "reads"))


@query("select r.read_id, barcode, pore_type from <reads> r join (select read_id, nullif(barcode, '') as barcode from <labels>) l on r.read_id = l.read_id where barcode in ('BC01', 'BC02') and pore_type in ('O', 'F')")
def annotation_any_all(spark, sf):
    labelled = R.annotate(relation(spark, sf, "reads"), relation(spark, sf, "labels"), "barcode")
    return R.with_labels(labelled, {"barcode": ["BC01", "BC02"], "pore_type": ["O", "F"]}).select("read_id", "barcode", "pore_type")


@query("select r.read_id, nullif(barcode, '') as barcode from <reads> r left join <labels> l on r.read_id = l.read_id")
def annotate_left(spark, sf):
    return R.annotate(relation(spark, sf, "reads"), relation(spark, sf, "labels"), "barcode").select("read_id", "barcode")


@query("select read_id, r.well, nullif(condition, '') as condition, nullif(replicate, '') as replicate from <reads> r left join <design> d on r.well = d.well")
def design_derive(spark, sf):
    design = relation(spark, sf, "design")
    R.check_design(design, ["well"])
    return R.derive_design(relation(spark, sf, "reads"), design, ["well"]).select("read_id", "well", "condition", "replicate")


@query("select read_id, barcode, num_samples from <reads> join (select read_id, barcode from <labels> where barcode <> '') using (read_id)")
def subset_groups(spark, sf):
    return R.route(relation(spark, sf, "reads"), relation(spark, sf, "labels"), "barcode").select("read_id", "barcode", "num_samples")


@query("select coalesce(nullif(barcode, ''), 'unclassified') as barcode, count(*) as reads, cast(sum(num_samples) as bigint) as samples from <reads> r left join <labels> l on r.read_id = l.read_id group by 1")
def split_unclassified(spark, sf):
    routed = R.route(relation(spark, sf, "reads"), relation(spark, sf, "labels"), "barcode", unclassified="unclassified")
    return routed.groupBy("barcode").agg(F.count("*").alias("reads"), F.sum("num_samples").alias("samples"))


def _two_inputs(spark, sf):
    reads = relation(spark, sf, "reads").select("read_id", "num_samples", "source_file", "batch_idx", "row_idx")
    second = reads.where("read_id % 3 = 0").withColumn("num_samples", -F.col("num_samples"))
    return [reads.where("read_id % 2 = 0"), second]


@query("select read_id, num_samples from <reads> where read_id % 2 = 0 union all select read_id, -num_samples from <reads> where read_id % 3 = 0 and read_id % 2 <> 0")
def merge_first_wins(spark, sf):
    return R.merge(_two_inputs(spark, sf)).select("read_id", "num_samples")


@query("select read_id, num_samples from <reads> where read_id % 2 = 0 union all select read_id, -num_samples from <reads> where read_id % 3 = 0")
def merge_keep_duplicates(spark, sf):
    return R.merge(_two_inputs(spark, sf), keep_duplicates=True).select("read_id", "num_samples")


@query("""select read_id, acquisition_id, new_index from <reads> join (select acquisition_id, cast(row_number() over (order by m, acquisition_id) - 1 as int) as new_index
  from (select acquisition_id, min(run_info) as m from <reads> group by acquisition_id)) using (acquisition_id)""")
def run_info_remap(spark, sf):
    reads = relation(spark, sf, "reads")
    return R.remap_run_info(reads.drop("run_info"), reads.select("acquisition_id", "run_info").distinct()).select("read_id", "acquisition_id", "new_index")


@query("select read_id, max_by(samples, chunk_idx) as samples from <signal> group by read_id")
def mapping_last_wins(spark, sf):
    return R.last_wins(relation(spark, sf, "signal"), "read_id", "samples", ["chunk_idx"])


@query("select read_id, mapq, ord, start from (select *, row_number() over (partition by read_id order by coalesce(mapq, 255) desc, ord) as r from <alignments>) where r = 1")
def best_alignment(spark, sf):
    return R.best_alignment(relation(spark, sf, "alignments").select("read_id", "mapq", "ord", "start").distinct()).select("read_id", "mapq", "ord", "start")


@query("select read_id, ord from <alignments> where mapped and mapq >= 30")
def mapped_quality(spark, sf):
    return relation(spark, sf, "alignments").where(R.include_alignment(30, mapped_only=True)).select("read_id", "ord")


@query("select read_id, start, end_pos from <alignments> where start <= 900 and end_pos >= 700")
def region_overlap(spark, sf):
    return relation(spark, sf, "alignments").withColumnRenamed("end_pos", "end").where(R.in_region(700, 900)).select("read_id", "start", F.col("end").alias("end_pos"))


@query("""select coalesce(case when not mapped then 'unmapped' when reverse then 'reverse' when secondary then 'secondary' when supplementary then 'supplementary'
  when coalesce(mapq, 255) < 20 then 'low_mapq' end, 'scanned') as reason, count(*) as n from <alignments> group by 1""")
def skip_reasons(spark, sf):
    return relation(spark, sf, "alignments").groupBy(F.coalesce(R.skip_reason(20), F.lit("scanned")).alias("reason")).agg(F.count("*").alias("n"))


@query("select n, round(s, 6) as share_reversed, case when n < 50 then 'too_few' when s < 0.05 then 'forward' when s > 0.95 then 'reversed' else 'mixed' end as decision from (select count(*) as n, avg(cast(reverse as int)) as s from <alignments>)")
def orientation_vote(spark, sf):
    return _rounded(R.orientation(relation(spark, sf, "alignments").select(F.col("reverse").alias("reversed"))))


@query("select read_id, start_sample, num_samples, cast(sum(num_samples) over (partition by source_file order by batch_idx, row_idx rows unbounded preceding) - num_samples as bigint) as first_row from <reads>")
def signal_row_offsets(spark, sf):
    return R.batched_offsets(relation(spark, sf, "reads"), "source_file", "batch_idx", ["row_idx"], "num_samples", "first_row").select("read_id", "start_sample", "num_samples", "first_row")


@query("select read_id, chunk_idx, cast(least(samples, 60 - before) as bigint) as take from (select *, sum(samples) over (partition by read_id order by chunk_idx rows unbounded preceding) - samples as before from <signal>) where before < 60")
def signal_prefix_chunks(spark, sf):
    return R.chunks_for_prefix(relation(spark, sf, "signal"), 60).select("read_id", "chunk_idx", "take")


@query("""select source_file, min(case when rows <> f and batch_idx < l and n >= 3 then batch_idx end) as nonuniform_batch from (
  select source_file, batch_idx, rows, first_value(rows) over (partition by source_file order by batch_idx) as f, max(batch_idx) over (partition by source_file) as l, count(*) over (partition by source_file) as n
  from (select source_file, batch_idx, count(*) + batch_idx // 5 as rows from <reads> group by source_file, batch_idx)) group by source_file""")
def nonuniform_batches(spark, sf):
    batches = relation(spark, sf, "reads").groupBy("source_file", "batch_idx").agg(F.count("*").alias("c")).select("source_file", "batch_idx", F.expr("c + batch_idx div 5").alias("rows"))
    return R.nonuniform_batches(batches)


# --- arrays --------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return relation(spark, sf, "vectors").select("id", A.doubles(F.col("x")).alias("x"), "label")


_CELLS = "(select id, label, p, cast(x[p] as double) as v from (select id, label, x, unnest(range(1, len(x) + 1)) as p from <vectors>))"


def _exploded(df: DataFrame) -> DataFrame:
    # Outer, and its nulls dropped: before a plain one Spark tests the array's size, for which it makes the array twice.
    return _rounded(df.select("id", F.posexplode_outer("y").alias("p", "y")).where("p is not null").select("id", (F.col("p") + 1).cast("long").alias("p"), "y"))


@query(f"select id, round(median(v), 6) as median, round(mad(v), 6) as mad from {_CELLS} group by id")
def median_mad(spark, sf):
    return _rounded(_vectors(spark, sf).select("id", A.median(F.col("x")).alias("median"), A.mad(F.col("x")).alias("mad")))


@query(f"select id, p, round((v - m) / d, 6) as y from {_CELLS} join (select id, median(v) as m, mad(v) as d from {_CELLS} group by id) using (id)")
def mad_normalise(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.mad_normalise(F.col("x")).alias("y")))


@query(f"select id, p, round((v - m) / (1.4826 * d), 6) as y from {_CELLS} join (select id, median(v) as m, mad(v) as d from {_CELLS} group by id) using (id)")
def mad_normalise_robust(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.mad_normalise_robust(F.col("x")).alias("y")))


@query(f"select id, p, round(least(greatest(v, m - 2.0 * d), m + 2.0 * d), 6) as y from {_CELLS} join (select id, median(v) as m, mad(v) as d from {_CELLS} group by id) using (id)")
def clip_outliers(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.clip_outliers(F.col("x"), 2.0).alias("y")))


@query(f"select id, p, round((v - m) / d, 6) as y from {_CELLS} join (select id, avg(v) as m, stddev_pop(v) as d from {_CELLS} group by id) using (id)")
def z_score(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.z_score(F.col("x")).alias("y")))


@query(f"select id, p, round((v - m) / (d - m), 6) as y from {_CELLS} join (select id, min(v) as m, max(v) as d from {_CELLS} group by id) using (id)")
def min_max(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.min_max(F.col("x")).alias("y")))


@query(f"select id, p, round((w - m) / d, 6) as y from (select id, p, ln(greatest(abs(v) * 100, 1)) as w from {_CELLS}) join (select id, avg(w) as m, stddev_pop(w) as d from (select id, ln(greatest(abs(v) * 100, 1)) as w from {_CELLS}) group by id) using (id)")
def dwell_log_z(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.dwell_log_z(F.transform("x", lambda v: F.abs(v) * 100)).alias("y")))


@query(f"select id, (p - 1) // 10 + 1 as p, round(avg(v), 6) as y from {_CELLS} group by id, (p - 1) // 10")
def mean_pool_keep_tail(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.mean_pool(F.col("x"), 10).alias("y")))


@query(f"select id, (p - 1) // 10 + 1 as p, round(avg(v), 6) as y from {_CELLS} where p <= 60 group by id, (p - 1) // 10")
def mean_pool_drop_tail(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.mean_pool(F.col("x"), 10, "drop").alias("y")))


@query(f"select id, (p - 1) // 10 + 1 as p, round(sum(v) / 10, 6) as y from {_CELLS} group by id, (p - 1) // 10")
def mean_pool_full_tail(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.mean_pool(F.col("x"), 10, "full").alias("y")))


@query(f"select id, p, round((v + label) * 0.15, 6) as y from {_CELLS}")
def calibrate_current(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", A.calibrate(F.col("x"), F.col("label"), F.lit(0.15)).alias("y")))


@query(f"""select id, round(max(q), 6) as best, round(max(q) - max(case when r = 2 then q end), 6) as margin from (select id, q, row_number() over (partition by id order by q desc) as r from (
  select id, exp(v) / sum(exp(v)) over (partition by id) as q from {_CELLS})) group by id""")
def softmax_margin(spark, sf):
    p = _vectors(spark, sf).select("id", A.softmax(F.col("x")).alias("p"))
    return _rounded(p.select("id", F.array_max("p").alias("best"), A.top_two_margin(F.col("p")).alias("margin")))


@query("select id, (cast(b_s.a as bigint)) as start, dwell, round(m, 6) as mean, round(s, 6) as sd from (select id, a, 16.0::double as dwell, avg(v) as m, stddev_pop(v) as s from " + _CELLS + ", (select unnest([0, 16, 32, 48]) as a) where p > a and p <= a + 16 group by id, a) b_s")
def span_statistics(spark, sf):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 16).alias("end")) for a in (0, 16, 32, 48)])
    found = _vectors(spark, sf).select("id", F.posexplode(A.span_stats(F.col("x"), spans)).alias("k", "s"))
    return _rounded(found.select("id", (F.col("k") * 16).cast("long").alias("start"), "s.dwell", "s.mean", "s.sd"))


@query(f"select id, round(quantile_cont(v, 0.1), 6) as q10, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.9), 6) as q90 from {_CELLS} group by id")
def array_quantiles(spark, sf):
    q = _vectors(spark, sf).select("id", A.quantiles(F.col("x"), [0.1, 0.5, 0.9]).alias("q"))
    return _rounded(q.select("id", F.get("q", F.lit(0)).alias("q10"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q90")))


@query(f"select id, round(regr_slope(v, p), 6) as slope, round(regr_intercept(v, p), 6) as intercept from {_CELLS} group by id")
def least_squares_fit(spark, sf):
    cells = _vectors(spark, sf).select("id", F.posexplode("x").alias("p", "v")).withColumn("p", F.col("p") + 1)
    return _rounded(cells.groupBy("id").agg(F.regr_slope("v", "p").alias("slope"), F.regr_intercept("v", "p").alias("intercept")))


@query(f"select id, round(median((b.v - a.v) / (b.p - a.p)), 6) as slope from {_CELLS} a join {_CELLS} b using (id) where a.p < b.p and b.p <= 24 group by id")
def theil_sen_slope(spark, sf):
    return _rounded(_vectors(spark, sf).select("id", P.median_slope(F.slice("x", 1, 24)).alias("slope")))


_CONSENSUS = f"select label as barcode, p - 1 as position, median(v) as consensus, count(*) as n from {_CELLS} group by label, p"


@query(f"select barcode, cast(position as int) as position, round(any_value(consensus), 6) as consensus, round(sqrt(avg(pow(v - consensus, 2))), 6) as sd, count(*) as n from ({_CONSENSUS}) m join {_CELLS} c on m.barcode = c.label and m.position = c.p - 1 group by barcode, position")
def consensus_fingerprint(spark, sf):
    return _rounded(M.consensus(_vectors(spark, sf).select(F.col("label").alias("barcode"), F.col("x").alias("values"))))


_MEANS = f"(select label as ref, p, avg(v) as m from {_CELLS} group by label, p)"


@query(f"""select id, ref as best, round(d, 5) as distance, round(exp(-0.5 * d * d), 5) as kernel from (select *, row_number() over (partition by id order by d, ref) as r from (
  select id, ref, sqrt(sum((v - m) * (v - m))) as d from {_CELLS} join {_MEANS} using (p) group by id, ref)) where r = 1""")
def nearest_reference_rbf(spark, sf):
    vectors = _vectors(spark, sf)
    cells = vectors.select(F.col("label").alias("ref"), F.posexplode("x").alias("p", "v")).groupBy("ref", "p").agg(F.avg("v").alias("m"))
    bank = cells.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda c: c["m"]).alias("y"))  # a row per class
    scored = V.distances_to(vectors, bank.select(F.col("ref").cast("long").alias("support_id"), F.col("y").alias("x")), window=0)  # no warping
    best = scored.groupBy("id").agg(F.min(F.struct("distance", "support_id")).alias("b"))
    near = best.select("id", F.col("b.support_id").cast("int").alias("best"), F.col("b.distance").alias("distance"))
    return _rounded(near.withColumn("kernel", A.rbf(F.col("distance"), 0.5)), 5)


@query(f"""select id, label, sum(case when d > 0 then 1 else 0 end) as votes from (select a.id, a.p as label, a.v - b.v as d from {_CELLS} a join {_CELLS} b on a.id = b.id and a.p <> b.p where a.p <= 5 and b.p <= 5) where d > 0 or (d = 0) group by id, label having votes > 0""")
def one_vs_one_votes(spark, sf):
    cells = _vectors(spark, sf).select("id", F.posexplode(F.slice("x", 1, 5)).alias("p", "v")).withColumn("p", (F.col("p") + 1).cast("long"))
    other = cells.select("id", F.col("p").alias("j"), F.col("v").alias("w"))
    pairs = cells.join(other, "id").where("p < j").select("id", F.col("p").alias("i"), "j", (F.col("v") - F.col("w")).alias("decision"))
    return E.ovo_votes(pairs)


# --- segmentation --------------------------------------------------------------------------------

_TTEST = """select id, i, case when spread > 1e-9 then round(abs(m1 - m2) / sqrt(spread), 5) else 0 end as score from (select id, i, m1, m2, q1 - 5 * m1 * m1 + q2 - 5 * m2 * m2 as spread, n, a from (
  select id, i, avg(v) over (partition by id order by i rows between current row and 4 following) as m1, avg(v) over (partition by id order by i rows between 5 following and 9 following) as m2,
  sum(v * v) over (partition by id order by i rows between current row and 4 following) as q1, sum(v * v) over (partition by id order by i rows between 5 following and 9 following) as q2,
  count(v) over (partition by id order by i rows between 5 following and 9 following) as n, count(v) over (partition by id order by i rows between 10 following and 10 following) as a from <samples>)) where n = 5 and a = 1"""


@query(_TTEST)
def windowed_ttest(spark, sf):
    return _rounded(G.windowed_ttest(relation(spark, sf, "samples"), 5), 5)


@query("""select id, (a + b) // 2 as i, v from (select id, r, min(i) as a, max(i) as b, any_value(v) as v, lag(any_value(v)) over (partition by id order by r) as l, lead(any_value(v)) over (partition by id order by r) as n from (
  select id, i, v, sum(s) over (partition by id order by i) as r from (select id, i, v, case when lag(v) over (partition by id order by i) = v then 0 else 1 end as s from <samples>)) group by id, r) where l < v and n < v""")
def local_maxima(spark, sf):
    return G.local_maxima(relation(spark, sf, "samples"))


@query("select id, min(i) as start, max(i) + 1 as \"end\", round(avg(v), 6) as mean from (select id, i, v, sum(case when v > 60 then 1 else 0 end) over (partition by id order by i) as g from <samples>) group by id, g")
def segment_means(spark, sf):
    samples = relation(spark, sf, "samples")
    return _rounded(G.segment_means(samples, samples.where("v > 60").select("id", "i")))


@query("""select id, i, gain from (select id, i, gain, row_number() over (partition by id order by gain desc, i) as r from (select id, i, round(n * ln(vf) - i * ln(vh) - (n - i) * ln(vt), 6) as gain from (
  select id, i, n, t2 / n - (t / n) ** 2 as vf, q / i - (s / i) ** 2 as vh, (t2 - q) / (n - i) - ((t - s) / (n - i)) ** 2 as vt from (
  select id, i, count(*) over w as n, sum(v) over w as t, sum(v * v) over w as t2, sum(v) over (partition by id order by i rows between unbounded preceding and 1 preceding) as s,
  sum(v * v) over (partition by id order by i rows between unbounded preceding and 1 preceding) as q from <samples> window w as (partition by id)) where i >= 5 and i < n - 5) where vf > 1e-12 and vh > 1e-12 and vt > 1e-12) where gain > 0) where r = 1""")
def likelihood_best_split(spark, sf):
    return G.best_split(relation(spark, sf, "samples"), 5, 5)


@query("select id, i, max(lo) over (partition by id order by i) as low, min(lo + 40) over (partition by id order by i rows between current row and unbounded following) as high from (select id, i, i * 3 + (i * 7919) % 11 as lo from <samples>)")
def monotone_band(spark, sf):
    lo = relation(spark, sf, "samples").select("id", "i", (F.col("i") * 3 + (F.col("i") * 7919) % 11).alias("lo")).withColumn("hi", F.col("lo") + 40)
    return G.running_band(lo)


# --- sequences -----------------------------------------------------------------------------------


@query("select c_custkey as id, lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))) as uuid from (select c_custkey, md5(c_name) as h from customer)")
def uuid_normalise(spark, sf):
    hexes = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("h"))
    return hexes.select("id", S.normalise_uuid(F.when(F.col("id") % 2 == 0, F.upper("h")).otherwise(F.col("h"))).alias("uuid"))


@query("""select id, r.r_name as best, d as best_distance, d2 as second_distance, d2 - d as margin from (select id, arg_min(o, d * 1000 + o) as o, min(d) as d, list_sort(list(d))[2] as d2 from (
  select c_custkey as id, r_regionkey as o, levenshtein(upper(c_mktsegment), r_name) as d from customer, region) group by id) x join region r on r.r_regionkey = x.o""")
def edit_distance_top2(spark, sf):
    queries = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("sequence"))
    panel = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_name").alias("ref_sequence"), F.col("r_regionkey").alias("ord"))
    return S.nearest_barcodes(queries, panel)


@query("select min(levenshtein(a.n_name, b.n_name)) as least_distance from nation a, nation b where a.n_nationkey < b.n_nationkey")
def panel_distance(spark, sf):
    return S.least_pairwise_distance(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("ref_sequence"), F.col("n_nationkey").alias("ord")))


_BASES = "translate(substr(md5(cast(c_custkey as varchar)), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""select id, p as position, case when p >= 2 and p + 1 <= 24 then cast(strpos('ACGT', substr(s, p - 1, 1)) - 1 as bigint) * 16 + (strpos('ACGT', substr(s, p, 1)) - 1) * 4 + strpos('ACGT', substr(s, p + 1, 1)) - 1 else 0 end / 64.0::double as level
  from (select c_custkey as id, {_BASES} as s, unnest(range(1, 25)) as p from customer)""")
def kmer_levels(spark, sf):
    made = F.translate(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")
    sequences = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), made.alias("sequence"))
    letters = F.array(*map(F.lit, "ACGT"))
    kmer = F.concat(*[F.get(letters, F.shiftright("id", n).bitwiseAND(F.lit(3)).cast("int")) for n in (4, 2, 0)])
    table = spark.range(64).select(kmer.alias("kmer"), (S.encode_kmer(kmer) / F.lit(64.0)).alias("level"))
    found = S.kmer_levels(sequences, table, 3)
    return found.select("id", F.posexplode("levels").alias("position", "level")).withColumn("position", (F.col("position") + 1).cast("long"))


@query(f"""select id, motif - 1 as motif_start, arm - 1 as arm_start, length(s) - length(rtrim(s, 'A')) as tail from (select c_custkey as id, {_BASES} as s, strpos({_BASES}, 'CC') as motif, strpos({_BASES}, 'GT') as arm from customer)
  where len(regexp_extract_all(s, 'CC')) = 1 and arm > motif""")
def junction_geometry(spark, sf):
    made = F.translate(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")
    found = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), S.junction(made, "CC", "GT").alias("j")).where("j is not null")
    return found.select("id", *[F.col(f"j.{c}").cast("long").alias(c) for c in ("motif_start", "arm_start", "tail")])


# --- evaluation ----------------------------------------------------------------------------------


@query("""select count(*) as n, round(sum(case when reference = ours then 1 else 0 end) * 100.0 / count(*), 6) as percent, sum(case when confidence >= 0.5 then 1 else 0 end)::bigint as n_sure,
  round(sum(case when confidence >= 0.5 and reference = ours then 1 else 0 end) * 100.0 / sum(case when confidence >= 0.5 then 1 else 0 end), 6) as percent_sure from <calls>""")
def agreement_summary(spark, sf):
    return _rounded(E.agreement(relation(spark, sf, "calls")))


@query("select reference, ours, count(*) as n from <calls> group by reference, ours")
def confusion_matrix(spark, sf):
    return E.confusion(relation(spark, sf, "calls"))


@query("""select label, round(h / c, 6) as precision, round(h / s, 6) as recall, round(2.0 * h / (c + s), 6) as f1, s as support from (select label, count(*) filter (ours = label and reference = label) as h, count(*) filter (ours = label) as c,
  count(*) filter (reference = label) as s from <calls>, (select distinct reference as label from <calls>) group by label)""")
def precision_recall(spark, sf):
    return _rounded(E.per_class(relation(spark, sf, "calls")))


@query("select round(corr(confidence, our_confidence), 6) as correlation, count(*) as n from <calls>")
def confidence_correlation(spark, sf):
    return _rounded(E.confidence_correlation(relation(spark, sf, "calls")))


@query("""select cast(bin as int) as bin, count(*) as n, round(avg(case when reference = ours then 1 else 0 end) * 100, 6) as percent from (select *, case when confidence >= 0 and confidence < 0.5 then 0 when confidence >= 0.5 and confidence < 0.8 then 1
  when confidence >= 0.8 and confidence < 0.95 then 2 when confidence >= 0.95 and confidence < 1.01 then 3 end as bin from <calls>) where bin is not null group by bin""")
def agreement_by_bin(spark, sf):
    return _rounded(E.agreement_by_bin(relation(spark, sf, "calls")))


@query("select count(*) as n, round(avg(difference), 6) as mean, round(avg(abs(difference)), 6) as mean_abs, list_sort(list(abs(difference)))[count(*) // 2 + 1] as median_abs, list_sort(list(abs(difference)))[cast(floor(count(*) * 0.95) as bigint) + 1] as p95_abs from <calls>")
def boundary_differences(spark, sf):
    return _rounded(E.boundary_differences(relation(spark, sf, "calls")))


# --- kernels (no SQL form) -----------------------------------------------------------------------


@query()
def reservoir_per_label(spark, sf):
    return M.reservoir(_vectors(spark, sf), "label", "id", 10).select("id", "label")


_CUTS = f"""with t as (
  select id, p - 1 as i, avg(v) over a as m1, avg(v) over b as m2, sum(v * v) over a as q1, sum(v * v) over b as q2 from {_CELLS}
  window a as (partition by id order by p rows between current row and 3 following), b as (partition by id order by p rows between 4 following and 7 following)
), sc as (
  select id, i, case when q1 - 4 * m1 * m1 + q2 - 4 * m2 * m2 > 1e-9 then abs(m1 - m2) / sqrt(q1 - 4 * m1 * m1 + q2 - 4 * m2 * m2) else 0 end as s from t where i < 56
), peaks as (
  select id, list(i order by s desc, i) as ps from (select *, lag(s) over w as a, lead(s) over w as b from sc window w as (partition by id order by i)) where s > a and s > b group by id
), cut as (
  select id, list_sort(list_transform(list_reduce(list_transform(ps, lambda p: [p]), lambda acc, p: case when len(acc) < {{count}} and len(list_filter(acc, lambda a: abs(a - p[1]) < 4)) = 0 then list_concat(acc, p) else acc end), lambda p: p + 4)) as cuts from peaks
)"""


@query(_CUTS.format(count=6) + "select id, array_to_string(cuts, ',') as cuts from cut")
def change_points(spark, sf):
    samples = _vectors(spark, sf).select("id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    return G.change_points(samples, 4, 6, 4).select("id", F.array_join("cuts", ",").alias("cuts"))


@query(_CUTS.format(count=4) + f""", parts as (
  select id, k, avg((v - m) / d) as y from (select id, p, v, len(list_filter(cuts, lambda c: c < p)) as k from {_CELLS} join cut using (id)) join (select id, median(v) as m, mad(v) as d from {_CELLS} group by id) using (id) group by id, k
) select id, label, cast(k + 1 as bigint) as p, round(y, 6) as y from parts join <vectors> using (id) where id in (select id from parts where k = 4)""")
def fingerprints(spark, sf):
    made = G.fingerprints(_vectors(spark, sf), 5, 4).join(_vectors(spark, sf).select("id", "label"), "id").where("values is not null")
    return _rounded(made.select("id", "label", F.posexplode("values").alias("p", "y")).withColumn("p", (F.col("p") + 1).cast("long")))


@query()
def adapter_bounds(spark, sf):
    found = _vectors(spark, sf).select("id", D.adapter(F.col("x"), 8, 3).alias("b"))
    return found.select("id", "b.start", "b.end")


def _bank(spark, sf, per_label: int = 3):
    """Reference fingerprints: a fixed number per class, so the bank's size does not follow the input."""
    rows = M.reservoir(_vectors(spark, sf), "label", "id", per_label).select("label", "x").orderBy("label", "id").collect()
    import numpy as np

    return np.array([r.x for r in rows]), [r.label for r in rows]


@query()
def dtw_nearest(spark, sf):
    bank, labels = _bank(spark, sf)
    kind = "struct<label:int,distance:double,second:double,ratio:double,confident:boolean>"
    return _vectors(spark, sf).select("id", K.batched(lambda rows: K.nearest_of(rows, bank, labels, 8, 0.1), kind)("x").alias("c")).select("id", "c.*")


@query()
def kernel_classify(spark, sf):
    import numpy as np

    bank, labels = _bank(spark, sf)
    names = sorted(set(labels))
    index = np.array([names.index(x) for x in labels])

    def classify(distances):
        means = K.class_means_of_kernel(distances, index, 0.5, len(names)) + 1e-9
        p = K.couple(means[:, None] / (means[:, None] + means[None, :]))
        return {"label": names[int(p.argmax())], "probability": float(p.max())}

    calls = K.batched(lambda rows: [classify(d) for d in K.dtw_rows(rows, bank, 8, 0.0)], "struct<label:int,probability:double>")
    return _vectors(spark, sf).select("id", calls("x").alias("c")).select("id", "c.*")


@query(f"""with raw as (select id, (p - 1) % 3 as k, sum(case when v <= 0 then 0.5 else -0.5 end) as r from {_CELLS} where p <= 12 group by id, (p - 1) % 3)
  select id, cast(k + 1 as bigint) as p, round(exp(r) / sum(exp(r)) over (partition by id), 6) as y from raw""")
def tree_ensemble(spark, sf):
    stump = lambda f, t, c, s: {"feature": [f, -1, -1], "threshold": [t, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, s, -s], "missing_left": [True] * 3, "class": c}
    forest = [stump(f, 0.0, f % 3, 0.5) for f in range(12)]
    return _exploded(_vectors(spark, sf).select("id", P.trees(F.col("x"), forest, [0.0] * 3).alias("y")))


@query()
def banded_alignment(spark, sf):
    def align(x):
        import numpy as np

        guess = np.linspace(0, len(x), 9).astype(int)
        return K.banded_path(x, [float(np.mean(x[a:b])) for a, b in zip(guess, guess[1:])], *K.half_band(guess, 2, len(x)))

    return _vectors(spark, sf).select("id", K.column(align, "array<bigint>")("x").alias("boundaries"))


@query()
def lattice_decode(spark, sf):
    return _vectors(spark, sf).select("id", K.column(lambda x: K.lattice_decode([[[x[(4 * t + s + k) % len(x)] for k in range(5)] for s in range(4)] for t in range(len(x) // 4)], 4, 1), "string")("x").alias("sequence"))


@query("select id, len(x) as n, true as equal from <vectors>")
def codec_round_trip(spark, sf):
    pack = K.column(lambda x: K.compress_signal([round(v * 1000) for v in x]), "binary")
    unpack = K.column(lambda d, n: K.decompress_signal(d, int(n)).tolist(), "array<bigint>")
    packed = _vectors(spark, sf).select("id", F.transform("x", lambda v: F.rint(v * 1000).cast("long")).alias("adc"), pack("x").alias("data"), F.size("x").cast("long").alias("n"))
    return packed.select("id", "n", (unpack("data", "n") == F.col("adc")).alias("equal"))


@query()
def refined_maps(spark, sf):
    def refine(x):
        import numpy as np

        guess = np.linspace(0, len(x), 9).astype(int)
        return N.refine_map(x, guess, [float(np.mean(x[a:b])) * 2 + 1 for a, b in zip(guess, guess[1:])], half=2)

    return _vectors(spark, sf).select("id", K.column(refine, "array<bigint>")("x").alias("boundaries"))


@query()
def reference_scores(spark, sf):
    """16 steps of a lattice of four states from each vector, against a panel with common prefixes."""
    shaped = F.transform(F.sequence(F.lit(0), F.lit(16 * 4 * 5 - 1)), lambda i: F.get("x", (F.floor(i / 20) * 4 + F.floor(i % 20 / 5) + i % 5).cast("int") % F.size("x")))
    return _rounded(B.score_panel(_vectors(spark, sf).select("id", shaped.alias("scores")), ["ACGT", "ACTT", "TTAC", "GGCA"], 4, 1).select("id", F.transform("log_p", lambda v: F.round(v, 6)).alias("log_p")))


@query(f"select id, p, round((v - m) / d, 6) as y from {_CELLS} join (select id, avg(v) as m, stddev_pop(v) as d from {_CELLS} group by id) using (id)")
def folded_features(spark, sf):
    return _exploded(_vectors(spark, sf).select("id", P.normalise_fingerprint(F.col("x"), "z_score").alias("y")))


@query(f"select id, list(v order by p) as w from {_CELLS} where p > 10 and p <= 20 group by id")
def signal_windows(spark, sf):
    return _vectors(spark, sf).select("id", P.signal_window(F.col("x"), 15, 5, 5).alias("w"))


@query(f"select id, case when m >= 0.02 then c else -1 end as call from (select id, max(q) - max(case when r = 2 then q end) as m, max(case when r = 1 then p end) - 1 as c from (select id, p, q, row_number() over (partition by id order by q desc, p desc) as r from (select id, p, exp(v) / sum(exp(v)) over (partition by id) as q from {_CELLS} where p <= 8)) group by id)")
def gated_calls(spark, sf):
    p = _vectors(spark, sf).select("id", A.softmax(F.slice("x", 1, 8)).alias("p"))
    return p.select("id", A.gated_call(F.col("p"), [0.02] * 8).alias("call"))


# --- whole arrays and tables: the queries of the same names without _whole read a part, which their SQL fixes ---


@query(f"select id, round(median((b.v - a.v) / (b.p - a.p)), 6) as slope from {_CELLS} a join {_CELLS} b using (id) where a.p < b.p group by id")
def theil_sen_slope_whole(spark, sf):
    return _rounded(_vectors(spark, sf).select("id", P.median_slope(F.col("x")).alias("slope")))


@query(f"select id, label, count(*) as votes from (select a.id, case when a.v > b.v then a.p else b.p end as label from {_CELLS} a join {_CELLS} b on a.id = b.id and a.p < b.p) group by id, label")
def one_vs_one_votes_whole(spark, sf):
    return _vectors(spark, sf).select("id", F.inline(E.array_votes(F.col("x"))))


@query(f"select id, case when m >= 0.02 then c else -1 end as call from (select id, max(q) - max(case when r = 2 then q end) as m, max(case when r = 1 then p end) - 1 as c from (select id, p, q, row_number() over (partition by id order by q desc, p desc) as r from (select id, p, exp(v) / sum(exp(v)) over (partition by id) as q from {_CELLS})) group by id)")
def gated_calls_whole(spark, sf):
    p = _vectors(spark, sf).select("id", A.softmax(F.col("x")).alias("p"))
    return p.select("id", A.gated_call(F.col("p"), F.transform("p", lambda _: F.lit(0.02))).alias("call"))


def _two_whole_inputs(spark, sf):
    """All reads, and all reads with changed samples under ids moved by 7: some are new, some repeat."""
    reads = relation(spark, sf, "reads").select("read_id", "num_samples", "source_file", "batch_idx", "row_idx")
    return [reads, reads.withColumns({"read_id": F.col("read_id") + 7, "num_samples": -F.col("num_samples")})]


@query("select read_id, num_samples from <reads> union all select read_id + 7 as read_id, -num_samples from <reads> where read_id + 7 not in (select read_id from <reads>)")
def merge_first_wins_whole(spark, sf):
    return R.merge(_two_whole_inputs(spark, sf)).select("read_id", "num_samples")


@query("select read_id, num_samples from <reads> union all select read_id + 7 as read_id, -num_samples from <reads>")
def merge_keep_duplicates_whole(spark, sf):
    return R.merge(_two_whole_inputs(spark, sf), keep_duplicates=True).select("read_id", "num_samples")
