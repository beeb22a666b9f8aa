"""Queries of the classifiers, the read anchors and the searches: each over whole tables, models trained on bounded samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays as A
from strandline.functions import rescaling as S
from strandline.functions import sequences as Q
from strandline.operators import anchoring as N
from strandline.operators import batches as B
from strandline.operators import calls as C
from strandline.operators import relations as R
from strandline.operators import searches as H
from strandline.operators import segmentation as G
from strandline.operators import support_vectors as V
from strandline.plans.bindings import relation
from strandline.plans.extended import ORACLE_SQL, QUERIES
from strandline.plans.registry import _CELLS, _rounded, query

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- support vectors -----------------------------------------------------------------------------

#: The references of a model: the first of each label, by id.
_FIRST = "(select id, label from (select id, label, row_number() over (partition by label order by id) as r from <vectors>) where r <= {n})"


def _first(spark, sf, n):
    return relation(spark, sf, "vectors").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= n).drop("r")


@query(f"""with s as {_FIRST.format(n=20)}, c as (select id, p, v from {_CELLS} join s using (id))
  select x.id as a, y.id as b, round(sqrt(sum((x.v - y.v) * (x.v - y.v))), 5) as distance from c x join c y on x.p = y.p group by x.id, y.id""")
def distance_matrix(spark, sf):
    """Of the training references; a window of 0 leaves warping no choice, so SQL has the same distances."""
    return _rounded(V.distance_matrix(_first(spark, sf, 20).select("id", "x"), window=0, block=16), 5)


def _given_model(spark, sf):
    """A model whose coefficients are functions of the references' ids."""
    supports = _first(spark, sf, 3).select(F.col("id").alias("support_id"), "label", "x")
    classes = supports.select("label").distinct()
    others = classes.select(F.col("label").alias("other"))
    paired = supports.join(others, F.col("label") < F.col("other")).select(F.col("label").alias("class_i"), F.col("other").alias("class_j"), "support_id", ((1 + F.col("support_id") % 5) / 10.0).alias("coef"))
    paired = paired.unionByName(supports.join(others, F.col("label") > F.col("other")).select(F.col("other").alias("class_i"), F.col("label").alias("class_j"), "support_id", (-(1 + F.col("support_id") % 7) / 10.0).alias("coef")))
    offsets = paired.select("class_i", "class_j").distinct().select("class_i", "class_j", F.lit(None).cast("long").alias("support_id"), ((F.col("class_i") - F.col("class_j")) / 100.0).alias("coef"))
    return V.SvmModel(supports, paired.unionByName(offsets), gamma=0.5, window=0)


_KERNELS = f"""s as {_FIRST.format(n=3)}, k as (select q.id, s.id as support_id, s.label, exp(-0.5 * sum((q.v - r.v) * (q.v - r.v))) as kernel
  from {_CELLS} q join {_CELLS} r on q.p = r.p join s on s.id = r.id group by q.id, s.id, s.label)"""


@query(f"""with {_KERNELS}, w as (
  select a.label as i, b.label as j, s.id as support_id, case when s.label = a.label then (1 + s.id % 5) / 10.0 else -(1 + s.id % 7) / 10.0 end as coef
  from (select distinct label from s) a join (select distinct label from s) b on a.label < b.label join s on s.label = a.label or s.label = b.label)
  select id, i, j, round(sum(coef * kernel) + (i - j) / 100.0, 6) as decision from k join w using (support_id) group by id, i, j""")
def svm_decisions(spark, sf):
    model = _given_model(spark, sf)
    return _rounded(V.decisions(V.kernel_rows(relation(spark, sf, "vectors").select("id", "x"), model), model.coefficients))


@query(f"""with {_KERNELS}, m as (select id, label, avg(kernel) as mean from k group by id, label)
  select a.id, a.label as i, b.label as j, round(a.mean - b.mean, 6) as decision from m a join m b on a.id = b.id and a.label < b.label""")
def weighted_decisions(spark, sf):
    model = _given_model(spark, sf)
    rows = V.kernel_rows(relation(spark, sf, "vectors").select("id", "x"), model, used_only=False)
    return _rounded(V.weighted_decisions(rows, model.supports.select("support_id", "label")))


@query()
def svm_training(spark, sf):
    """Trained on at most 30 references of each label; the model's table."""
    return V.train(relation(spark, sf, "vectors"), gamma=0.5, cost=10.0, window=2, per_class=30).coefficients


@query()
def svm_classify(spark, sf):
    """All vectors called by a model trained on at most 30 of each label."""
    vectors = relation(spark, sf, "vectors")
    model = V.train(vectors, gamma=0.5, cost=10.0, window=0, per_class=30)
    return V.winners(V.decisions(V.kernel_rows(vectors.select("id", "x"), model), model.coefficients))

# --- anchors and classification ------------------------------------------------------------------

#: Where the marks lie on each reference; R has none.
_GEOMETRY = {"A": (9, 10, 16, 4, 18), "N": (11, 12, 18, 5, 20)}
_OFFSETS = [-2, -1, 0, 1, 2, 3, 4]
#: Alignments by numbers: s bases clipped, m aligned, a gap (deletion or insertion), ``tail`` aligned; a move every step but each fourth.
_LINES = """select l_orderkey * 10 + l_linenumber as read_id, l_returnflag as reference, l_linenumber <> 6 as mapped, l_linestatus = 'F' and l_linenumber = 5 as reverse, l_linenumber * 10 as mapq, l_partkey % 5 as start, l_suppkey % 3 as s,
  5 + l_linenumber as m, 1 + l_linenumber % 2 as gap, l_quantity % 2 = 0 as deletion, case when l_suppkey % 10 = 0 then 1 else 30 end as tail, l_partkey as shift, case when l_suppkey % 7 = 3 then null else 40 end as n_moves, 5 as stride, l_linenumber as ts, 205 as ns from {lineitem}"""
_ARRAYS = """select id as read_id, case id % 5 when 0 then 'R' when 1 then 'N' else 'A' end as reference, true as mapped, false as reverse, 60 as mapq, id % 5 as start, id % 3 as s,
  5 + id % 7 as m, 1 + id % 2 as gap, id % 4 < 2 as deletion, case when id % 10 = 3 then 1 else 30 end as tail, id as shift, 32 as n_moves, 2 as stride, 0 as ts, case when id % 11 = 0 then 65 else 64 end as ns from {vectors}"""


def _alignments(spark, text, **tables):
    op = lambda name, n: F.struct(F.lit(name).alias("op") if isinstance(name, str) else name.alias("op"), F.col(n).cast("long").alias("len"))
    rows = spark.sql(text, **tables)
    moves = F.when(F.col("n_moves").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("n_moves") - 1), lambda i: F.when((i + F.col("shift")) % 4 == 0, 0).otherwise(1)))
    ops = F.array(op("S", "s"), op("M", "m"), op(F.when(F.col("deletion"), "D").otherwise("I"), "gap"), op("M", "tail"))
    return rows.withColumns({"ops": ops, "moves": moves, "secondary": F.lit(False), "supplementary": F.lit(False)})


def _geometry(spark):
    rows = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in _GEOMETRY.items())
    return spark.sql(f"select * from values {rows} as g(reference, {', '.join(N.GEOMETRY)})")


def _anchor_sql(text: str) -> str:
    """The same anchors by closed forms: two aligned runs, so a position's base is one of two sums."""
    q = lambda c: f"(case when {c} >= start and {c} < start + m then s + {c} - start when {c} >= r2 and {c} < r2 + tail then q2 + {c} - r2 end)"
    up = lambda c, d: f"case when not ({c} < divergent and {c} + {d} >= divergent) then {q(f'({c} + {d})')} end"
    near = lambda c: f"coalesce({q(c)}, {up(c, 1)}, {q(f'({c} - 1)')}, {up(c, 2)}, {q(f'({c} - 2)')})"
    rows = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in _GEOMETRY.items())
    marks = {"q_junction": "junction", "q_cca_a": "cca_a", "q_div_m1": "(divergent - 1)", "q_body_mid": "body_mid", "q_polya_mid": "polya_mid"}
    at = [f"(junction + {o})" for o in _OFFSETS]
    return f"""g(reference, {", ".join(N.GEOMETRY)}) as (values {rows}), al as (
  select *, start + m + case when deletion then gap else 0 end as r2, s + m + case when deletion then 0 else gap end as q2 from ({text}) left join g using (reference)
), an as (
  select read_id, reference, ns, {", ".join(f"{near(c)} as {n}" for n, c in marks.items())}, [{", ".join(f"coalesce({q(c)}, -1)" for c in at)}] as qf, [{", ".join(near(c) for c in at)}] as qo,
    case when n_moves is not null then list_append(list_transform(list_filter(range(0, n_moves), lambda i: (i + shift) % 4 <> 0), lambda i: i * stride + ts), ns) end as s2s, mapped, reverse, mapq, junction, n_moves from al
), anchored as (
  select *, len(s2s) - 1 as nb, case when not mapped or reverse then 'filtered' when mapq < 20 then 'low_mapq' when junction is null then 'no_geometry' when n_moves is null then 'no_tags' when q_junction is null or q_cca_a is null then 'unanchored'
    when len(list_filter(list_concat(qo, [{", ".join(marks)}]), lambda x: x >= len(s2s) - 1)) > 0 then 'query_out_of_range' end as skip from an
)"""


def _span_sql(q: str, reverse: bool) -> tuple[str, str]:
    a, b = f"s2s[{q} + 1]", f"s2s[{q} + 2]"
    return (f"(ns - {b})", f"(ns - {a})") if reverse else (a, b)


def _coordinates_sql(reverse: bool, arm: int) -> str:
    base = [f"(q_junction + {o})" if arm and 1 <= o <= arm else "-1" if arm and o > arm else f"qf[{i + 1}]" for i, o in enumerate(_OFFSETS)]
    ok = lambda q: f"({q} >= 0 and {q} < nb)"
    start, end = (lambda q: f"case when {ok(q)} then {_span_sql(q, reverse)[0]} else -1 end"), (lambda q: f"case when {ok(q)} then {_span_sql(q, reverse)[1]} else -1 end")
    arms = [i for i, o in enumerate(_OFFSETS) if o >= 1]
    last = f"(q_junction + {arm})" if arm else "q_div_m1"
    least = f"list_min([{', '.join(f'case when {ok(base[i])} then {start(base[i])} end' for i in arms)}])"
    exact = f"case when {ok(last)} then {start(last)} end"
    deep = lambda tests: f"greatest(0, {', '.join(f'case when {t} then {_OFFSETS[i]} else 0 end' for i, t in zip(arms, tests))})"
    js, je = _span_sql("q_junction", reverse)
    cs, ce = _span_sql("q_cca_a", reverse)
    return f"""select read_id, [{", ".join(start(b) for b in base)}] as starts, [{", ".join(end(b) for b in base)}] as ends, {js} as junction_sig, {je} - {js} as junction_dwell, {cs} as cca_a_sig, {ce} - {cs} as cca_a_dwell,
  coalesce({start("q_body_mid")}, -1) as body_mid_sig, coalesce({start("q_polya_mid")}, -1) as polya_mid_sig, {deep([ok(base[i]) for i in arms])} as arm_depth, {deep([ok(f"qf[{i + 1}]") for i in arms])} as aligner_depth,
  coalesce({exact}, {least}, {js}) as common_start_sig, case when {exact} is not null then '{"counted" if arm else "exact"}' when {least} is not null then 'arm_fallback' else 'junction_fallback' end as mask_source, [{", ".join(base)}] as bases from anchored where skip is null"""


_Q = "q_junction, q_cca_a, q_div_m1, q_body_mid, q_polya_mid"


def _anchored(spark, text, whole=True, **tables):
    return N.anchor_reads(_alignments(spark, text, **tables), _geometry(spark), _OFFSETS, least_mapq=20, whole=whole)


def _lines(spark, sf, whole=True):
    return _anchored(spark, _LINES, whole, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query(f"with {_anchor_sql(_LINES.format(lineitem='lineitem'))} select read_id, skip, nb, {_Q}, array_to_string(qf, ',') as qf from anchored")
def anchored_reads(spark, sf):
    return _lines(spark, sf).select("read_id", "skip", F.when(F.col("nb") >= 0, F.col("nb")).alias("nb"), *_Q.split(", "), F.array_join("qf", ",").alias("qf"))


@query(f"""with {_anchor_sql(_LINES.format(lineitem="lineitem"))} select mode, * exclude (mode, starts, ends, bases), array_to_string(starts, ',') as starts, array_to_string(ends, ',') as ends from (
  select 'time' as mode, * from ({_coordinates_sql(False, 0)}) union all select 'reversed' as mode, * from ({_coordinates_sql(True, 0)})
  union all select 'counted' as mode, * from ({_coordinates_sql(False, 3)}))""")
def junction_coordinates(spark, sf):
    """All anchored reads in three ways: in time, reversed, and with counted arm bases. They are anchored once."""
    found = _lines(spark, sf, whole=False)
    names = ["junction_sig", "junction_dwell", "cca_a_sig", "cca_a_dwell", "body_mid_sig", "polya_mid_sig", "arm_depth", "aligner_depth", "common_start_sig", "mask_source"]
    modes = {"time": (False, 0), "reversed": (True, 0), "counted": (False, 3)}
    for mode, (back, arm) in modes.items():
        c = N.signal_coordinates(found, _OFFSETS, back, arm)
        texts = [F.array_join(f"spans.{k}", ",").alias(f"{k}s") for k in ("start", "end")]
        found = c.select(*found.columns, F.struct(F.lit(mode).alias("mode"), "read_id", *names, *texts).alias(f"_{mode}"))
    return found.select(F.explode(F.array(*[f"_{mode}" for mode in modes])).alias("c")).select("c.*")


@query(f"with {_anchor_sql(_LINES.format(lineitem='lineitem'))} select count(*) as n, avg(case when s2s[q_junction + 1] < s2s[q_body_mid + 1] then 0.0 else 1.0 end) as share_reversed, 'forward' as decision from anchored where skip is null and q_body_mid < nb having avg(case when s2s[q_junction + 1] < s2s[q_body_mid + 1] then 0.0 else 1.0 end) < 0.05 union all select count(*), avg(case when s2s[q_junction + 1] < s2s[q_body_mid + 1] then 0.0 else 1.0 end), 'reversed' from anchored where skip is null and q_body_mid < nb having avg(case when s2s[q_junction + 1] < s2s[q_body_mid + 1] then 0.0 else 1.0 end) > 0.95")
def anchored_orientation(spark, sf):
    return R.orientation(N.orientation_votes(_lines(spark, sf, whole=False)))


#: Cells of the feature grid (offsets x dwell, mean, sd, residual), and two trees over them.
_PICKED = [8, 9, 15]
_FOREST = [
    {"feature": [1, -1, -1], "threshold": [0.0, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, -0.5, 0.7], "missing_left": [True, False, False], "class": 0},
    {"feature": [2, -1, 0, -1, -1], "threshold": [0.2, 0, 2.0, 0, 0], "left": [1, 0, 3, 0, 0], "right": [2, 0, 4, 0, 0], "value": [0, 0.3, 0, -0.4, 0.9], "missing_left": [False, False, True, False, False], "class": 0},
]
_CHAIN = f"""with {_anchor_sql(_ARRAYS.format(vectors="<vectors>"))}, co as ({_coordinates_sql(False, 3)}), cells as (
  select id, p, v, (round_even(v * 1000, 0) + 10) * 0.15 as pa from {_CELLS}
), gauge as (select id, median(pa) as m, mad(pa) * 1.4826 as d, avg(v) as lm, stddev_pop(v) as ls from cells group by id), why as (
  select a.read_id, a.reference, starts, ends, bases, case when a.read_id % 13 = 0 then 'no_signal' when ns <> 64 then 'ns_mismatch' when aligner_depth = 0 then 'no_aligned_arm' end as reason from anchored a join co using (read_id)
), x as (
  select read_id, k, any_value(ends[k] - starts[k]) as dwell, avg((pa - m) / d) as mean, any_value(bases[k]) as base from why, (select unnest([3, 4]) as k), cells c join gauge g using (id)
  where c.id = read_id and reason is null and starts[k] >= 0 and p > starts[k] and p <= ends[k] group by read_id, k
), f as (
  select read_id, max(case when k = 3 then dwell end) as dwell, max(case when k = 3 then mean end) as mean, max(case when k = 4 then mean - (v - lm) / ls end) as resid from x join cells c on c.id = read_id and c.p = base + 1 join gauge g on g.id = read_id group by read_id
), scored as (
  select why.*, case when reason is null then 1 / (1 + exp(-(0.1 + case when coalesce(mean <= 0, true) then -0.5 else 0.7 end + case when coalesce(resid <= 0.2, false) then 0.3 when coalesce(dwell <= 2, true) then -0.4 else 0.9 end))) end as p from why left join f using (read_id)
)"""


def _chain(spark, sf):
    vectors = relation(spark, sf, "vectors")
    levels = vectors.select(F.col("id").alias("read_id"), F.col("x").cast("array<double>").alias("levels"))
    anchored = _anchored(spark, _ARRAYS, vectors=vectors).join(levels, "read_id")
    signals = vectors.where("id % 13 <> 0").select(F.col("id").alias("read_id"), F.transform("x", lambda v: F.rint(v.cast("double") * 1000)).alias("signal"), F.lit(10.0).alias("offset"), F.lit(0.15).alias("scale"))
    return N.classify_reads(anchored, signals, _OFFSETS, _PICKED, _FOREST, [0.1], reversed_signal=False, arm_bases=3)


@query(f"{_CHAIN} select read_id, reference, reason, round(p, 6) as p, cast(round(p * 255) as int) as cl from scored")
def classified_reads(spark, sf):
    return _rounded(N.ordered_calls(_chain(spark, sf)[0].select("read_id", "reference", "reason", "p", "cl")))


@query(f"""{_CHAIN} select count(*) as n, count(p) as scored, count(*) filter (reason = 'no_signal') as no_signal, count(*) filter (reason = 'ns_mismatch') as ns_mismatch, count(*) filter (reason = 'no_aligned_arm') as abstain,
  round(list_sort(list(p) filter (p is not null))[count(p) // 2 + 1], 6) as median_p, round(count(*) filter (p >= 0.6) * 100.0 / count(p), 6) as percent_over from scored""")
def classified_statistics(spark, sf):
    calls = _chain(spark, sf)[0]
    return _rounded(C.classify_stats(calls.select(F.when(F.col("reason") == "no_aligned_arm", "abstain").otherwise(F.col("reason")).alias("no_call"), "p"), 0.6))

# --- searches ------------------------------------------------------------------------------------

_REGIONS = "select p_partkey as region_id, cast(p_partkey % 3 as bigint) as contig, p_partkey as from_pos, p_partkey + case when p_partkey % 50 = 0 then 900 else p_size % 7 end as to_pos from part"


@query(f"""select region_id, count(*) as n, min(read_id) as first_read, sum(ord) as ords from (select read_id, ord, start, end_pos, read_id % 3 as contig from <alignments>) a
  join ({_REGIONS}) r on a.contig = r.contig and start <= to_pos and end_pos >= from_pos group by region_id""")
def region_hits(spark, sf):
    """All alignments in any of as many regions as there are parts, a few of them long."""
    regions = spark.sql(_REGIONS.replace("from part", "from {p}"), p=spark.read.parquet(f"{sf}/part.parquet"))
    alignments = relation(spark, sf, "alignments").select("read_id", "ord", "start", "end_pos", (F.col("read_id") % 3).alias("contig"))
    hits = H.region_hits(alignments, regions, shift=5, levels=3)
    return hits.groupBy("region_id").agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"), F.sum("ord").alias("ords"))


#: A panel of 24 letters for each supplier, from the digits of a hash, and reads of it with up to three letters cut and two put in.
_LETTERS = "translate(substr(md5(cast({key} as {text})), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_PANEL = f"select s_suppkey as name, {_LETTERS.format(key='-s_suppkey', text='{text}')} as ref_sequence from {{supplier}}"
_EDITED = f"""select o_orderkey as id, concat(substr(ref_sequence, 1, cast(o_orderkey % 20 as int)), substr({_LETTERS.format(key="o_orderkey", text="{text}")}, 1, cast(o_orderkey % 3 as int)), substr(ref_sequence, cast(o_orderkey % 20 + o_custkey % 4 + 1 as int))) as sequence
  from {{orders}} join ({_PANEL}) p on p.name = o_custkey % 10 + 1"""


@query(f"""select id, name, cast(levenshtein(sequence, ref_sequence) as int) as distance from ({_EDITED.format(text="varchar", orders="orders", supplier="supplier")}) q,
  ({_PANEL.format(text="varchar", supplier="supplier")}) r where levenshtein(sequence, ref_sequence) <= 3""")
def within_edit_distance(spark, sf):
    orders, suppliers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "supplier"))
    # The SQL joins all orders with suppliers 1 to 10 (-8 to 0 for negative keys), so a shuffle would gather them in ten tasks.
    ten = F.broadcast(suppliers.where("s_suppkey between -8 and 10"))
    queries = spark.sql(_EDITED.format(text="string", orders="{o}", supplier="{s}"), o=orders, s=ten)
    return H.within_distance(queries, spark.sql(_PANEL.format(text="string", supplier="{s}"), s=suppliers), 3)


_STOPPED = """with sums as (
  select id, i, count(*) over w as n, sum(v) over w as t, sum(v * v) over w as tt, sum(v) over b as s, sum(v * v) over b as q from <samples> window w as (partition by id), b as (partition by id order by i rows between unbounded preceding and 1 preceding)
), var as (
  select id, i, n, tt / n - (t / n) ** 2 as vf, q / i - (s / i) ** 2 as vh, (tt - q) / (n - i) - ((t - s) / (n - i)) ** 2 as vt from sums where i >= 5 and i < n - 5 and (i - 5) % 2 = 0
), gains as (
  select id, i, case when vf > 1e-12 and vh > 1e-12 and vt > 1e-12 then round(n * ln(vf) - i * ln(vh) - (n - i) * ln(vt), 6) else 0 end as gain from var
), stops as (
  select a.id, a.i from gains a join gains j on j.id = a.id and j.i >= a.i - 12 and j.i + 2 < a.i join gains k on k.id = j.id and k.i = j.i + 2 and k.gain > 0
  where a.i - 5 >= 12 and (a.i - 5) % 6 = 0 group by a.id, a.i having avg(k.gain - j.gain) < 0
)
select id, i, gain from gains left join (select id, min(i) as stop from stops group by id) using (id) where stop is null or i < stop"""


@query(_STOPPED)
def early_stopped_gains(spark, sf):
    return G.early_stopped_gains(relation(spark, sf, "samples"), 5, 5, 12, 6, 2)


# --- batches -------------------------------------------------------------------------------------


@query()
def moving_band_alignment(spark, sf):
    """Each vector cut into eight levels, from an even guess."""
    guess = F.sequence(F.lit(0).cast("long"), F.lit(64).cast("long"), F.lit(8).cast("long"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.slice("x", i * 8 + 1, 8), F.lit(0.0), lambda a, v: a + v.cast("double")) / 8)
    return B.align_moving_band(relation(spark, sf, "vectors").select("id", "x", levels.alias("levels"), guess.alias("boundaries")), 24)


# --- scaling -------------------------------------------------------------------------------------

#: Sixteen bases over each vector, with dwells that vary, and a level for each.
_CUTS = [0, 3, 8, 12, 15, 20, 24, 29, 32, 36, 41, 44, 49, 53, 57, 60, 64]
_BASES = f"(select unnest(range(0, 16)) as i, unnest({_CUTS[:-1]}) as a, unnest({_CUTS[1:]}) as b)"


def _scaled_input(spark, sf):
    x = F.transform("x", lambda v: v.cast("double"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((i * 7 + F.col("id")) % 16).cast("double") / 8 - 1)
    bounds = F.array(*[F.lit(c).cast("long") for c in _CUTS])
    now = F.struct(F.lit(0.05).alias("shift"), F.lit(1.25).alias("scale"), F.lit(0.001).alias("drift"))
    return relation(spark, sf, "vectors").select("id", x.alias("x"), levels.alias("levels"), bounds.alias("bounds"), now.alias("now"))


_POINTS = f"""with p as (
  select id, (avg(v) - 0.05 - 0.001 * any_value(a + b) / 2) / 1.25 as x, any_value(a + b) / 2 as t, any_value((i * 7 + id) % 16) / 8 - 1 as y from {_CELLS} c join {_BASES} s on c.p > a and c.p <= b
  where i >= 1 and i < 15 and b - a > 3 and b - a < 5 and abs((i * 7 + id) % 16 / 8 - 1 - (-0.0625)) > 0.2 group by id, i
), f as (
  select id, count(*) as n, avg(x) as mx, avg(t) as mt, avg(y) as my, var_pop(x) as xx, var_pop(t) as tt, covar_pop(x, t) as xt, covar_pop(x, y) as xy, covar_pop(t, y) as ty from p group by id
)"""


@query(f"""{_POINTS}, s as (select id, n, (xy * tt - ty * xt) / (xx * tt - xt * xt) as b, (ty * xx - xy * xt) / (xx * tt - xt * xt) as c, mx, mt, my from f)
  select id, case when n < 3 then null when b >= 0.01 then round(0.05 - (my - b * mx - c * mt) * 1.25 / b, 5) else 0.05 end as shift,
  case when n < 3 then null when b >= 0.01 then round(1.25 / b, 5) else 1.25 end as scale, case when n < 3 then null when b >= 0.01 then round(0.001 - c * 1.25 / b, 5) else 0.001 end as drift from s""")
def rescaled(spark, sf):
    """Scale, shift and drift by bases whose dwell and level are fit for it."""
    made = _scaled_input(spark, sf).select("id", S.rescale(F.col("x"), F.col("bounds"), F.col("levels"), F.col("now"), 0.1, 0.95, 0.2, 1, 3).alias("s"))
    return _rounded(made.select("id", "s.shift", "s.scale", "s.drift"), 5)


_QUANTILES = [0.1, 0.3, 0.5, 0.7, 0.9]


@query(f"""with m as (select id, i, (v - 0.05) / 1.25 as x, (i * 7 + id) % 16 / 8 - 1 as y from {_CELLS} c join {_BASES} s on c.p = (a + b) // 2 + 1 where i >= 2 and i < 14),
  q as (select id, unnest(quantile_cont(x, {_QUANTILES})) as x, unnest(quantile_cont(y, {_QUANTILES})) as y from m group by id),
  f as (select id, regr_slope(y, x) as b, regr_intercept(y, x) as a from q group by id)
  select id, case when b >= 0.01 then round(0.05 - a * 1.25 / b, 5) else 0.05 end as shift, case when b >= 0.01 then round(1.25 / b, 5) else 1.25 end as scale from f""")
def rough_rescaled(spark, sf):
    made = _scaled_input(spark, sf).select("id", S.rough_rescale(F.col("x"), F.col("bounds"), F.col("levels"), F.col("now"), _QUANTILES, clip=2).alias("s"))
    return _rounded(made.select("id", "s.shift", "s.scale"), 5)


#: A level for each 3-mer of the letters of hashed ids: the mean of what the parts with it cost.
_KMERS = "select substr(translate(substr(md5(cast(p_partkey as {text})), 1, 3), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 3) as kmer, round(avg(p_retailprice), 6) as level from part group by 1"


@query(f"""with r as (select kmer, row_number() over (order by level, kmer) as r from ({_KMERS.format(text="varchar")})), b as (
  select i as position, substr(kmer, i + 1, 1) as base, r from r, (select unnest([0, 1, 2]) as i)), s as (select position, base, count(*) as c, sum(r) as s from b group by all),
  h as (select position, 12.0 / (sum(c) * (sum(c) + 1)) * sum(s * s / c) - 3.0 * (sum(c) + 1) as h from s group by position)
  select cast(arg_min(position, [-round(h, 9), position]) as int) as position, round(max(h), 6) as h from h""")
def dominant_base(spark, sf):
    table = spark.sql(_KMERS.format(text="string").replace("from part", "from {p}"), p=spark.read.parquet(f"{sf}/part.parquet"))
    return _rounded(Q.dominant_base(table, 3))


# --- warping -------------------------------------------------------------------------------------

_POOLED = f"(select id, label, (p - 1) // 4 as j, avg(v) as v from {_CELLS} group by all)"


@query(f"""with recursive q as (select id, list(v order by j) as x from {_POOLED} group by id), b as (
  select ref, list(m order by j) as y from (select label as ref, j, avg(v) as m from {_POOLED} group by label, j) group by ref
), d(id, ref, i, r) as (
  select id, ref, 0, list_concat([0.0::double], list_transform(range(0, 16), lambda k: 'inf'::double)) from q, b
  union all
  select id, ref, i + 1, list_reduce(list_concat([['inf'::double]], list_transform(range(1, 17), lambda k: [k::double])), lambda acc, j: list_append(acc,
    case when abs(i + 1 - j[1]) <= 4 then pow(y[j[1]::int] - x[i + 1], 2) + least(r[j[1]::int], least(r[j[1]::int + 1], acc[len(acc)]) + 0.01) else 'inf'::double end))
  from d join q using (id) join b using (ref) where i < 16
)
select id, cast(ref as bigint) as ref, round(sqrt(r[17]), 5) as distance from d where i = 16""")
def warping_distances(spark, sf):
    """Every vector, pooled by four, against its classes' means, in a window of four places and with a penalty off the diagonal."""
    pooled = relation(spark, sf, "vectors").select("id", "label", A.mean_pool(F.transform("x", lambda v: v.cast("double")), 4).alias("x"))
    cells = pooled.select(F.col("label").alias("ref"), F.posexplode("x").alias("j", "v")).groupBy("ref", "j").agg(F.avg("v").alias("m"))
    bank = cells.groupBy(F.col("ref").cast("long").alias("support_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda c: c["m"]).alias("x"))
    found = V.distances_to(pooled.select("id", "x"), bank, window=4, penalty=0.1)
    return _rounded(found.select("id", F.col("support_id").alias("ref"), "distance"), 5)
