"""Anchors, region joins, bounded edit distance and the early stop against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import anchoring as N
from strandline.operators import searches as H
from strandline.operators import segmentation as G


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_pairs_within_a_distance(spark, limit):
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choice("ACG") for _ in range(n))
    panel = [(f"r{i}", word(rng.choice([8, 9, 11]))) for i in range(15)] + [("short", "AC"), ("empty", ""), ("null", None), (None, "ACGACGAC")]
    queries = []
    for i in range(150):
        s = list(rng.choice(panel[:15])[1])
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(s) + 1)
            rng.choice([lambda: s.insert(k, rng.choice("ACG")), lambda: s.pop(min(k, len(s) - 1)), lambda: s.__setitem__(min(k, len(s) - 1), "T")])()
        queries.append((i, "".join(s)))
    queries += [(200, ""), (201, "A"), (202, None), (None, "AC"), (203, "ACG")]
    got = sorted(map(tuple, H.within_distance(spark.createDataFrame(queries, "id long, sequence string"), spark.createDataFrame(panel, "name string, ref_sequence string"), limit).collect()))
    want = sorted((i, n, distance(q, r)) for i, q in queries for n, r in panel if None not in (i, q, n, r) and distance(q, r) <= limit)
    assert got == want and want


def test_each_different_sequence_is_compared_once(spark):
    queries = spark.range(900).selectExpr("id", "case id % 3 when 0 then 'ACGTACGT' when 1 then 'ACGTACG' else 'TTTTTTTT' end as sequence")
    queries = queries.unionByName(queries.where("id < 5"))  # a repeated row counts once
    panel = spark.createDataFrame([("a", "ACGTACGA"), ("a", "ACGTACGA"), ("b", "ACGTACGA"), ("c", "GGGGGGGG")], "name string, ref_sequence string")
    found = H.within_distance(queries, panel, 2)
    plan = found._jdf.queryExecution()
    cut = [line for line in plan.optimizedPlan().toString().split("\n") if "Generate" in line and "array_distinct" in line]
    assert len(cut) == 1 and "sequence#" in cut[0] and "id#" not in cut[0]  # ids were cut and compared each for itself
    assert "SortMergeJoin [at" in plan.executedPlan().toString()  # the pieces aren't broadcast
    assert sorted(map(tuple, found.collect())) == sorted((i, n, 1) for i in range(900) if i % 3 < 2 for n in "ab")


def test_regions(spark):
    rng = random.Random(3)
    spans = lambda n, most: [(i, rng.choice("xyz"), a, a + rng.choice([0, 1, 5, most])) for i, a in enumerate(rng.randrange(0, 3000) for _ in range(n))]
    alignments = spans(400, 700) + [(900, "x", 10, 9), (901, None, 1, 2), (902, "y", None, 5), (903, "z", 0, 10**7)]
    regions = spans(200, 2500) + [(900, "x", 50, 40), (901, None, 0, 9), (902, "x", 0, 10**6)]
    a = spark.createDataFrame(alignments, "read_id long, contig string, start long, end_pos long")
    r = spark.createDataFrame(regions, "region_id long, contig string, from_pos long, to_pos long")
    met = H.region_hits(a, r, shift=4, levels=3)
    want = sorted((i, k) for i, c, s, e in alignments for k, d, f, t in regions if c and c == d and None not in (s, e) and s <= e and f <= t and s <= t and e >= f)
    assert sorted((x["read_id"], x["region_id"]) for x in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert H.region_hits(a.limit(0), r).count() == 0 and H.region_hits(a, r.limit(0)).count() == 0


def test_regions_compare_only_neighbours(spark):
    # Every alignment crosses a border of all levels' bins: they were all compared with all regions.
    a = spark.range(3000).selectExpr("id as read_id", "'x' as contig", "(id + 1) * 1024 - 2 as start", "(id + 1) * 1024 + 2 as end_pos")
    r = spark.range(3000).selectExpr("id as region_id", "'x' as contig", "(id + 1) * 1024 as from_pos", "(id + 1) * 1024 + 9 as to_pos")
    met = H.region_hits(a, r, shift=4, levels=3)
    assert met.where("read_id = region_id").count() == met.count() == 3000
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()  # many times the regions' rows
    gathered = H.placed_alignments(a, 4, 3).groupBy("contig", "_level", "_bin").count()
    assert gathered.agg(F.max("count"), F.sum("count")).first()[:] == (1, 3000)


def plain_gains(x, least, trim, window, check, stride):
    var = lambda v: np.mean(v * v) - np.mean(v) ** 2 if len(v) else 0.0
    out = {}
    for i in range(least, len(x) - trim, stride):
        if i >= least + window and (i - least) % check == 0:
            steps = [out[j + stride] - out[j] for j in range(i - window, i, stride) if j + stride < i and out.get(j + stride, 0) > 0]
            if steps and np.mean(steps) < 0:
                break
        h, t, w = var(x[:i]), var(x[i:]), var(x)
        out[i] = round(len(x) * np.log(w) - i * np.log(h) - (len(x) - i) * np.log(t), 6) if min(h, t, w) > 1e-12 else 0.0
    return out


@pytest.mark.parametrize(("window", "check", "stride"), [(20, 10, 1), (12, 6, 2), (7, 7, 1)])
def test_early_stop(spark, window, check, stride):
    rng = np.random.default_rng(2)
    signals = {1: np.r_[[50.0 + i % 3 for i in range(50)], [100.0 + i % 3 for i in range(50)]], 2: rng.normal(size=90), 3: np.ones(60), 4: np.r_[rng.normal(size=20), rng.normal(9, 1, 100)], 5: np.arange(4.0)}
    rows = [(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    got = {}
    for r in G.early_stopped_gains(spark.createDataFrame(rows, "id long, i long, v double"), 10, 10, window, check, stride).collect():
        got.setdefault(r["id"], {})[r["i"]] = r["gain"]
    for k, x in signals.items():
        assert got.get(k, {}) == pytest.approx(plain_gains(x, 10, 10, window, check, stride), abs=2e-6)
    assert max(got[1].values()) > 0 and len(got[4]) < len(range(10, 110, stride))


OFFSETS = [-1, 0, 1, 2, 3]


def coordinates(spark, qf, div, arm=0, junction=20, back=False):
    row = [(1, 400, list(range(0, 401, 10)), 40, junction, 19, div, None, 45, qf)]
    df = spark.createDataFrame(row, "read_id long, ns long, seq_to_sig array<long>, nb long, q_junction long, q_cca_a long, q_div_m1 long, q_body_mid long, q_polya_mid long, qf array<long>")
    return N.signal_coordinates(df, OFFSETS, back, arm).first()


def test_coordinates_of_anchored_reads(spark):
    c = coordinates(spark, [19, 20, -1, -1, 35], None, 3)
    assert [tuple(s) for s in c["spans"]] == [(190, 200), (200, 210), (210, 220), (220, 230), (230, 240)]
    assert (c["mask_source"], c["common_start_sig"], c["arm_depth"], c["aligner_depth"], c["body_mid_sig"], c["polya_mid_sig"]) == ("counted", 230, 3, 3, -1, -1)
    c = coordinates(spark, [19, 20, 21, 22, 23], None, 2)
    assert tuple(c["spans"][4]) == (-1, -1) and c["arm_depth"] == 2
    c = coordinates(spark, [19, 20, 21, 22, 23], None, 100)
    assert (c["mask_source"], c["common_start_sig"]) == ("arm_fallback", 210)
    c = coordinates(spark, [19, 20, -1, -1, -1], None, 3, junction=39)
    assert c["mask_source"] == "junction_fallback" and c["common_start_sig"] == c["junction_sig"] and c["aligner_depth"] == 0
    c = coordinates(spark, [19, 20, 21, 22, 23], 24)
    assert (c["mask_source"], c["common_start_sig"], c["junction_sig"], c["junction_dwell"], c["cca_a_sig"]) == ("exact", 240, 200, 10, 190)
    c = coordinates(spark, [19, 20, -1, 22, 23], None)
    assert (c["mask_source"], c["common_start_sig"]) == ("arm_fallback", 220)
    c = coordinates(spark, [19, 20, -1, -1, -1], None)
    assert c["mask_source"] == "junction_fallback" and c["common_start_sig"] == c["junction_sig"]
    c = coordinates(spark, [19, 20, 21, 22, 23], 24, back=True)
    assert [tuple(s) for s in c["spans"]][:2] == [(200, 210), (190, 200)] and c["common_start_sig"] == 150


def by_walk(start, ops):
    r, q, at = start, 0, {}
    for op, n in ops:
        for _ in range(n):
            if op in "M=X":
                at[r] = q
            r, q = r + (op in "M=XDN"), q + (op in "M=XIS")
    return at


def test_reference_positions_equal_a_walk_over_the_bases(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 8), [(rng.choice("M=XIDNSHP"), rng.randrange(0, 6)) for _ in range(rng.randrange(0, 12))]) for i in range(120)]
    df = spark.createDataFrame(rows, "read_id long, start long, ops array<struct<op:string,len:long>>")
    wanted = list(range(0, 30, 3))
    got = {r["read_id"]: r["query"] for r in N.reference_positions(df, F.array(*map(F.lit, wanted)), 2, F.lit(13)).collect()}
    for i, start, ops in rows:
        at = by_walk(start, ops)
        for k, r in enumerate(wanted):
            near = [c for d in range(3) for c in (r + d, r - d) if c in at and not (r < 13 <= c)]
            assert (got[i][k] and tuple(got[i][k])) == ((at[near[0]], near[0]) if near else None)


def test_anchors_move_no_read_and_are_made_once(spark):
    ops = [("S", 2), ("M", 20), ("D", 1), ("M", 9)]
    rows = [(i, "AAR"[i % 3], i % 4 > 0, False, False, False, 15 + i % 10, i % 6, ops, [1] * (12 + i % 20), 2, 0, 90) for i in range(300)] + [(None, "A", True, False, False, False, 60, 0, ops, [1] * 40, 2, 0, 90)]
    schema = "read_id long, reference string, mapped boolean, reverse boolean, secondary boolean, supplementary boolean, mapq int, start long, ops array<struct<op:string,len:long>>, moves array<int>, stride int, ts int, ns long"
    alignments = spark.createDataFrame(rows, schema)
    geometry = spark.createDataFrame([("A", 9, 10, 16, 4, 18)], ["reference", *N.GEOMETRY])
    every = N.anchor_reads(alignments, geometry, OFFSETS, 20)
    chosen = every.where("skip is null")
    # The reads of a few references gathered in as many tasks, and a test of skip made the anchors anew for each of its terms.
    plan = chosen._jdf.queryExecution()
    assert "Exchange hashpartitioning" not in plan.executedPlan().toString() and "SortMergeJoin" not in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count("aggregate(") == 1
    only = N.anchor_reads(alignments, geometry, OFFSETS, 20, whole=False)
    assert only._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert sorted(map(str, only.collect())) == sorted(map(str, chosen.collect())) and chosen.count()
    assert {r["skip"] for r in every.select("skip").distinct().collect()} >= {None, "filtered", "low_mapq", "no_geometry", "query_out_of_range", "bad_name"}
    assert every.count() == 301


def test_coordinates_of_all_ways_read_the_lines_once(spark):
    from strandline.plans.models import QUERIES

    found = QUERIES["junction_coordinates"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 1
    assert {r["mode"] for r in found.select("mode").distinct().collect()} == {"time", "reversed", "counted"}


def test_anchors_of_odd_reads_by_walk(spark):
    rng = random.Random(8)
    geometry = {"A": (9, 10, 16, 4, 18), "N": (11, 12, 18, 5, 20), "P": (9, 10, None, None, 18)}
    rows = []
    for i in range(240):
        ops = [(rng.choice("MMM=XIDNSH"), rng.randrange(0, 8)) for _ in range(rng.randrange(0, 10))]
        moves = None if i % 9 == 0 else [rng.choice([0, 1, 1, None]) for _ in range(rng.randrange(0, 40))]
        rows.append((i, rng.choice(["A", "N", "P", "R", None]), True, False, False, False, None if i % 7 == 0 else 60, rng.randrange(0, 8), ops, moves, None if i % 10 == 1 else 2, None if i % 2 else 3, None if i % 10 == 2 else 90))
    schema = "read_id long, reference string, mapped boolean, reverse boolean, secondary boolean, supplementary boolean, mapq int, start long, ops array<struct<op:string,len:long>>, moves array<int>, stride int, ts int, ns long"
    marked = spark.createDataFrame([(k, *v) for k, v in geometry.items()], "reference string, " + ", ".join(f"{c} int" for c in N.GEOMETRY))
    found = N.anchor_reads(spark.createDataFrame(rows, schema), marked, OFFSETS, 20)
    got = {r["read_id"]: r for r in found.collect()}
    seen = set()
    for i, reference, *_, start, ops, moves, stride, ts, ns in rows:
        at, (cca_a, junction, divergent, body, polya) = by_walk(start, ops), geometry.get(reference, (None,) * 5)

        def near(r):
            places = [c for d in range(3) for c in (r + d, r - d) if c in at and not (divergent is not None and r < divergent <= c)] if r is not None else []
            return at[places[0]] if places else None

        r, wanted = got[i], {"q_cca_a": cca_a, "q_junction": junction, "q_div_m1": divergent and divergent - 1, "q_body_mid": body, "q_polya_mid": polya}
        assert {k: r[k] for k in wanted} == {k: near(v) for k, v in wanted.items()}
        assert r["qf"] == [-1 if junction is None else at.get(junction + o, -1) for o in OFFSETS]
        mapped = None if moves is None else [k * stride + (ts or 0) for k, m in enumerate(moves) if m == 1 and stride is not None] + [ns]
        assert r["seq_to_sig"] == mapped and r["nb"] == (mapped and len(mapped) - 1)
        bases = [near(x) for x in [*wanted.values(), *[junction and junction + o for o in OFFSETS]]]
        early = "no_geometry" if junction is None else "no_tags" if None in (moves, stride, ns) else "unanchored" if None in (r["q_junction"], r["q_cca_a"]) else None
        assert r["skip"] == (early or ("query_out_of_range" if max(b for b in bases if b is not None) >= r["nb"] else None))
        seen.add(r["skip"])
    assert seen == {None, "no_geometry", "no_tags", "unanchored", "query_out_of_range"}


def test_anchored_reads_are_neither_moved_nor_mapped(spark):
    from strandline.plans.models import QUERIES

    plan = QUERIES["anchored_reads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Exchange hashpartitioning" not in plan.executedPlan().toString()
    text = plan.optimizedPlan().toString()
    # The bases were counted by the length of a map that no column takes, and each run's place was made four times.
    assert "seq_to_sig" not in text and text.count("greatest(") == 1
    # The places wanted of a reference were made for every read; none is left to make.
    assert "array_max(concat" not in text and text.count("aggregate(") == 1
