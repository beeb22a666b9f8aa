"""Annotations, sinks, discovery, calls, demultiplexing and batched kernels on small cases."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import preparation as P
from strandline.operators import annotations as T
from strandline.operators import calls as C
from strandline.operators import catalog as L
from strandline.operators import demux as D
from strandline.operators import kernels as K
from strandline.operators import relations as R
from strandline.sources import discovery, sinks

from .test_kernels import plain_dtw


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} array<double>" for n in values)) if values else spark.range(1)
    return df.select(column.alias("y")).first().y


def test_short_and_flat_signals(spark):
    x = F.col("x")
    assert one(spark, P.normalise_signal(x), x=[5.0] * 10) == [5.0] * 10
    assert one(spark, P.normalise_signal(x), x=[5.0] * 11) == [0.0] * 11
    assert one(spark, P.mad_normalise_clipped(x, 2.0), x=[1.0, 1.0, 9.0]) == [0.0, 0.0, 8.0]
    assert one(spark, P.dwell_log_mad(x), x=[3.0, 3.0]) == [0.0, 0.0]
    assert one(spark, P.normalise_fingerprint(x, "median_mad"), x=[2.0, 2.0]) == [2.0, 2.0]
    assert one(spark, P.normalise_model_input(x), x=[1.0, 1.0, float("nan")])[2] == -5.0
    assert one(spark, P.boundary_model_input(x, 4, 10, 2), x=[1.0] * 4) is None
    assert one(spark, P.boundary_model_input(x, 4, 10, 2), x=[0.0] * 4 + [1.0, 3.0, 8.0]) == [-1.0, 1.0, -5.0]
    assert one(spark, P.adapter_end(x), x=[9.0, 1.0]) is None and one(spark, P.adapter_end(x), x=[1.0, 9.0, 9.0]) == 1010
    assert one(spark, P.kernel_width(x), x=[0.0, float("inf")]) == 1.0 and one(spark, P.kernel_width(x), x=[2.0, 0.0]) == 0.125
    assert one(spark, P.expected_levels_z(x, F.array(F.lit(0), F.lit(-1))), x=[1.0] * 19) == [None, None]
    with pytest.raises(ValueError):
        P.normalise_fingerprint(x, "other")
    with pytest.raises(Exception, match="without a spread"):
        one(spark, P.fix_gauge(x), x=[1.0, 1.0])


def test_trees_as_conditions(spark):
    rng = np.random.default_rng(3)
    deep = {"feature": [0, 1, -1, -1, -1], "threshold": [0.2, -0.1, 0, 0, 0], "left": [1, 2, 0, 0, 0], "right": [4, 3, 0, 0, 0], "value": [0, 0, 1.0, -2.0, 0.5], "missing_left": [False, True, True, True, True], "class": 0}
    forest = [deep, {**deep, "class": 1, "threshold": [-0.3, 0.4, 0, 0, 0]}]
    rows = [rng.standard_normal(2).tolist() for _ in range(20)] + [[float("nan"), 0.0], [-1.0, float("nan")]]
    for baseline in ([0.1, -0.2], [0.3]):
        own = [t for t in forest if t["class"] < len(baseline)]
        P.check_trees(own, 2, len(baseline))
        got = [r.p for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>").select("i", P.trees(F.col("x"), own, baseline).alias("p")).orderBy("i").collect()]
        for x, p in zip(rows, got):
            assert p == pytest.approx(K.tree_ensemble(x, own, np.array(baseline)).tolist())
    for bad in ({"feature": [7, -1, -1, -1, -1]}, {"left": [0, 2, 0, 0, 0]}, {"value": [1.0]}, {"class": 5}):
        with pytest.raises(ValueError):
            P.check_trees([{**deep, **bad}], 2, 2)


@pytest.mark.parametrize("window,penalty", [(None, 0.3), (3, 0.0)])
def test_batched_warping(window, penalty):
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal(n) for n in (5, 7, 5, 0, 6, 7)]
    bank = rng.standard_normal((4, 6))
    for row, got in zip(rows, K.dtw_rows(rows, bank, window, penalty, lanes=8)):
        assert got == pytest.approx([plain_dtw(row, b, window, penalty) for b in bank])


def test_adapter_parts_and_decision(spark):
    rng = np.random.default_rng(2)
    rows = [np.concatenate([rng.standard_normal(20) + 30, rng.standard_normal(n), rng.standard_normal(30) + 90]) for n in (30, 30, 50)] + [np.ones(40), rng.standard_normal(3)]
    for x, got in zip(rows, K.adapter_parts(rows, 8, 3)):
        main = K.likelihood_split(x, 0, len(x), 11, 3)
        if main is None:
            assert got is None
            continue
        first, last = K.likelihood_split(x, 0, main[0], 3, 8) or (1, 0.0), K.likelihood_split(x, main[0], len(x), 8, 3) or (main[0] + 1, 0.0)
        assert (got["main"], got["first"], got["last"]) == (main[0], first[0], last[0])
        assert (got["first_gain"], got["last_gain"]) == pytest.approx((first[1], last[1]))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(9, None)], "id int, x array<double>")
    got = {r.id: (r.b.start, r.b.end) for r in df.select("id", D.adapter(F.col("x"), 8, 3).alias("b")).collect()}
    assert got[0] == got[1] == (0, 50) or got[0] == (20, 50)
    assert got[3] == got[4] == got[9] == (0, 0)
    coarse = {r.id: (r.b.start, r.b.end) for r in df.select("id", D.adapter(F.col("x"), 20, 10, pool=5).alias("b")).collect()}
    assert coarse[2][1] == 70


def test_demultiplex_finds_the_class(spark):
    from strandline.plans import extended

    sf = "/root/testdata/sf0.001"
    rows = extended.QUERIES["demux_pipeline"](spark, sf).collect()
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert len(rows) == len(label)
    found = [r for r in rows if r.barcode != C.UNCLASSIFIED]
    assert len(found) >= 0.8 * len(rows) and np.mean([r.barcode == f"BC{label[r.id]:02d}" for r in found]) >= 0.8
    assert np.mean([(r.adapter_start, r.adapter_end) == (12, 44) for r in rows]) >= 0.9


def test_gates(spark):
    rows = [(1, "a", None, None, None), (2, "a", 1, None, None), (3, "b", 5, -0.1, 0.5), (4, "b", 5, -3.0, 9.0), (5, None, 9, None, None)]
    m = spark.createDataFrame(rows, "id int, best string, margin int, log_p double, lattice_margin double")
    assert {r.id: (r.barcode, r.confidence) for r in C.call_barcode(m, 2).collect()} == {1: ("a", 0.0), 3: ("b", 5.0), 4: ("b", 5.0)}
    assert {r.id: r.barcode for r in C.call_barcode_scored(m, 2).collect()} == {1: "a", 2: C.UNCLASSIFIED, 3: "b", 4: "b", 5: C.UNCLASSIFIED}
    assert {r.id: r.barcode for r in C.call_barcode_scored(m, 2, 1.0, 0.5).collect()} == {1: "a", 2: C.UNCLASSIFIED, 3: C.UNCLASSIFIED, 4: C.UNCLASSIFIED, 5: C.UNCLASSIFIED}
    assert C.classify_stats(spark.createDataFrame([], "no_call string, p double"), 0.5).first().percent_over == 0.0


def test_reference_to_query_prefers_the_higher_and_keeps_the_barrier(spark):
    bases = spark.createDataFrame([(1, p, p + 100) for p in (3, 5, 9, 12)], "read_id int, ref_pos long, query_pos long")
    wanted = spark.createDataFrame([(1, p) for p in (3, 4, 7, 10, 20)], "read_id int, ref_pos long")
    got = {r.ref_pos: r.donor for r in C.reference_to_query(bases, wanted).collect()}
    assert got == {3: 3, 4: 5, 7: 9, 10: 9}
    got = {r.ref_pos: r.donor for r in C.reference_to_query(bases, wanted, barrier=8).collect()}
    assert got == {3: 3, 4: 5, 7: 5, 10: 9}


def test_repeated_ids_do_not_multiply_reads(spark):
    reads = spark.createDataFrame([(1,), (2,), (3,)], "read_id int")
    mapping = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "C", 1), (2, "", 2)], "read_id int, barcode string, line int")
    assert sorted(tuple(r) for r in R.route(reads, mapping, "barcode", order=["line"]).collect()) == [(1, "B")]
    assert sorted(tuple(r) for r in R.route(reads, mapping, "barcode", "none", ["line"]).collect()) == [(1, "B"), (2, "none"), (3, "none")]
    assert {r.read_id: r.barcode for r in R.annotate(reads, mapping, "barcode", ["line"]).collect()} == {1: "B", 2: None, 3: None}
    design = spark.createDataFrame([("A", "x"), ("A", "y")], "barcode string, v string")
    with pytest.raises(Exception, match="same keys"):
        R.derive_design(spark.createDataFrame([(1, "A")], "read_id int, barcode string"), design, ["barcode"]).collect()


def test_annotation_lifecycle(spark):
    reads = spark.createDataFrame([(i,) for i in range(6)], "read_id int")
    new = spark.createDataFrame([(i, f"L{i % 2 + 1}", f"E{i % 2 + 1}", i / 4) for i in range(4)] + [(99, "L1", "E1", 0.0)], "read_id int, ldx string, edx string, logp double")
    own = T.write_columns(T.empty(reads), new, ["ldx", "edx", "logp"])
    assert own.table.count() == 6 and own.labels() == ["ldx", "edx"] and T.read_annotation(own, "ldx").count() == 4
    design = spark.createDataFrame([("L1", "E1", "fresh", "r1"), ("L2", "E2", "frozen", "")], "ldx string, edx string, condition string, replicate string")
    own = T.write_design(own, "plate", design, ["ldx", "edx"])
    got = {r.read_id: (r.condition, r.replicate) for r in T.read_columns(own, ["condition", "replicate"]).collect()}
    assert got == {0: ("fresh", "r1"), 1: ("frozen", None), 2: ("fresh", "r1"), 3: ("frozen", None), 4: (None, None), 5: (None, None)}
    # a changed key derives the design anew
    moved = T.write_annotation(own, spark.createDataFrame([(0, "L2")], "read_id int, ldx string"), "ldx")
    assert {r.read_id: r.condition for r in T.read_annotation(moved, "condition").collect()} == {}
    for refused in (
        lambda: T.write_annotation(own, new.withColumnRenamed("ldx", "condition"), "condition"),
        lambda: T.remove_annotation(own, "ldx"),
        lambda: T.remove_annotation(own, "condition"),
        lambda: T.read_annotation(own),
        lambda: T.write_design(own, "other", design, ["ldx", "edx"]),
        lambda: T.write_design(own, "other", design.select("ldx", "condition"), ["nope"]),
        lambda: T.write_annotation(own, new.withColumnRenamed("ldx", "a b"), "a b"),
        lambda: T.write_annotation(own, new, "logp"),
    ):
        with pytest.raises(ValueError):
            refused()
    for unknown in (lambda: T.read_columns(own, ["nope"]), lambda: T.remove_annotation(own, "nope"), lambda: T.remove_design(own, "nope"), lambda: T.read_score(own, "ldx")):
        with pytest.raises(KeyError):
            unknown()
    assert T.read_score(own).count() == 4 and T.read_columns(own).columns == ["read_id"]
    assert T.read_design(own, "plate").count() == 2
    left = T.remove_design(own, "plate")
    assert left.names == ["ldx", "edx", "logp"] and T.remove_annotation(left, "ldx").names == ["edx", "logp"]
    with pytest.raises(Exception, match="no number"):
        T.write_columns(own, spark.createDataFrame([(0, float("nan"))], "read_id int, q double"), ["q"]).table.collect()
    with pytest.raises(ValueError, match="more than"):
        T.distinct_labels(own.table, "ldx", most=1)


def test_lookups(spark):
    reads = spark.createDataFrame([(i, "f", i // 3, i % 3, 10 * i) for i in range(7)], "read_id int, source_file string, batch_idx int, row_idx int, num_samples long")
    ids = spark.createDataFrame([(5,), (2,), (2,)], "read_id int")
    assert [r.read_id for r in L.storage_order(reads, ids).collect()] == [2, 5]
    assert L.find_read(reads, 4).first().num_samples == 40 and L.find_read(reads, 44).count() == 0
    assert L.read_batch(reads, "f", 1).count() == 3
    absent = ids.union(spark.createDataFrame([(77,)], "read_id int"))
    assert L.select_reads(reads, absent, missing_ok=True).count() == 2
    with pytest.raises(KeyError, match="77"):
        L.select_reads(reads, absent)
    with pytest.raises(IndexError):
        L.read_batch(reads, "f", 9)
    moved = reads.withColumn("read_id", F.when(F.col("read_id") == 3, 33).otherwise(F.col("read_id")))
    assert [tuple(r) for r in L.verify_index(L.build_index(reads), moved).collect()] == [(3, 33)]
    with pytest.raises(Exception, match="no value"):
        L.checked_dictionary(reads, "source_file", ["g"]).collect()
    files = spark.createDataFrame([("f", "id1", 10)], "source_file string, file_id string, size long")
    L.check_binding(files, files)
    with pytest.raises(ValueError, match="stale"):
        L.check_binding(files, files.withColumn("size", F.lit(11).cast("long")))
    named = spark.createDataFrame([("x",), ("00000000-0000-0000-0000-000000000001",)], "name string")
    by_uuid = spark.createDataFrame([("00000000-0000-0000-0000-000000000001",)], "read_id string")
    assert L.filter_by_alignments(by_uuid, named).count() == 1
    with pytest.raises(ValueError):
        L.filter_by_alignments(by_uuid, named.where("name = 'x'"))


def test_inputs(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "read_id").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(5, 7).withColumnRenamed("id", "read_id").coalesce(1).write.parquet(str(tmp_path / "a" / "deep"))
    (tmp_path / "empty").mkdir()
    assert len(discovery.resolve_inputs(spark, str(tmp_path / "a"))) == 1
    assert len(discovery.resolve_inputs(spark, [str(tmp_path / "a")] * 2, recursive=True)) == 2
    both = discovery.open_dataset(spark, str(tmp_path / "a"), recursive=True)
    assert both.count() == 5 and both.select("source_file").distinct().count() == 2
    for bad in (str(tmp_path / "empty"), str(tmp_path / "nope")):
        with pytest.raises(FileNotFoundError):
            discovery.resolve_inputs(spark, bad)


def test_text_tables(spark, tmp_path):
    p = tmp_path / "b.csv.gz"
    p.write_bytes(gzip.compress(b"uuid,start,end\nr1,5,50\nr2,9,x\n"))
    assert sorted(tuple(r) for r in discovery.read_boundaries(spark, str(p)).collect()) == [("r1", 5, 50), ("r2", 9, None)]
    p = tmp_path / "f.csv"
    p.write_text("read_id,barcode,fp_0,fp_1\nr1,B1,1,2\nr2,,3,x\nr3,B2,4,5\n")
    assert sorted((r.barcode, r["values"]) for r in discovery.read_fingerprints(spark, str(p)).collect()) == [("B1", [1.0, 2.0]), ("B2", [4.0, 5.0])]
    rows, dropped = discovery.read_labelled_fingerprints(spark, str(p), 3)
    assert rows.count() == 0 and dropped.first().dropped == 2
    sinks.write_fingerprints(discovery.read_fingerprints(spark, str(p)), str(tmp_path / "o.parquet"), 2)
    assert discovery.read_fingerprints(spark, str(tmp_path / "o.parquet")).count() == 2
    p = tmp_path / "bc.csv"
    p.write_text("name,sequence\nB1,acgt\nB2,GGTA\n")
    assert [tuple(r) for r in discovery.read_barcodes(spark, str(p)).orderBy("ord").collect()] == [("B1", "ACGT", 0), ("B2", "GGTA", 1)]
    for bad in ("name,sequence\nB1,ACGT\nB1,ACGA\n", "name,sequence\nB1,ACGN\n", "name\nB1\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            discovery.read_barcodes(spark, str(p))
    p = tmp_path / "k.tsv"
    full = [a for a in "ACGT"]
    p.write_text("".join(f"{k}\t{i}.5\n" for i, k in enumerate(full)))
    assert discovery.read_kmer_table(spark, str(p)).count() == 4
    for bad in ("A\t1\nC\t2\nG\t3\n", "A\t1\nC\t2\nG\t3\nT\tx\n", "AA\t1\n", "A\t1\t2\nC\t2\nG\t3\nT\t4\n", "A\t1\nA\t2\nG\t3\nT\t4\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            discovery.read_kmer_table(spark, str(p))


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("r1", "A", 1.5), ("r2", None, None)], "read_id string, barcode string, v double")
    header, lines = sinks.view_lines(table, ",")
    assert header == "read_id,barcode,v" and sorted(r.value for r in lines.collect()) == ["r1,A,1.5", "r2,,"]
    out = str(tmp_path / "v")
    sinks.write_view(table, out, header=False)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["r1\tA\t1.5", "r2\t\t"]
    with pytest.raises(Exception):
        sinks.write_view(table, out)
    assert json.loads(sinks.summary_json(table.where("v is not null"))) == {"read_id": "r1", "barcode": "A", "v": 1.5}
    sinks.write_per_barcode(table, str(tmp_path / "b"))
    assert sorted(r.barcode for r in spark.read.parquet(str(tmp_path / "b")).collect()) == ["A", "unclassified"]
    sinks.write_per_barcode(table, str(tmp_path / "c"), classified_only=True)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    sinks.write_annotations(table.withColumn("source_file", F.lit("f")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("source_file = 'f'").count() == 2
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert sinks.repack(spark, str(tmp_path / "p"), str(tmp_path / "q"), 3) and not sinks.repack(spark, str(tmp_path / "p"), str(tmp_path / "q"), 3)
    assert len(list((tmp_path / "q").glob("*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "q")).count() == 10
    with pytest.raises(ValueError):
        sinks.check_output(out, [out])
    with pytest.raises(FileExistsError):
        sinks.check_output(out, [])


@pytest.mark.parametrize(
    "n, end, margin, shift, start",
    [
        (100, 60, 10, 0, 40), (100, 30, 10, 0, 10), (100, 29, 10, 0, None), (100, 29, 10, 20, None), (100, 20, 0, 0, 0),  # behind the margin or refused by it
        (100, 15, 10, 0, None), (100, 15, 10, 4, None), (100, 15, 10, 5, 0), (20, 1, 10, 19, 0), (19, 15, 10, 5, None),  # moved to the start, as far as allowed
        (100, 0, 10, 20, None), (100, None, 10, 20, None), (100, 101, 10, 20, None), (100, 100, 10, 0, 80), (0, 0, 0, 20, None),  # no end, an end past the signal
    ],
)
def test_lattice_window(spark, n, end, margin, shift, start):
    df = spark.createDataFrame([([float(i) for i in range(n)], end)], "x array<double>, e int")
    got = df.select(
        P.lattice_window_start(F.size("x"), F.col("e"), 20, margin, shift).alias("start"),
        P.lattice_input(F.col("x"), F.col("e"), F.lit(2.0), F.lit(0.5), 3.0, 4.0, 20, margin, shift).alias("y"),
    ).first()
    assert got.start == start
    assert got.y == (None if start is None else [((i + 2.0) * 0.5 - 3.0) / 4.0 for i in range(start, start + 20)])


def test_lattice_window_without_a_signal(spark):
    df = spark.createDataFrame([(None, 5)], "x array<double>, e int")
    assert df.select(P.lattice_input(F.col("x"), F.col("e"), F.lit(0.0), F.lit(1.0), 0.0, 1.0, 3).alias("y")).first().y is None
