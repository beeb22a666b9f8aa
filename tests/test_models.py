"""Model files, rescaling against numpy, the classification chain and its counts."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import preparation as P
from strandline.functions import rescaling as S
from strandline.functions import sequences as Q
from strandline.operators import anchoring as N
from strandline.operators import catalog as L
from strandline.plans import models as M
from strandline.sources import models as files

LEAF = {"feature": 0, "threshold": 0.0, "left": 0, "right": 0, "missing_left": False, "leaf": True}
TREE = [{"feature": 1, "threshold": 0.5, "left": 1, "right": 2, "missing_left": True, "value": 0.0, "leaf": False}, LEAF | {"value": -1.0}, LEAF | {"value": 2.0}]
TREES = {"model_type": "gbm", "head": "softmax", "n_classes": 2, "n_features": 2, "baseline": [0.1, 0.2], "trees": [[TREE, TREE], [[LEAF | {"value": 0.25}], TREE]], "label_mapper": {"0": 5, "1": 7}, "thresholds": [0.1, 0.3]}
BANK = {"training_fingerprints": [[1.0, 2.0], [3.0, 4.0]], "training_labels": [1, 2], "kernel_params": {"gamma": 0.5}, "label_map": {"BC01": 1, "BC02": 2}, "threshold": 0.8}


def saved(tmp_path, value, name="m.json"):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return f"file://{path}"


def test_trees_from_a_file(spark, tmp_path):
    path = saved(tmp_path, TREES)
    kind, (forest, baseline, settings) = files.open_model(spark, path)
    assert kind == "trees" and settings["thresholds"] == [0.1, 0.3] and settings["n_classes"] == 2
    rows = spark.createDataFrame([([0.0, 0.4],), ([0.0, 0.9],), ([0.0, None],)], "x array<double>")
    got = [r["p"] for r in rows.select(P.trees(F.col("x"), forest, baseline).alias("p")).collect()]
    for p, at in zip(got, (-1.0, 2.0, -1.0)):
        raw = np.exp([0.1 + at + 0.25, 0.2 + 2 * at])
        assert p == pytest.approx(raw / raw.sum())


@pytest.mark.parametrize("change", [{"baseline": [0.1]}, {"n_features": 1}, {"thresholds": [0.1]}, {"head": "sigmoid"}, {"trees": [[TREE]]}, {"trees": [[TREE[:2], TREE]]}])
def test_bad_trees_are_refused(spark, tmp_path, change):
    with pytest.raises(ValueError):
        files.read_trees(spark, saved(tmp_path, TREES | change))


def test_kinds(spark, tmp_path):
    kind, (references, settings) = files.open_model(spark, saved(tmp_path, BANK))
    assert kind == "bank" and settings["threshold"] == 0.8
    assert sorted((r["support_id"], r["label"], r["x"]) for r in references.collect()) == [(0, 1, [1.0, 2.0]), (1, 2, [3.0, 4.0])]
    assert files.model_kind(spark, saved(tmp_path, {"label_mapper": {"0": 1}, "classes": [1]}, "s.json")) == "svm"
    for bad in ({"a": 1}, "not json"):
        with pytest.raises(ValueError):
            files.model_kind(spark, saved(tmp_path, bad, "b.json"))
    for change in ({"training_labels": [1]}, {"training_fingerprints": [[1.0], [2.0, 3.0]]}):
        with pytest.raises(ValueError):
            files.read_bank(spark, saved(tmp_path, BANK | change, "c.json"))


def test_feature_sets_and_columns():
    for ok in ("all", "level_resid", "collapse_safe", "arm_le12", "no_dwell@arm_le8"):
        files.check_feature_set(ok)
    for bad in ("rel_dwell", "all_rel@arm_le8", "arm_le", "something"):
        with pytest.raises(ValueError):
            files.check_feature_set(bad)
    assert files.feature_cells(["b-1_dwell", "b+2_resid"], [-1, 0, 2]) == [0, 11]
    for bad in ("x", "b+9_dwell", "b+2_other"):
        with pytest.raises(ValueError):
            files.feature_cells([bad], [-1, 0, 2])


def plain_rescale(x, b, levels, shift, scale, drift, clip):
    d = np.diff(b)
    lo, hi = np.quantile(d, [0.1, 0.9])
    keep = [i for i in range(clip, len(levels) - clip) if lo < d[i] < hi and abs(levels[i] - np.mean(levels)) > 0.2]
    if len(keep) < 3:
        return None
    t = np.array([(b[i] + b[i + 1]) / 2 for i in keep])
    norm = (np.array([x[b[i] : b[i + 1]].mean() for i in keep]) - shift - drift * t) / scale
    (a, s, c), *_ = np.linalg.lstsq(np.column_stack([np.ones(len(keep)), norm, t]), np.array(levels)[keep], rcond=None)
    return (shift, scale, drift) if s < 0.01 else (shift - a * scale / s, scale / s, drift - c * scale / s)


def test_rescale_recovers_shift_scale_and_drift(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(30):
        m = int(rng.integers(6, 40))
        levels = rng.normal(size=m)
        b = np.concatenate([[0], np.cumsum(rng.integers(3, 20, m))])
        x = np.repeat(levels, np.diff(b)) * 1.7 + 0.3 + 0.002 * np.arange(b[-1]) + rng.normal(scale=0.01, size=b[-1])
        rows.append((i, x.tolist(), b.tolist(), levels.tolist()))
        want[i] = plain_rescale(x, b, levels, 0.1, 1.5, 0.0005, 2)
    rows.append((99, [1.0], [0, 1], [1.0, 2.0]))
    df = spark.createDataFrame(rows, "id long, x array<double>, b array<long>, levels array<double>")
    now = F.struct(F.lit(0.1).alias("shift"), F.lit(1.5).alias("scale"), F.lit(0.0005).alias("drift"))
    got = {r["id"]: r["s"] for r in df.select("id", S.rescale(F.col("x"), F.col("b"), F.col("levels"), now, clip=2, least_points=3).alias("s")).collect()}
    assert got[99] is None and sum(v is not None for v in want.values()) > 15
    for i, w in want.items():
        assert (got[i] is None) == (w is None)
        if w:
            assert tuple(got[i]) == pytest.approx(w, rel=1e-6, abs=1e-9)
    best = max(want, key=lambda i: len(rows[i][3]))
    assert tuple(got[best]) == pytest.approx((0.3, 1.7, 0.002), abs=0.05)


def test_singular_fits_and_small_slopes(spark):
    now = F.struct(F.lit(0.0).alias("shift"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("drift"))
    one = lambda x, levels: spark.createDataFrame([(x, [0, 2, 4, 6, 9], levels)], "x array<double>, b array<long>, levels array<double>").select(S.rescale(F.col("x"), F.col("b"), F.col("levels"), now, 0.0, 1.0, 0.0, 0, 1).alias("s")).first()["s"]
    assert one([1.0] * 9, [1.0, 2.0, 3.0, 4.0]) is None  # no dwell strictly inside
    wide = spark.createDataFrame([([5.0] * 30, [0, 1, 4, 7, 10, 13, 30], [-1.0, 1.0, -1.0, 1.0, -1.0, 1.0])], "x array<double>, b array<long>, levels array<double>")
    assert tuple(wide.select(S.rescale(F.col("x"), F.col("b"), F.col("levels"), now, 0.0, 1.0, 0.1, 0, 3).alias("s")).first()["s"]) == (0.0, 1.0, 0.0)
    got = spark.range(1).select(S.initial_scaling(F.lit(0.2), F.lit(-10.0), F.lit(12.0), F.lit(80.0)).alias("s")).first()["s"]
    assert tuple(got) == pytest.approx((60.0, 410.0))


def test_dominant_base(spark):
    table = [("".join(k), {"A": 0.0, "C": 1.0, "G": 2.0, "T": 3.0}[k[1]] + 0.001 * i) for i, k in enumerate((a, b, c) for a in "ACGT" for b in "ACGT" for c in "ACGT")]
    assert Q.dominant_base(spark.createDataFrame(table, "kmer string, level double"), 3).first()["position"] == 1


def test_counts_come_with_the_calls(spark):
    calls, seen = M._chain(spark, "/root/testdata/sf0.001")
    rows = calls.select("reason", "p", "cl").collect()
    counts = seen.get
    assert counts["n"] == len(rows) and counts["scored"] == sum(r["p"] is not None for r in rows)
    for reason in ("no_signal", "ns_mismatch", "no_aligned_arm"):
        assert counts[reason] == sum(r["reason"] == reason for r in rows)
    assert counts["over"] == sum((r["p"] or 0) >= 0.5 for r in rows) and all((r["cl"] is None) == (r["p"] is None) for r in rows)


def test_samples_that_cancel_are_called_as_in_sql(spark, tmp_path):
    # Four values repeated, even about their median: any four in a row have the mean 0 up to rounding, and a tree splits there.
    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        p, q = rng.choice(np.arange(1, 150), 2, replace=False)
        four = rng.permutation([-q, -p, p, q]) + rng.integers(400, 600)
        rows.append((i, [float(v) / 1000 for v in np.tile(four, 16)], i % 10))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in M.QUERIES["classified_reads"](spark, f"file://{tmp_path}").collect()]
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(M.ORACLE_SQL["classified_reads"]).fetchall()
    assert sorted(got) == sorted(want) and len({r[3] for r in want}) > 3


def test_span_means_add_from_the_last_sample(spark):
    x = [float.fromhex(v) for v in ("0x1.2ba1f22234705p+0", "0x1.db596ec65174ap-2", "-0x1.f1b1e04a2bb64p-1", "-0x1.533ebb5d65e4bp-1")]
    spans = [(0, 4), (1, 2), (-1, -1), (2, 2), (3, 5), None]
    df = spark.createDataFrame([(x, spans), (None, spans)], "x array<double>, spans array<struct<start:bigint,end:bigint>>")
    whole, missing = (r["s"] for r in df.select(A.span_stats(F.col("x"), F.col("spans")).alias("s")).collect())
    assert whole[0]["mean"] == (((x[3] + x[2]) + x[1]) + x[0]) / 4 < 0 < (((x[0] + x[1]) + x[2]) + x[3]) / 4
    assert tuple(whole[1]) == (1.0, x[1], 0.0)
    assert all(tuple(s) == (None, None, None) for s in [*whole[2:], *missing])


def test_batches_of_uuids(spark):
    rows = [(f"{i * 7919 % 1000:08x}-0000-4000-8000-000000000000", k) for i in range(300) for k in range(3)]
    got = L.chunk_batches(spark.createDataFrame(rows, "read_id string, chunk_idx int"), 64).collect()
    assert [(r["read_id"], r["chunk_idx"]) for r in sorted(got, key=lambda r: r["batch"] * 64 + r["row"])] == sorted(rows)
    assert {(r["batch"] * 64 + r["row"]) for r in got} == set(range(900))
