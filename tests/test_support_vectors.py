"""Support vectors: the solver against a plain one, models against direct sums, distances against all pairs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import kernels as K
from strandline.operators import support_vectors as V


def plain_solver(kernel, y, cost, rounds=3000):
    """Every pair of multipliers in turn, until no pair moves."""
    alpha, n = np.zeros(len(y)), len(y)
    q = kernel * np.outer(y, y)
    for _ in range(rounds):
        moved = 0.0
        for i in range(n):
            for j in range(i):
                g = q @ alpha - 1
                bend = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
                t = (y[j] * g[j] - y[i] * g[i]) / bend
                low_i, high_i = ((-alpha[i], cost - alpha[i]) if y[i] > 0 else (alpha[i] - cost, alpha[i]))
                low_j, high_j = ((alpha[j] - cost, alpha[j]) if y[j] > 0 else (-alpha[j], cost - alpha[j]))
                t = min(max(t, low_i, low_j), high_i, high_j)
                alpha[i] += y[i] * t
                alpha[j] -= y[j] * t
                moved = max(moved, abs(t))
        if moved < 1e-9:
            break
    return alpha


@pytest.mark.parametrize(("cost", "spread", "seed"), [(1.0, 1.0, 1), (10.0, 0.4, 2), (0.1, 2.0, 3), (5.0, 1.5, 4)])
def test_solver_reaches_the_optimum_of_a_plain_one(cost, spread, seed):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(24) % 3, 1.0, -1.0)
    x = y[:, None] * 0.7 + spread * rng.normal(size=(24, 3))
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    coef, intercept = V.solve_pair(kernel, y, cost, tolerance=1e-7)
    want = plain_solver(kernel, y, cost)
    value = lambda a: a.sum() - 0.5 * (a * y) @ kernel @ (a * y)
    assert value(coef * y) == pytest.approx(value(want), rel=1e-6)
    assert coef.sum() == pytest.approx(0, abs=1e-9) and (coef * y >= 0).all() and (coef * y <= cost + 1e-12).all()
    margin, alpha = y * (kernel @ coef + intercept), coef * y
    assert (margin[alpha <= 1e-9] >= 1 - 1e-4).all() and (margin[alpha >= cost - 1e-9] <= 1 + 1e-4).all()
    assert margin[(alpha > 1e-9) & (alpha < cost - 1e-9)] == pytest.approx(1, abs=1e-4)


def test_equal_rows_of_both_classes():
    coef, intercept = V.solve_pair(np.ones((4, 4)), np.array([1.0, 1.0, -1.0, -1.0]), 2.0)
    assert np.isfinite(coef).all() and np.isfinite(intercept)


def classes(spark, per_class=25, seed=5):
    rng = np.random.default_rng(seed)
    centres = {3: 0.0, 5: 1.0, 8: -1.2}
    rows = [(i * 10 + c, [float(v) for v in m + 0.3 * rng.normal(size=8)], c) for c, m in centres.items() for i in range(per_class)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, label int")


def test_training_and_decisions(spark):
    rows, df = classes(spark)
    model = V.train(df, gamma=0.5, cost=3.0, window=1, penalty=0.1)
    made = model.coefficients.collect()
    x, label = {r[0]: np.array(r[1]) for r in rows}, {r[0]: r[2] for r in rows}
    want = {}
    for i, j in ((3, 5), (3, 8), (5, 8)):
        ids = sorted(k for k in x if label[k] in (i, j))
        kernel = np.exp(-0.5 * np.square([[K.dtw(x[a], x[b], 1, 0.1) for b in ids] for a in ids]))
        coef, intercept = V.solve_pair(kernel, np.array([1.0 if label[k] == i else -1.0 for k in ids]), 3.0)
        got = {r["support_id"]: r["coef"] for r in made if (r["class_i"], r["class_j"]) == (i, j)}
        assert got.pop(None) == pytest.approx(intercept, abs=1e-9)
        assert got == pytest.approx({k: c for k, c in zip(ids, coef) if c})
        for k in x:
            want[k, i, j] = intercept + sum(c * np.exp(-0.5 * K.dtw(x[k], x[s], 1, 0.1) ** 2) for s, c in zip(ids, coef))
    found = V.decisions(V.kernel_rows(df.select("id", "x"), model), model.coefficients)
    assert {(r["id"], r["i"], r["j"]): r["decision"] for r in found.collect()} == pytest.approx(want)
    called = {r["id"]: r["label"] for r in V.winners(found).collect()}
    assert sum(called[k] == label[k] for k in x) >= 0.95 * len(x)


def test_training_sample_is_bounded_and_bad_input_refused(spark):
    rows, df = classes(spark)
    assert V.train(df, 0.5, per_class=7, window=0).supports.groupBy("label").count().agg(F.max("count")).first()[0] == 7
    with pytest.raises(ValueError, match="two classes"):
        V.train(df.where("label = 3"), 0.5, window=0)
    with pytest.raises(ValueError, match="at most"):
        V.distance_matrix(df.select("id", "x"), most=10)
    with_nulls = df.unionByName(spark.createDataFrame([(1, None, 3), (2, [0.0] * 8, None)], df.schema))
    assert V.train(with_nulls, 0.5, window=0).supports.count() == len(rows)


@pytest.mark.parametrize(("window", "penalty", "block"), [(None, 0.0, 64), (3, 0.5, 7), (0, 0.0, 1)])
def test_distance_matrix_equals_all_pairs(spark, window, penalty, block):
    rng = np.random.default_rng(6)
    x = {7 * i: rng.normal(size=6 + (i % 2 if block == 7 else 0)).tolist() for i in range(200)}
    df = spark.createDataFrame(list(x.items()), "id long, x array<double>")
    got = {(r["a"], r["b"]): r["distance"] for r in V.distance_matrix(df, window, penalty, block).collect()}
    assert len(got) == 40000 and all(got[i, i] == 0 for i in x)
    assert all(got[a, b] == got[b, a] for a, b in got)
    for a in list(x)[::9]:
        for b in x:
            if a != b:
                assert got[a, b] == pytest.approx(K.dtw(x[a], x[b], window, penalty)) or got[a, b] == K.dtw(x[a], x[b], window, penalty)
    assert V.distance_matrix(df.limit(0)).count() == 0


def test_model_file(spark, tmp_path):
    rng = np.random.default_rng(8)
    labels = [20, 10, 30, 10, 20, 30]
    model = {
        "training_fingerprints": rng.normal(size=(6, 4)).tolist(), "training_labels": labels, "support_indices": [0, 1, 2, 4, 5], "dual_coef": rng.normal(size=(2, 5)).tolist(), "intercept": [0.1, -0.2, 0.3],
        "classes": [10, 20, 30], "kernel_params": {"gamma": 0.4, "power": 1.5}, "window": 2, "penalty": 0.2, "use_kernel_weighted": False, "thresholds": [0.1, 0.2, 0.3],
    }
    path = f"{tmp_path}/m.json"
    open(path, "w").write(json.dumps(model))
    read, settings = V.read_model(spark, f"file://{path}")
    assert (read.gamma, read.power, read.window, read.penalty) == (0.4, 1.5, 2, 0.2) and settings["thresholds"] == [0.1, 0.2, 0.3]
    q = rng.normal(size=(5, 4))
    got = {(r["id"], r["i"], r["j"]): r["decision"] for r in V.decisions(V.kernel_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>"), read), read.coefficients).collect()}
    for n, v in enumerate(q):
        kernel = {s: np.exp(-0.4 * K.dtw(v, model["training_fingerprints"][s], 2, 0.2) ** 1.5) for s in model["support_indices"]}
        pair = 0
        for i in range(3):
            for j in range(i + 1, 3):
                total = model["intercept"][pair]
                for at, s in enumerate(model["support_indices"]):
                    c = model["classes"].index(labels[s])
                    total += (model["dual_coef"][j - 1][at] if c == i else model["dual_coef"][i][at] if c == j else 0) * kernel[s]
                assert got[n, model["classes"][i], model["classes"][j]] == pytest.approx(total)
                pair += 1
    for change in ({"intercept": [1.0]}, {"support_indices": [0, 9]}, {"dual_coef": [[1.0]]}, {"training_labels": [1]}):
        open(path, "w").write(json.dumps(model | change))
        with pytest.raises(ValueError):
            V.read_model(spark, path)
    open(path, "w").write(json.dumps({"classes": [1, 2]}))
    with pytest.raises(ValueError, match="dual_coef"):
        V.read_model(spark, path)
