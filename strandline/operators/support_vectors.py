"""Support vector machines on warping distances: distance matrix, training, model tables and decisions.

A model is tables: supports (support_id, label, x), and coefficients (class_i, class_j, support_id, coef) with
class_i < class_j, sparse, where the row without a support holds the pair's intercept. A positive decision
is for class_i. What a model is trained on is a bounded sample per class; what it is applied to is not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.arrays import rbf
from strandline.operators import kernels as K
from strandline.operators.summary import reservoir

#: References that a bank or a training sample may have at most; more are refused, since banks travel to every task.
MOST_REFERENCES = 20_000
MODEL = "class_i int, class_j int, support_id long, coef double"


@dataclass
class SvmModel:
    supports: DataFrame
    coefficients: DataFrame
    gamma: float
    power: float = 2.0
    window: int | None = None
    penalty: float = 0.0


def _bounded(df: DataFrame, most: int = MOST_REFERENCES) -> int:
    n = df.count()
    if n > most:
        raise ValueError(f"{n} references; at most {most} can be used")
    return n


# --- distances -----------------------------------------------------------------------------------


def distances_to(queries: DataFrame, bank: DataFrame, window: int | None = None, penalty: float = 0.0) -> DataFrame:
    """(id, support_id, distance) of every query (id, x) to every reference (support_id, x) of a bank of at most MOST_REFERENCES."""
    _bounded(bank)
    rows = bank.select("support_id", F.col("x").cast("array<double>").alias("x")).orderBy("support_id").toPandas()
    ids, parts = rows.support_id.tolist(), K.by_length([np.asarray(x) for x in rows.x], lambda m: [len(m[0])] * len(m)) if len(rows) else []
    if len(set(parts)) > 1:
        raise ValueError("references of a bank have one length")
    matrix = np.stack([np.asarray(x) for x in rows.x]) if len(rows) else np.zeros((0, 1))
    found = K.batched(lambda xs: [d.tolist() for d in K.dtw_rows(xs, matrix, window, penalty)], "array<double>")
    named = queries.select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, ids)).alias("support_id"), found(F.col("x").cast("array<double>")).alias("distance"))).alias("d")) if ids else None
    return named.select("id", F.col("d.support_id").cast("long").alias("support_id"), "d.distance") if named is not None else queries.select("id", F.lit(0).cast("long").alias("support_id"), F.lit(0.0).alias("distance")).limit(0)


def distance_matrix(fingerprints: DataFrame, window: int | None = None, penalty: float = 0.0, block: int = 64, most: int = MOST_REFERENCES) -> DataFrame:
    """(a, b, distance) of all pairs of ids of a bounded reference set (id, x), both ways and with the zero diagonal.

    Only the upper triangle is computed, a pair of blocks of ``block`` fingerprints at a time, and mirrored.
    Repeated ids and null arrays are refused.
    """
    n = _bounded(fingerprints, most)
    ranked = fingerprints.select("id", F.col("x").cast("array<double>").alias("x"), (F.row_number().over(Window.orderBy("id")) - 1).alias("at"))
    of = F.floor(F.col("at") / block).cast("int")
    packed = ranked.groupBy(of.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "x"))).alias("rows"))
    last = max((n - 1) // block, 0)
    left = packed.select("block", F.col("rows").alias("left"), F.explode(F.sequence("block", F.lit(last))).alias("other"))
    pairs = left.join(packed.select(F.col("block").alias("other"), F.col("rows").alias("right")), "other").select("block", "other", "left", "right").repartition("block", "other")

    def measure(batches):
        for t in batches:
            for p in t.itertuples():
                ids, xs = [r["id"] for r in p.right], [np.asarray(r["x"], float) for r in p.right]
                for r in p.left:
                    ok = [k for k, o in enumerate(p.right) if o["at"] > r["at"]]
                    if ok:
                        x = np.asarray(r["x"], float)
                        d = [K.dtw_many(x, np.stack([xs[k]]), window, penalty)[0] for k in ok] if len({len(xs[k]) for k in ok}) > 1 else K.dtw_many(x, np.stack([xs[k] for k in ok]), window, penalty)
                        yield pd.DataFrame({"a": r["id"], "b": [ids[k] for k in ok], "distance": d})

    upper = pairs.mapInPandas(measure, "a long, b long, distance double")
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    mirrored = upper.select(both, "distance").select("p.a", "p.b", "distance")
    return mirrored.unionByName(fingerprints.select(F.col("id").cast("long").alias("a"), F.col("id").cast("long").alias("b"), F.lit(0.0).alias("distance")))


# --- training ------------------------------------------------------------------------------------


def solve_pair(kernel: np.ndarray, y: np.ndarray, cost: float, tolerance: float = 1e-4, most_steps: int = 200_000) -> tuple[np.ndarray, float]:
    """Coefficients (alpha times y) and intercept of the soft-margin dual on a precomputed kernel.

    Each step takes the most violating multiplier and the partner that promises the largest decrease
    (second-order working sets: Fan, Chen and Lin 2005), and solves for the two in closed form.
    """
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    diagonal = np.diag(kernel)
    for _ in range(most_steps):
        slope = -y * grad
        up, low = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
        i = int(np.where(up, slope, -np.inf).argmax())
        gap = slope[i] - slope
        if not (low & (gap > tolerance)).any():
            break
        bend = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / bend, -np.inf).argmax())
        step = gap[j] / bend[j]
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] = min(max(alpha[i] + y[i] * step, 0.0), cost)
        alpha[j] = min(max(alpha[j] - y[j] * step, 0.0), cost)
        grad += y * step * (kernel[i] - kernel[j])
    slope = -y * grad
    free = (alpha > 0) & (alpha < cost)
    up, low = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
    intercept = slope[free].mean() if free.any() else (slope[up].max(initial=-cost) + slope[low].min(initial=cost)) / 2
    return alpha * y, float(intercept)


def pair_kernels(matrix: DataFrame, labels: DataFrame, gamma: float, power: float = 2.0) -> DataFrame:
    """(class_i, class_j, a, b, label_a, kernel): what each pair of classes needs of a distance matrix, every entry under its pairs.

    labels: (id, label), of a bounded sample. An entry of two classes belongs to one pair, an entry inside a
    class to that class and each other one.
    """
    classes = sorted(r[0] for r in labels.select("label").distinct().collect())
    if len(classes) < 2:
        raise ValueError("at least two classes are needed")
    named = matrix.join(F.broadcast(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a"))), "a").join(F.broadcast(labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))), "b")
    others = F.when(F.col("label_a") == F.col("label_b"), F.array_remove(F.array(*map(F.lit, classes)), F.col("label_a"))).otherwise(F.array("label_b"))
    each = named.withColumn("other", F.explode(others))
    return each.select(F.least("label_a", "other").alias("class_i"), F.greatest("label_a", "other").alias("class_j"), "a", "b", "label_a", rbf(F.col("distance"), gamma, power).alias("kernel"))


def train(sample: DataFrame, gamma: float, cost: float = 1.0, power: float = 2.0, window: int | None = None, penalty: float = 0.0, per_class: int = 500) -> SvmModel:
    """Train on (id, x, label): one machine for each pair of classes, each a Spark group.

    At most ``per_class`` rows of a class are used, chosen by a hash of the id: a group is a kernel of at
    most (2 * per_class)^2 entries. Fewer than two classes are refused. The coefficients stay cached.
    """
    drawn = reservoir(sample.where("x is not null and label is not null"), "label", "id", per_class)
    kept = drawn.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))
    entries = pair_kernels(distance_matrix(kept, window, penalty), kept.select("id", "label"), gamma, power)

    def fit(key, t):
        ids, at = np.unique(t.a.to_numpy(), return_inverse=True)
        other = np.searchsorted(ids, t.b.to_numpy())
        kernel, y = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        kernel[at, other] = t.kernel.to_numpy()
        y[at] = np.where(t.label_a.to_numpy() == key[0], 1.0, -1.0)
        coef, intercept = solve_pair(kernel, y, cost)
        used = np.flatnonzero(coef)
        return pd.DataFrame({"class_i": key[0], "class_j": key[1], "support_id": pd.array([*ids[used], None], dtype="Int64"), "coef": [*coef[used], intercept]})

    coefficients = entries.groupBy("class_i", "class_j").applyInPandas(fit, MODEL).persist()
    return SvmModel(kept.select(F.col("id").alias("support_id"), "label", "x"), coefficients, gamma, power, window, penalty)


def read_model(spark: SparkSession, path: str) -> tuple[SvmModel, dict]:
    """A model from its JSON file, checked, and its remaining settings (thresholds, prob_a, prob_b, use_kernel_weighted, classes).

    Coefficients come dense, a row for each class but one: of a support of class c, row r belongs to the
    pair with class r + 1 if r >= c, else with class r.
    """
    text = spark.read.option("multiLine", True).json(path)
    missing = {"training_fingerprints", "training_labels", "support_indices", "dual_coef", "intercept", "classes", "kernel_params"} - set(text.columns)
    if missing:
        raise ValueError(f"not in {path}: {', '.join(sorted(missing))}")
    settings = text.select(*[c for c in text.columns if c not in ("training_fingerprints", "training_labels", "dual_coef")], *[F.size(c).alias(f"n_{c}") for c in ("training_fingerprints", "training_labels", "dual_coef")]).first().asDict(True)
    classes, k = settings["classes"], len(settings["classes"])
    inside = all(0 <= i < settings["n_training_fingerprints"] for i in settings["support_indices"])
    if settings["n_training_fingerprints"] != settings["n_training_labels"] or k < 2 or len(settings["intercept"]) != k * (k - 1) // 2 or not inside:
        raise ValueError(f"{path}: labels, classes, intercepts and supports do not fit each other")
    weighted = bool(settings.get("use_kernel_weighted"))
    if not weighted and settings["n_dual_coef"] != k - 1:
        raise ValueError(f"{path}: {settings['n_dual_coef']} rows of coefficients for {k} classes")
    zipped = text.select(F.posexplode(F.arrays_zip(F.col("training_fingerprints").alias("x"), F.col("training_labels").alias("label"))).alias("at", "row"))
    supports = zipped.select(F.col("at").cast("long").alias("support_id"), F.col("row.label").cast("int").alias("label"), F.col("row.x").cast("array<double>").alias("x"))
    local = text.select(F.posexplode("support_indices").alias("local", "support_id")).select("local", F.col("support_id").cast("long").alias("support_id"))
    cells = text.select(F.posexplode("dual_coef").alias("row", "values")).select("row", F.posexplode("values").alias("local", "coef"))
    names = F.array(*map(F.lit, classes))
    own = (F.array_position(names, F.col("label")) - 1).cast("int")
    placed = cells.join(local, "local").join(supports.select("support_id", "label"), "support_id").select("support_id", own.alias("c"), "row", "coef")
    other = F.when(F.col("row") >= F.col("c"), F.col("row") + 1).otherwise(F.col("row"))
    pairs = placed.select(F.least("c", other).alias("i"), F.greatest("c", other).alias("j"), "support_id", "coef").where("coef <> 0")
    indices = [(i, j) for i in range(k) for j in range(i + 1, k)]
    intercepts = spark.createDataFrame([(i, j, None, float(b)) for (i, j), b in zip(indices, settings["intercept"])], "i int, j int, support_id long, coef double")
    coefficients = pairs.unionByName(intercepts).select(F.get(names, F.col("i")).cast("int").alias("class_i"), F.get(names, F.col("j")).cast("int").alias("class_j"), "support_id", "coef")
    parameters = settings["kernel_params"]
    return SvmModel(supports, coefficients, float(parameters["gamma"]), float(parameters.get("power", 2.0)), settings.get("window"), float(settings.get("penalty") or 0.0)), settings


# --- decisions -----------------------------------------------------------------------------------


def kernel_rows(queries: DataFrame, model: SvmModel, used_only: bool = True) -> DataFrame:
    """(id, support_id, kernel) of queries (id, x) and the model's supports; ``used_only``: those that have a coefficient."""
    bank = model.supports
    if used_only:
        bank = bank.join(model.coefficients.where("support_id is not null").select("support_id").distinct(), "support_id", "left_semi")
    found = distances_to(queries, bank, model.window, model.penalty)
    return found.select("id", "support_id", rbf(F.col("distance"), model.gamma, model.power).alias("kernel"))


def decisions(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(id, i, j, decision) from kernel rows (id, support_id, kernel): a join on the support, one grouped sum, the intercept.

    A query's kernel rows are made in one task, so the sums are nearly all done before the shuffle. A
    pair without a support has no row.
    """
    weights = coefficients.where("support_id is not null")
    summed = rows.join(weights, "support_id").groupBy("id", "class_i", "class_j").agg(F.sum(F.col("coef") * F.col("kernel")).alias("sum"))
    offsets = coefficients.where("support_id is null").select("class_i", "class_j", F.col("coef").alias("intercept"))
    return summed.join(F.broadcast(offsets), ["class_i", "class_j"]).select("id", F.col("class_i").alias("i"), F.col("class_j").alias("j"), (F.col("sum") + F.col("intercept")).alias("decision"))


def weighted_decisions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, i, j, decision) without coefficients: the difference of the classes' mean kernels. labels: (support_id, label)."""
    means = rows.join(F.broadcast(labels), "support_id").groupBy("id", "label").agg(F.avg("kernel").alias("mean"))
    scores = means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("s"))  # a row for each class
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["label"] > a["label"]), lambda b: F.struct(a["label"].alias("i"), b["label"].alias("j"), (a["mean"] - b["mean"]).alias("decision")))))
    return scores.select("id", F.inline(pairs))


def winners(pairs: DataFrame) -> DataFrame:
    """(id, label, votes): the class with most votes of (id, i, j, decision), of equals the smaller; a decision of 0 votes for j."""
    votes = pairs.groupBy("id", F.when(F.col("decision") > 0, F.col("i")).otherwise(F.col("j")).alias("label")).agg(F.count("*").alias("votes"))
    return votes.groupBy("id").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("w")).select("id", "w.label", "w.votes")
