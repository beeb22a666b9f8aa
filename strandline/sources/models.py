"""Model files: boosted trees, support vectors and reference banks told apart by their keys, checked, and read into tables or columns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.functions.preparation import check_trees
from strandline.operators import support_vectors

#: Fixed names: feature sets whose columns are only selected, and those whose dwells are changed per read; statistics of a base.
PLAIN_SETS = ("all", "no_dwell", "dwell_only", "level_only", "resid_only", "level_resid")
CHANGED_SETS = ("rel_dwell", "all_rel")
STATISTICS = ("dwell", "mean", "std", "resid")


def model_kind(spark: SparkSession, path: str) -> str:
    """``trees``, ``svm`` or ``bank``; a file that is none of them is an error. Trees come first, since they have a label mapper too."""
    names = set(spark.read.option("multiLine", True).json(path).columns)
    if "_corrupt_record" in names or not names:
        raise ValueError(f"{path} is not a JSON object")
    if "trees" in names or ("model_type" in names and spark.read.option("multiLine", True).json(path).where("model_type = 'gbm'").head(1)):
        return "trees"
    if "label_mapper" in names:
        return "svm"
    if "label_map" in names:
        return "bank"
    raise ValueError(f"{path} has neither trees nor label_mapper nor label_map")


def read_trees(spark: SparkSession, path: str) -> tuple[list[dict], list[float], dict]:
    """(forest, baseline, settings) of a boosted ensemble, as ``preparation.trees`` takes them; checked by ``check_trees``.

    The file has trees by iteration and class, each a list of nodes (feature, threshold, left, right,
    missing_left, value, leaf). settings: n_features, n_classes, labels, thresholds.
    """
    row = spark.read.option("multiLine", True).json(path).first().asDict(True)
    missing = {"trees", "baseline", "n_features", "n_classes"} - set(row)
    if missing:
        raise ValueError(f"not in {path}: {', '.join(sorted(missing))}")
    forest = []
    for iteration in row["trees"]:
        if len(iteration) != len(row["baseline"]):
            raise ValueError(f"{path}: {len(iteration)} trees in an iteration of {len(row['baseline'])} outputs")
        for c, nodes in enumerate(iteration):
            field = lambda name, leaf: [leaf if n["leaf"] else n[name] for n in nodes]  # noqa: B023, E731
            forest.append({"feature": field("feature", -1), "threshold": field("threshold", 0.0), "left": field("left", 0), "right": field("right", 0), "missing_left": [bool(n.get("missing_left")) for n in nodes], "value": [n["value"] for n in nodes], "class": c})
    sigmoid = (row.get("head") or "softmax") == "sigmoid"
    if (sigmoid and (len(row["baseline"]) != 1 or row["n_classes"] != 2)) or (not sigmoid and len(row["baseline"]) != row["n_classes"]):
        raise ValueError(f"{path}: {len(row['baseline'])} outputs do not fit {row['n_classes']} classes")
    if row.get("thresholds") and len(row["thresholds"]) != row["n_classes"]:
        raise ValueError(f"{path}: {len(row['thresholds'])} thresholds for {row['n_classes']} classes")
    check_trees(forest, row["n_features"], row["n_classes"])
    return forest, [float(b) for b in row["baseline"]], {"n_features": row["n_features"], "n_classes": row["n_classes"], "labels": row.get("label_mapper"), "thresholds": row.get("thresholds")}


def read_bank(spark: SparkSession, path: str) -> tuple:
    """(references (support_id, label, x), settings) of a bank of labelled fingerprints with a threshold and kernel parameters."""
    text = spark.read.option("multiLine", True).json(path)
    missing = {"training_fingerprints", "training_labels", "kernel_params", "label_map", "threshold"} - set(text.columns)
    if missing:
        raise ValueError(f"not in {path}: {', '.join(sorted(missing))}")
    settings = text.select("kernel_params", "label_map", "threshold", F.size("training_fingerprints").alias("n"), F.size("training_labels").alias("m"), F.array_distinct(F.transform("training_fingerprints", F.size)).alias("lengths")).first().asDict(True)
    if not settings["n"] or settings["n"] != settings["m"] or len(settings["lengths"]) != 1:
        raise ValueError(f"{path}: fingerprints and labels do not fit each other")
    rows = text.select(F.posexplode(F.arrays_zip(F.col("training_fingerprints").alias("x"), F.col("training_labels").alias("label"))).alias("at", "r"))
    return rows.select(F.col("at").cast("long").alias("support_id"), F.col("r.label").cast("int").alias("label"), F.col("r.x").cast("array<double>").alias("x")), settings


def open_model(spark: SparkSession, path: str) -> tuple[str, tuple]:
    """(kind, what the kind's reader gives)."""
    kind = model_kind(spark, path)
    return kind, {"trees": read_trees, "svm": support_vectors.read_model, "bank": read_bank}[kind](spark, path)


def check_feature_set(name: str) -> None:
    """Refuse feature sets whose columns are not what their names say: those that are divided by the read's dwell, and unknown ones.

    A name is ``<statistics>``, ``<statistics>@<offsets>`` or an offset rule alone (collapse_safe, arm_le and a number).
    """
    statistics = name.split("@", 1)[0]
    if statistics == name and (name == "collapse_safe" or re.fullmatch("arm_le[0-9]+", name)):
        return
    if statistics in CHANGED_SETS:
        raise ValueError(f"the dwells of {name} are relative to each read's; columns are only selected here")
    if statistics not in PLAIN_SETS:
        raise ValueError(f"unknown feature set {name}")


def feature_cells(names: list[str], offsets: list[int]) -> list[int]:
    """Cells of the feature grid (offsets x STATISTICS) that columns named ``b<signed offset>_<statistic>`` stand for."""
    cells = []
    for name in names:
        m = re.fullmatch(r"b([+-]?[0-9]+)_(\w+)", name)
        if not m or int(m[1]) not in offsets or m[2] not in STATISTICS:
            raise ValueError(f"no feature {name}")
        cells.append(offsets.index(int(m[1])) * len(STATISTICS) + STATISTICS.index(m[2]))
    return cells
