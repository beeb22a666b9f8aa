"""The shared folder, tables written to it, and joins with hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.llm import common


class _Cluster:
    """A session on a cluster whose folder is unset."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(_Cluster)


class _OneProcess(_Cluster):
    class sparkContext:
        master, applicationId = "local[2]", "app"


def test_unset_folder_in_one_process():
    folder = common.scratch_dir(_OneProcess)
    assert os.path.isdir(folder) and folder == common.scratch_dir(_OneProcess)


def test_written_tables_can_be_discarded(spark):
    folder = common.scratch_dir(spark).removeprefix("file://")
    df = common.materialize(spark.range(5))
    before = set(os.listdir(folder))
    assert df.count() == 5
    common.discard(df)
    assert len(before - set(os.listdir(folder))) == 1
    common.discard(spark.range(3))  # not written: nothing happens


@pytest.mark.parametrize("hot_keys", [1, 4, 10**9])
def test_join_hot_equals_join(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    left = spark.range(300).select(F.when(F.col("id") < 150, F.lit(0)).when(F.col("id") < 290, F.col("id") % 9).alias("k"), F.col("id").alias("x"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("most"))
    right = right.where("k <> 5").unionByName(spark.createDataFrame([(77, 0, 1)], right.schema))
    want = sorted(tuple(r) for r in left.join(right.drop("n"), "k").collect())
    assert sorted(tuple(r) for r in common.join_hot(left, right, "k", "n", 300).collect()) == want
    assert common.join_hot(left.limit(0), right, "k", "n", 0).count() == 0
