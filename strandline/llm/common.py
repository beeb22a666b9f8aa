"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls TAB..CR.
SPACES = "[\\x20\\x09-\\x0D]+"
#: A key with more than one row in so many is joined by broadcast; there are fewer such keys than this.
HOT_KEYS = 4096
_OWN: dict[str, str] = {}
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, which a cluster must set.

    Only a session whose executors run inside the driver (``local[...]``, as in tests) may leave it
    unset; it then gets a temporary folder, the same one all along.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-strandline-")
    return _OWN[app]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it again.

    The files are deleted when the session's JVM ends, or by ``discard`` before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[read] = path
    return read


def discard(df: DataFrame | None) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = _WRITTEN.pop(df, None) if df is not None else None
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``size`` the key's rows in ``left``.

    Keys that hold more than one row in HOT_KEYS of ``total`` are joined by broadcast, so no task
    gathers them; there are fewer than HOT_KEYS such keys. The others are joined by shuffle.
    """
    hot = F.col(size) * HOT_KEYS > F.lit(total)
    names = [c for c in right.columns if c not in (key, size)]
    few = right.where(hot).select(key, *[F.col(c).alias(f"__hot_{c}") for c in names], F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(few), key, "left")
    direct = marked.where("__hot").select(*left.columns, *[F.col(f"__hot_{c}").alias(c) for c in names])
    others = marked.where("__hot is null").select(*left.columns).join(right.where(~hot).select(key, *names), key)
    return direct.unionByName(others.select(*left.columns, *names))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """Only the columns an operator works on, so further columns can't clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")
