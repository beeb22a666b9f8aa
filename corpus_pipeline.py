"""The corpus pipeline: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A driver writes each result as Parquet and reads it as the next stage's input.

All stages take rows as they come: a null text counts as empty, an empty table gives an empty table,
and further columns are handed on unchanged, whatever their names. Repeated rows are scored, searched
and packed each for itself; only the near-duplicate stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import packing, pii, simhash, substring_dedup, toxicity
from strandline.llm.common import materialize, table

#: The stages have no SQL form; tests hold each against a plain version.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier predicts toxic go. Null and empty texts stay unless nearly all labelled rows are toxic; null ids are scored like others."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once. All empty and null texts are one group; rows without an id always stay."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words and more that a document with a smaller id has too go; a document may end up empty. Null texts stay null; rows without an id neither lose words nor make others lose any."""
    return _measured(substring_dedup.drop_repeats(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. A null text stays null."""
    return _measured(pii.redact(docs, pii.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none across documents. A null or empty text is the end id alone."""
    return packing.pack_powers_of_two(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
