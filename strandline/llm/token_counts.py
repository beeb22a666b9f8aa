"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the histogram then answer, for every
context limit, how many tokens are kept when longer documents are cut there, how many documents are
longer, and any quantile, without going back to the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.bpe import SLICE_ROWS, SpacedTexts, load_ranks
from strandline.llm.common import documents, materialize, table

#: Lengths of one block share a window; blocks are then summed among themselves.
BLOCK = 256


@functools.lru_cache(maxsize=2)
def counter(path: str) -> SpacedTexts:
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return SpacedTexts(lambda text: len(own.encode_ordinary(text)), sum)


def token_lengths(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each document; null and empty texts have 0 tokens."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n = [texts.text(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], schema=types)

    return documents(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, with prefix and suffix sums.

    n_tokens, n_docs, n_docs_at_most, n_docs_longer, tokens_at_most, tokens_longer (tokens of longer
    documents), total_docs, total_tokens, and truncated_total: the tokens kept if every document is
    cut to n_tokens, that is tokens_at_most + n_tokens * n_docs_longer. Null lengths count as 0; an
    empty table gives no rows.

    Sums run inside blocks of lengths and over the blocks' totals, so no task sorts the histogram as a whole.
    """
    histogram = (
        lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens"))
        .agg(F.count("*").alias("n_docs"))
        .select("*", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    )
    histogram = materialize(histogram)  # a row per length; read twice below, and counting is the dear part
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = (
        histogram.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
            F.sum("d").over(everything).alias("total_docs"),
            F.sum("t").over(everything).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("n_docs_at_most"),
        (F.col("tokens_before") + F.sum("tokens").over(inside)).alias("tokens_at_most"),
        "total_docs",
        "total_tokens",
    )
    longer = F.col("total_docs") - F.col("n_docs_at_most")
    return summed.select(
        "*",
        longer.alias("n_docs_longer"),
        (F.col("total_tokens") - F.col("tokens_at_most")).alias("tokens_longer"),
        (F.col("tokens_at_most") + F.col("n_tokens") * longer).alias("truncated_total"),
    )


def _asked(histogram: DataFrame, name: str, asked: list, kind: str, answer: str, found: Callable[[Any], Column]) -> DataFrame:
    """One row per different value asked for, from one pass over the histogram; none for an empty histogram."""
    asked = list(dict.fromkeys(asked))
    if not asked:
        return histogram.select(F.lit(None).cast(kind).alias(name), F.col("n_tokens").alias(answer)).limit(0)
    once = histogram.agg(F.count("*").alias("rows"), *[found(v).alias(f"a{i}") for i, v in enumerate(asked)]).where("rows > 0")
    pairs = F.array(*[F.struct(F.lit(v).cast(kind).alias(name), F.col(f"a{i}").alias(answer)) for i, v in enumerate(asked)])
    return once.select(F.inline(pairs))


def quantiles(histogram: DataFrame, probabilities: list[float]) -> DataFrame:
    """For each probability p the least length that at least the share p of documents do not exceed, read from the prefix sums; no rows for an empty histogram."""
    return _asked(histogram, "p", probabilities, "double", "n_tokens", lambda p: F.min(F.when(F.col("n_docs_at_most") >= F.lit(float(p)) * F.col("total_docs"), F.col("n_tokens"))))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept when every document is cut to ``limit``, for any limits from 0; no rows for an empty histogram.

    The last length within a limit has the answer in its sums: all its tokens and those of shorter
    documents, and the limit once for each longer document. Below the shortest length every document is cut.
    """

    def kept(limit: int) -> Column:
        last = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_at_most", "n_docs_longer")))
        every = F.max("total_docs") * F.lit(limit).cast("long")
        return F.coalesce(last["tokens_at_most"] + last["n_docs_longer"] * F.lit(limit).cast("long"), every)

    return _asked(histogram, "limit", limits, "bigint", "truncated_total", kept)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
