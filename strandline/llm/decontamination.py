"""Benchmark passages in training texts, by a positional inverted index (built-in functions only).

The index stores, for each word of the benchmark, where it stands in the training texts: rows (term,
doc, pos), written once, each task's rows ordered by term. Counting the rows gives every term's
frequency over all texts. A passage is then searched from its rarest term: its list, less the term's
offset, gives candidate starts, the list of the next rarest term thins them, and the lists of all other
terms decide, so an occurrence is exact: every word of the passage stands at its place.

Texts are read once and never shuffled; what moves are candidates and the lists they meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import discard, documents, materialize, table

#: Characters between words: ASCII, apart from letters and digits (texts are lower-cased in A-Z after the split).
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: A table of at most so many narrow rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: The term of a document's own row, which holds its id and its number of words.
HEADER = -1


@dataclass
class Index:
    """Tables in the shared folder. postings: term, doc, pos, doc_id, n_words (both null but in a document's own row);
    windows: window, words; window_items: window, item_id; window_terms: window, off, term, frequency, rank, n."""

    postings: DataFrame
    windows: DataFrame
    window_items: DataFrame
    window_terms: DataFrame

    def discard(self) -> None:
        for t in (self.postings, self.windows, self.window_items, self.window_terms):
            discard(t)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lower(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The different windows of all items (window, words), and which item has which (window, item_id).

    A window is ``size`` consecutive words; an item of fewer words, but not none, is one window.
    """
    worded = items.select(F.col(id_col).alias("item_id"), F.transform(_words(F.col(text_col)), _lower).alias("words")).where("size(words) > 0")
    cut = f"transform(sequence(0, greatest(size(words) - {size}, 0)), i -> slice(words, i + 1, {size}))"
    pairs = materialize(worded.select("item_id", F.explode(F.expr(cut)).alias("words")).distinct())
    windows = materialize(pairs.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    window_items = materialize(pairs.where("item_id is not null").join(windows, "words").select("window", "item_id"))
    discard(pairs)
    return windows, window_items


def build_index(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index the words of ``docs`` (whole texts) that occur in ``items`` (item_id, text), and rank the words of each window, rarest first.

    Windows with a word that no text has are left out of ``window_terms``.
    """
    windows, window_items = item_windows(items, size=size)
    offs = windows.select("window", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
    terms = materialize(offs.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    known = terms.select("word", "term").unionByName(spark.range(1).select(F.lit("").alias("word"), F.lit(HEADER).cast("long").alias("term")))

    worded = documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("doc"), "doc_id", _words(F.col("text")).alias("words"))
    # Place 0 is the document's own row.
    tokens = worded.select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "written"))
    own = F.col("at") == 0
    found = tokens.withColumn("word", _lower(F.col("written"))).join(_small(known), "word")
    rows = found.select("term", "doc", (F.col("at") - 1).alias("pos"), F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"))
    postings = materialize(rows.sortWithinPartitions("term"))

    frequency = postings.groupBy("term").agg(F.count("*").alias("frequency"))
    ranked = offs.join(terms, "word").join(frequency, "term")
    by = Window.partitionBy("window")
    ranked = ranked.withColumns({"rank": F.row_number().over(by.orderBy("frequency", "off")), "present": F.count("*").over(by)})
    window_terms = materialize(ranked.where("present = n").select("window", "off", "term", "frequency", "rank", "n"))
    discard(terms)
    return Index(postings, windows, window_items, window_terms)


def _anchors(index: Index) -> DataFrame:
    """Places of each window's rarest term: doc, pos, window, off."""
    first = index.window_terms.where("rank = 1").select("term", "window", "off")
    return index.postings.where(F.col("term") != HEADER).select("term", "doc", "pos").join(_small(first), "term").select("doc", "pos", "window", "off")


def _intersect(index: Index, candidates: DataFrame, low: int, high: int | None) -> DataFrame:
    """Of ``candidates`` (doc, start, window) those with all their terms of ranks ``low`` to ``high`` in place."""
    wanted = index.window_terms.where((F.col("rank") >= low) & (F.col("rank") <= (high or F.col("rank"))))
    needed = index.window_terms.where("rank = 1").select("window", (F.least(F.lit(high), F.col("n")) if high else F.col("n")).alias("upto"))
    needed = _small(needed.select("window", F.greatest(F.col("upto") - (low - 1), F.lit(0)).alias("need")))
    candidates = candidates.join(needed, "window")
    few = candidates.select("doc").distinct()
    lists = index.postings.select("term", "doc", "pos").join(_small(wanted.select("term").distinct()), "term", "left_semi")
    if few.count() <= BROADCAST_ROWS:
        lists = lists.join(F.broadcast(few), "doc", "left_semi")
    probes = candidates.where("need > 0").join(_small(wanted.select("window", "off", "term")), "window").select("doc", (F.col("start") + F.col("off")).alias("pos"), "term", "window", "start", "need")
    met = probes.join(lists, ["doc", "pos", "term"]).groupBy("doc", "start", "window", "need").agg(F.count("*").alias("places")).where("places = need")
    return met.select("doc", "start", "window").unionByName(candidates.where("need = 0").select("doc", "start", "window"))


def phrase_matches(index: Index) -> DataFrame:
    """Every occurrence of every window: doc (the index's number of the document), start (in words, from 0), window. Each once."""
    starts = _anchors(index).select("doc", (F.col("pos") - F.col("off")).alias("start"), "window").where("start >= 0")
    first = materialize(starts)
    second = materialize(_intersect(index, first, 2, 2))
    discard(first)
    found = materialize(_intersect(index, second, 3, None))
    discard(second)
    return found


def near_matches(index: Index, slop: int) -> DataFrame:
    """Places where a window's words all stand, in any order, within ``slop`` words of its rarest one: doc, pos, window.

    A word that the window has several times need stand there once. Lists are joined by term and
    stretch of the text, so only words near each other meet.
    """
    stretch = 2 * slop + 1
    anchors = _anchors(index).select("doc", "pos", "window").distinct()
    others = index.window_terms.groupBy("window", "term").agg(F.min("rank").alias("rank"))
    first = index.window_terms.where("rank = 1").select("window", F.col("term").alias("first"))
    others = others.join(first, "window").where("term <> first").select("window", "term")
    need = others.groupBy("window").agg(F.count("*").alias("need"))
    probes = anchors.join(_small(others), "window").select(
        "doc", "term", "window", "pos", F.explode(F.array_distinct(F.array(F.expr(f"(pos - {slop}) div {stretch}"), F.expr(f"(pos + {slop}) div {stretch}")))).alias("part")
    )
    lists = index.postings.where(F.col("term") != HEADER).select("term", "doc", F.col("pos").alias("place"), F.expr(f"pos div {stretch}").alias("part"))
    met = probes.join(lists, ["doc", "term", "part"]).where(F.abs(F.col("place") - F.col("pos")) <= slop).select("doc", "pos", "window", "term").distinct()
    full = met.groupBy("doc", "pos", "window").agg(F.count("*").alias("n")).join(_small(need), "window").where("n = need").select("doc", "pos", "window")
    alone = index.window_terms.where("rank = 1").select("window").join(_small(need), "window", "left_anti")
    return full.unionByName(anchors.join(_small(alone), "window", "left_semi"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    Words are runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. A null text has
    no words. Repeated rows and ids each keep a row. Items without words never occur; items without an
    id hit words but are not counted or listed; rows of one item id count as one item. Empty tables give
    no rows, or documents without hits.
    """
    index = build_index(docs, items, size, id_col, text_col)
    found = phrase_matches(index)
    lengths = index.window_terms.where("rank = 1").select("window", "n")
    spans = found.join(_small(lengths), "window").groupBy("doc", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    by = Window.partitionBy("doc").orderBy("start")
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))).groupBy("doc").agg(F.sum("new").alias("n_hit"))
    listed = found.select("doc", "window").distinct().join(_small(index.window_items), "window").groupBy("doc").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    own = index.postings.where(F.col("term") == HEADER).select("doc", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    joined = own.join(hits, "doc", "left").join(listed, "doc", "left").withColumns({"items": F.array_sort(F.coalesce("items", none)), "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long")})
    return joined.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), w as (
  select distinct item_id, least(len(ws), {WINDOW}) as n, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') as v
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) as i from b where len(ws) > 0)
), grams as (
  select rid, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as v
  from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from w) where len(ws) >= n)
), hit as (
  select rid, i, n, item_id from grams join w using (n, v)
), covered as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from hit)) group by rid
), listed as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, cast(item_id as varchar) as item from hit where item_id is not null) group by rid
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join listed using (rid)
"""
