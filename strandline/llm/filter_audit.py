"""How five filters interact: a histogram of failure masks, from which every order of the filters is read.

Each document gets a five-bit mask of the filters it fails, from built-in expressions over its whole
text; whether a copy has a smaller id comes from grouping the texts (by their SHA-256). The masks are
counted into at most 32 cells a part. What a filter removes at any place in any order depends on these
counts only, so the 120 permutations never touch the documents again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, join_hot, materialize, table, words_of

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
COUNTS = ["n", "good", "toxic"]


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: doc_id, part, digest (SHA-256 of the text) and ``mask`` with the bits of A to D.

    A null text counts as empty, which fails A only; a null part is the empty string. Rows of a
    repeated id each keep their row; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    worded = documents(docs, id_col, text_col, part).select("doc_id", "part", text.alias("text"), words_of(F.col("text")).alias("words"))
    n_words, n_distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    n_upper = (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long")
    fails = {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct < DISTINCT_PERCENT * n_words,
        "C": 100 * n_upper > UPPER_PERCENT * F.length("text").cast("long"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    return worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(fails).alias("mask"))


def _mask(fails: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for name, failed in fails.items():
        mask = mask.bitwiseOR(F.when(failed, BIT[name]).otherwise(0))
    return mask


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``text_masks`` with the bit of E, without the digest: a document fails E if a smaller id has the same text.

    Rows of the smallest id of a text pass, however often they are repeated. A null id is neither
    smaller than another nor fails.
    """
    narrow = materialize(text_masks(docs, id_col, text_col, part_col))
    # Grouped before the join, so a text with very many copies is one row here and, being hot, joined by broadcast.
    texts = materialize(narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    joined = join_hot(narrow, texts, "digest", "copies", narrow.count())
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(_mask({"E": F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))})).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part and mask that occurs: part, mask, n, and how many of them labels call good and toxic.

    A document is good (toxic) if any label row of its id has quality = 1 (toxic = 1); label rows with
    a null id and documents without labels count for neither.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("doc_id is not null and (good = 1 or toxic = 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "good", "toxic")
    # Ids are grouped once on either side, so a repeated id is one row of the join.
    by_id = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marked = by_id.join(marks, "doc_id", "left")
    flags = {name: F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(0)).alias(name) for name in ("good", "toxic")}
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), flags["good"], flags["toxic"])


def order_audit(cells: DataFrame) -> DataFrame:
    """The audit of every part: one row for each of the 120 orders and 5 steps, zeros included.

    part, filter_order, step, and long counts: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. An empty table gives no rows.
    """
    arrays = cells.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", name))).alias(name) for name in COUNTS])
    arrays = arrays.select("part", *[F.expr(f"transform(sequence(0, 31), m -> coalesce({name}[m], 0L))").alias(name) for name in COUNTS])

    # What comes before a filter matters as a set, not as a sequence.
    def total(name: str, rule: str) -> Column:
        return F.expr(f"aggregate(sequence(0, 31), 0L, (s, m) -> s + if({rule}, {name}[m], 0L))")

    steps = [
        F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(sum(BIT[x] for x in order[:i])).alias("before"), F.lit(BIT[order[i]]).alias("bit"))
        for order in ORDERS
        for i in range(len(order))
    ]
    return arrays.select("*", F.inline(F.array(*steps))).select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & (before | bit)) = 0").alias("kept"),
        total("n", "(m & before) = 0 and (m & bit) <> 0").alias("removed"),
        total("n", "(m & before) <> 0 and (m & bit) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        total("good", "(m & before) = 0 and (m & bit) <> 0").alias("good_lost"),
        total("toxic", "(m & before) = 0 and (m & bit) <> 0").alias("toxic_lost"),
        # Of a mask's filters each comes first in equally many of the 120 orders.
        F.expr(f"aggregate(sequence(0, 31), 0L, (s, m) -> s + if((m & bit) <> 0, n[m] * ({len(ORDERS)} div bit_count(m)), 0L))").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_audit`` of documents (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    return order_audit(mask_cells(failure_masks(docs), labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents
), m as (
  select doc_id, part,
         case when len(ws) < {MIN_WORDS} then 1 else 0 end
         + case when 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) then 2 else 0 end
         + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(t) then 4 else 0 end
         + case when regexp_matches(t, '{SYMBOLS}') then 8 else 0 end
         + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
  from t
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), cells as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask
), f as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b)
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from f a, f b, f c, f d, f e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31
), steps as (
  select filter_order, cast(step as integer) as step, bits[step] as bit, cast(list_sum(list_slice(bits, 1, step - 1)) as bigint) as before
  from orders, unnest(range(1, 6)) u(step)
), firsts as (
  select part, filter_order, step, bit,
         sum(case when (mask & (coalesce(before, 0) | bit)) = 0 then n else 0 end) as kept,
         sum(case when (mask & coalesce(before, 0)) = 0 and (mask & bit) <> 0 then n else 0 end) as removed,
         sum(case when (mask & coalesce(before, 0)) <> 0 and (mask & bit) <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when (mask & coalesce(before, 0)) = 0 and (mask & bit) <> 0 then good else 0 end) as good_lost,
         sum(case when (mask & coalesce(before, 0)) = 0 and (mask & bit) <> 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from firsts
"""
