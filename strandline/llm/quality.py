"""Quality rules as a bitmask ledger (built-in functions only).

Every rule is evaluated once per document; the ledger keeps the measurements and one integer whose
bits are the rules that failed. A policy is a versioned bit mask over the ledger, so changing a
policy, comparing versions or leaving a rule out never reads the texts again: these are bitwise
operations over the ledger, and ablations are one aggregation of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, table, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Rules by bit; true means failed. Names of measurements are columns of the ledger.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_density", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamations", "4 * n_exclamations > n_words"),
    ("low_variety", "n_distinct_words * n_distinct_words < 4 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "symbol_density", "duplicate_lines"),
    "v2": mask_of(*BITS),
}
CURRENT = "v2"


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements (all long) and ``failed``, the bits of RULES that failed.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines (those equal to an
    earlier line), n_repeat_words (words in windows of 8 words found twice or more), n_upper,
    n_exclamations, n_distinct_words. Windows are compared within a document by a 64-bit hash.

    A null or empty text has zero of everything and fails ``few_words``. Null and repeated ids and
    repeated rows each keep their row; an empty table gives no rows.
    """
    text = F.col("text")
    worded = documents(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce(text, F.lit("")).alias("text"),
        words_of(text).alias("words"),
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    measured = worded.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-ZÀ-ÖØ-Þ]+", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.when(F.size("words") > WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).alias("hashes"),
    )
    # Only documents in which some window comes again are sorted.
    ordered = measured.withColumn(
        "ordered",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.expr("sort_array(transform(hashes, (h, i) -> struct(h, i)))")),
    ).drop("hashes")
    starts = ordered.withColumn(
        "starts",
        F.expr("sort_array(transform(filter(ordered, (x, j) -> x.h = get(ordered, j - 1).h or x.h = get(ordered, j + 1).h), x -> x.i))"),
    ).drop("ordered")
    counted = starts.withColumn(
        "n_repeat_words",
        F.coalesce(F.expr(f"aggregate(transform(starts, (x, k) -> least({WINDOW}, coalesce(get(starts, k + 1) - x, {WINDOW}))), 0L, (s, x) -> s + x)"), F.lit(0).cast("long")),
    ).drop("starts")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return counted.withColumn("failed", failed.cast("long"))


def passes(mask: int, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask)) == 0


def apply_policy(ledger: DataFrame, version: str = CURRENT, policies: dict[str, int] = POLICIES) -> DataFrame:
    """The ledger with base_failed and ``kept``, which is false where a base rule or a rule of the policy failed."""
    base = ~passes(POLICIES["base"])
    return ledger.withColumns({"base_failed": base, "kept": ~base & passes(policies[version])})


def ablations(ledger: DataFrame, version: str = CURRENT, policies: dict[str, int] = POLICIES) -> DataFrame:
    """What each rule of a policy decides: one row per rule with n_docs, n_failed, n_failed_alone, n_kept and n_kept_without.

    One aggregation of bitwise operations over the ledger. An empty ledger gives zeros.
    """
    mask = policies[version]
    rules = [(name, bit) for name, bit in BITS.items() if mask & bit]
    row = ledger.agg(
        F.count("*").alias("n_docs"),
        F.count_if(passes(mask)).alias("n_kept"),
        *[F.count_if(~passes(bit)).alias(f"failed_{name}") for name, bit in rules],
        *[F.count_if(F.col("failed").bitwiseAND(F.lit(mask)) == bit).alias(f"alone_{name}") for name, bit in rules],
        *[F.count_if(passes(mask & ~bit)).alias(f"without_{name}") for name, bit in rules],
    )
    entries = [
        F.struct(
            F.lit(name).alias("rule"), "n_docs", F.col(f"failed_{name}").alias("n_failed"), F.col(f"alone_{name}").alias("n_failed_alone"),
            "n_kept", F.col(f"without_{name}").alias("n_kept_without"),
        )
        for name, _ in rules
    ]
    return row.select(F.inline(F.array(*entries)))


def compare_policies(ledger: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """One row per policy version: version, mask, n_kept."""
    row = ledger.agg(*[F.count_if(passes(mask)).alias(v) for v, mask in policies.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.col(v).alias("n_kept")) for v, m in policies.items()])))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_upper", "n_exclamations", "n_distinct_words")


_BIT_SQL = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, (_, rule) in enumerate(RULES))
SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), windows as (
  select rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') as v
  from (select rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from d where len(ws) >= {WINDOW})
), twice as (
  select rid, i from windows qualify count(*) over (partition by rid, v) > 1
), covered as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {WINDOW})) as p from twice) group by rid
), m as (
  select doc_id, len(ws) as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(n, 0) as n_repeat_words, len(ls) as n_lines,
         length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper,
         length(t) - length(replace(t, '!', '')) as n_exclamations,
         len(list_distinct(ws)) as n_distinct_words
  from d left join covered using (rid)
), l as (select *, cast({_BIT_SQL} as bigint) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {POLICIES["base"]}) <> 0 as base_failed,
       (failed & {POLICIES["base"] | POLICIES[CURRENT]}) = 0 as kept,
       failed, n_lines, n_upper, n_exclamations, n_distinct_words
from l
"""
