"""Quality rules against plain Python and DuckDB."""

import re
from collections import Counter

import duckdb
import pytest

from strandline.llm import quality

from . import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    n, chars, symbols = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    dups = len(lines) - len(set(lines))
    return n, chars, symbols, dups, len(covered), n < 20 or 100 * len(covered) > 30 * n


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_measurements_equal_plain_python(spark, make):
    rows = helpers.awkward() + [(50, "a b c d e f g h " * 6), (51, "x y\nx y\n\n \nz" * 5), (52, "#tag <b> 100% & | $ * ok")]
    ledger = quality.apply_policy(quality.rule_ledger(make(spark, rows)))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in ledger.collect())
    assert got == Counter((i, *plain(t)) for i, t in rows)
    assert not [r for r in ledger.collect() if r.base_failed and r.kept]
    assert quality.rule_ledger(make(spark, []) if make is helpers.docs else make(spark, rows).limit(0)).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = quality.op1_quality_rules(spark, sf)
    want = con.sql(quality.SQL)
    names = df.columns
    assert sorted(names) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())


def test_clean_kept_and_junk_dropped(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op1_quality_rules(spark, sf).join(labels, "doc_id").where("n_words >= 20").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.05


def test_ledger_answers_policies_and_ablations(spark):
    ledger = quality.rule_ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    failed = [r.failed for r in ledger.collect()]
    mask = quality.POLICIES["v2"]
    for r in quality.ablations(ledger, "v2").collect():
        bit = quality.BITS[r.rule]
        assert r.n_docs == len(failed) and r.n_kept == sum(f & mask == 0 for f in failed)
        assert r.n_failed == sum(f & bit != 0 for f in failed) and r.n_failed_alone == sum(f & mask == bit for f in failed)
        assert r.n_kept_without == sum(f & mask & ~bit == 0 for f in failed)
    for r in quality.compare_policies(ledger).collect():
        assert r.n_kept == sum(f & quality.POLICIES[r.version] == 0 for f in failed)
    assert {r.n_docs for r in quality.ablations(ledger.limit(0)).collect()} == {0}
