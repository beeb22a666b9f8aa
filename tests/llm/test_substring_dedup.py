"""Substring deduplication against all windows in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import substring_dedup as sd

from . import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=50):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), ws in zip(rows, words):
        if i is not None:
            for p in range(len(ws) - window + 1):
                k = tuple(ws[p : p + window])
                least[k] = min(i, least.get(k, i))
    out = Counter()
    for (i, _), ws in zip(rows, words):
        gone = {q for p in range(len(ws) - window + 1) if i is not None and least[tuple(ws[p : p + window])] < i for q in range(p, p + window)}
        out[(i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone))] += 1
    return out


def varied(seed, n=60):
    rng = random.Random(seed)
    new = lambda k: [rng.choice("the of a é Straße x y z ok".split()) + rng.choice(["", str(rng.randrange(50))]) for _ in range(k)]
    passages = [new(rng.choice([49, 50, 51, 60, 120, 400])) for _ in range(8)]
    rows = []
    for i in range(n):
        ws = new(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            ws += (p if rng.random() < 0.7 else p[: rng.randrange(1, len(p))]) + new(rng.randrange(0, 40))
        rows.append((rng.randrange(0, 10**6), rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(i + 10**7, t) for i, t in rows[:6]] + rows[:2] + [(5, "a " * 300), (6, "a " * 200), (7, "b c " * 100)]
    return rows


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_equals_all_windows(spark, make):
    rows = varied(4) + helpers.awkward(n=6)
    df = make(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df).collect())
    want = plain(rows)
    assert got == want
    assert sum(x[2] for x in want) > 500
    whole = sd.drop_repeats(df)
    assert whole.columns == df.columns and whole.count() == len(rows)
    for r in whole.collect():
        if r.text is not None:
            assert any(k[0] == r.doc_id and k[3] == " ".join(WORD.findall(r.text)) for k in want)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_hot_runs(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_DOCUMENTS", 5)
    monkeypatch.setattr(sd, "HOT_SAMPLE", 1)
    rng = random.Random(6)
    passage = [f"p{rng.randrange(30)}" for _ in range(90)]
    rows = [(i, " ".join([f"u{rng.randrange(900)}" for _ in range(30)] + passage + [f"v{rng.randrange(900)}" for _ in range(30)])) for i in range(60)]
    own = sd._keyed(helpers.docs(spark, rows).selectExpr("doc_id as __id", "text as __text"))
    assert sd._hot_runs(own)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(helpers.docs(spark, rows)).collect())
    assert got == plain(rows)


def test_real_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import hashlib

    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.op3_substring_dedup(spark, sf).collect())
    assert got == Counter({(i, n, k, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, k, t), c in plain(rows).items()})


def test_index_equals_counting():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 4, rng.integers(12, 40)) for _ in range(40)]
    documents = rng.permutation(40)
    index = sd.FmIndex(sequences, documents, 4, window=10)
    least = {}
    for s, d in zip(sequences, documents):
        for p in range(len(s) - 9):
            k = tuple(s[p : p + 10])
            least[k] = min(d, least.get(k, d))
    for s, found in zip(sequences, index.least_documents(sequences)):
        assert found.tolist() == [least[tuple(s[p : p + 10])] for p in range(len(s) - 9)]
    values = rng.integers(0, 37, 500)
    tree = sd.WaveletMatrix(values, 37)
    at, symbol = rng.integers(0, 501, 300), rng.integers(0, 37, 300)
    assert tree.rank(symbol, at).tolist() == [int((values[:i] == c).sum()) for c, i in zip(symbol, at)]


def test_one_region_in_half_of_many_documents(spark):
    """Hot regions go by broadcast, so no task gathers them; the others by shuffle. Both find every copy."""
    passage = " ".join(f"p{i}" for i in range(70))
    twice = " ".join(f"q{i}" for i in range(55))
    rows = [(i, f"a{i} b{i} {passage} c{i}" if i % 2 else f"a{i} only{i} {twice if i in (100, 2000) else ''}") for i in range(10_000)]
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(helpers.docs(spark, rows)).select("doc_id", "n_removed").collect()}
    assert got == {i: 70 if i % 2 and i > 1 else 55 if i == 2000 else 0 for i in range(10_000)}


def test_texts_are_shuffled_packed(spark):
    import pandas as pd

    from strandline.llm import substring_dedup as S

    texts = [None, "", "a", "\u00e9\u4e2d " * 500, " ".join(f"w{i}" for i in range(3000))]
    kept = S._pack(pd.Series(texts, dtype=object))
    assert kept[0] is None and [S.unpacked(k).decode() for k in kept] == [t or "" for t in texts]
    assert len(kept[3]) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = S.remove_repeats(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert any("_pack(" in line for line in plan[joined:])  # below the join, so before its shuffle
