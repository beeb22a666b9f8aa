"""SimHash near-duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import simhash
from strandline.llm.components import connected_components

from . import helpers


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def varied(seed):
    rng, out = random.Random(seed), []
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "Eta", "theta", "iota"]
    for g in range(25):
        base = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(3, 300))]
        for c in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(c % 3):
                copy[rng.randrange(len(copy))] = "changed"
            out.append((1000 + len(out) * 7 % 997, " ".join(copy)))
    return out


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_documents_equal_all_pairs(spark, make):
    rows = varied(3) + [r for r in helpers.awkward(n=10) if r[0] is not None]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    rows = [(i, t) for i, t in rows if fps[i] == plain_fingerprint(t)]  # one text per id
    want = plain_components(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_one(make(spark, rows))
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(want.values()))
    assert simhash.near_duplicates(make(spark, rows).limit(0)).count() == 0


def test_null_ids_and_empty_results(spark):
    rows = [(None, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (None, "quite another text altogether"), (7, "x"), (8, "")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(helpers.docs(spark, rows)).collect()}
    assert got == {(None, 5), (5, 5), (None, None), (7, 7), (8, 8)}
    assert simhash.keep_one(helpers.docs(spark, rows)).count() == 5


def brute(points):
    d = np.bitwise_count(points[:, None] ^ points[None, :])
    return plain_components(range(len(points)), lambda a, b: d[a, b] <= 4)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(0, 9))
def test_tree_equals_all_pairs(seed, centres, flips):
    rng = np.random.default_rng(seed)
    middle = rng.integers(0, 2**64, centres, dtype=np.uint64)
    points = []
    for _ in range(180):
        p = int(rng.choice(middle))
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            p ^= 1 << int(b)
        points.append(p)
    points = np.unique(np.array(points, np.uint64))
    want = brute(points)
    roots = simhash.vantage_tree_links(points, leaf=8)
    assert {(want[i] == want[j]) == (roots[i] == roots[j]) for i in range(len(points)) for j in range(len(points))} == {True}


def test_dense_group(spark):
    rng = np.random.default_rng(1)
    points = set()
    while len(points) < 3000:
        p = 0xDEADBEEF12345678
        for b in rng.integers(0, 64, 3):
            p ^= 1 << int(b)
        points.add(p - (1 << 64) if p >> 63 else p)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    linked = connected_components(simhash.near_fingerprints(df), "a", "b").collect()
    assert len(linked) == 3000 and len({r.component for r in linked}) == 1
    assert simhash.near_fingerprints(df).count() <= 5 * 3000 * simhash.LEAF // 2


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(7, 7), (None, 3), (61, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    pairs = {(min(p), max(p)) for p in links if None not in p and p[0] != p[1]}
    nodes = sorted({x for p in pairs for x in p})
    assert got == plain_components(nodes, lambda a, b: (a, b) in pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_repeated_ids_and_rows(spark):
    rows = varied(5)[:60]
    rows += [(rows[0][0], rows[9][1]), rows[3], rows[3], (rows[1][0], None), (rows[1][0], "")]
    fps = [plain_fingerprint(t) for _, t in rows]
    linked = plain_components(sorted(set(fps)), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for (i, _), f in zip(rows, fps):
        least[linked[f]] = min(i, least.get(linked[f], i))
    want = sorted((i, f, least[linked[f]]) for (i, _), f in zip(rows, fps))
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(helpers.docs(spark, rows)).collect())
    assert got == want
    kept = simhash.keep_one(helpers.docs(spark, rows)).collect()
    named = {i for i, _, c in want if i == c}
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted({(i, t or "") for i, t in rows if i in named})


def test_most_points_pass_through_a_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0")
    fps = np.unique(np.array([plain_fingerprint(r.text) for r in docs.select("text").limit(1500).collect()], np.uint64))
    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([fps, rng.integers(0, 2**64, 3000, dtype=np.uint64)]))
    points = spark.createDataFrame([(int(p),) for p in fps.view(np.int64)], "fp long")
    vantage = simhash.vantage_points(points, len(fps))
    d = np.bitwise_count(fps[:, None] ^ vantage[None, :])
    there = d <= d.min(1)[:, None] + simhash.RADIUS
    homes = np.bincount(d.argmin(1), minlength=len(vantage))
    through = there[:, homes * there.sum(0) > simhash.LEAF**2].any(1)  # in a shard that a tree cuts
    assert through.mean() > 0.5 and there.sum(1).mean() < 0.2 * len(vantage)
    assert all(there[np.arange(len(fps)), d.argmin(1)])


def test_split_shards(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = np.unique(np.concatenate([rng.integers(0, 2**64, 400, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    monkeypatch.setattr(simhash, "VISITORS", 16)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.near_fingerprints(df), "a", "b").collect()}
    want = brute(points)
    signed = points.view(np.int64).tolist()
    for i in range(0, len(points), 3):
        for j in range(i):
            assert (want[i] == want[j]) == (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j]))
