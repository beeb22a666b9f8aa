"""Embedding near-duplicates: precision, recall and counts against all pairs."""

import numpy as np
import pytest

from strandline.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    """Counts and components of all usable vectors in double precision."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    x = np.array([v / np.sqrt((v * v).sum()) for _, v in ok])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    ids = [i for i, _ in ok]
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(hit)):
            m = min(comp[ids[a]], comp[ids[b]])
            if comp[ids[a]] != m or comp[ids[b]] != m:
                comp[ids[a]] = comp[ids[b]] = m
                changed = True
    return {i: int(n) for i, n in zip(ids, hit.sum(1))}, comp


def groups(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(120):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            rows.append((len(rows) * 3 + 1, (centre + rng.standard_normal(32) * 0.1).tolist()))
    centre = rng.standard_normal(32)
    rows += [(5000 + i, (centre + rng.standard_normal(32) * 0.12).tolist()) for i in range(300)]  # denser than the window
    rows += [(6000 + i, rows[0][1]) for i in range(50)]  # copies
    rows += [(7000, [2 * x for x in rows[3][1]])]  # another length, same direction
    return rows


ODD = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] + [1.0] * 31), (9004, [float("inf")] + [1.0] * 31), (9005, [None] + [1.0] * 31), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]


@pytest.mark.parametrize("clash", [False, True])
def test_equals_all_pairs(spark, clash):
    rows = groups()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + ODD] + [(None, [1.0] * 32, 1)], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("size", "class_id", "vector", "a", "b", "key", "n_links", "component", "kept", "node", "others")})
    n, comp = brute(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(ODD) + 1
    found, true = sum(got[i].n_links for i in n), sum(n.values())
    assert 0.99 * true <= found <= true
    assert sum(got[i].component_id == comp[i] for i in comp) >= 0.99 * len(comp)
    for i, _ in ODD[:6]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9007].component_id == 9006 and got[9007].n_links == 1 and not got[9007].kept
    assert got[None].n_links == 0 and got[None].component_id is None
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.fixture(params=[4, 64, 211])
def partitions(spark, request):
    """So many shuffle partitions, none of them merged."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, (str(request.param), "false")):
        spark.conf.set(k, v)
    yield request.param
    for k, v in held.items():
        spark.conf.set(k, v)


def test_recall_of_links_over_partitions(spark, partitions):
    rows = [(i, v) for i, v in groups(partitions) if len(v) == 32]
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    first = {}
    for i, v in rows:
        first.setdefault(tuple(np.array(v, np.float32)), i)
    ids = [first[tuple(np.array(v, np.float32))] for _, v in rows]
    near = zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))
    true = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in near if ids[a] != ids[b]}
    _, classes = embedding_dedup.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.a, r.b) for r in embedding_dedup.class_links(classes).collect()}
    assert got <= true and len(got) >= 0.98 * len(true)


def test_repeated_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal(32), rng.standard_normal(32)
    near = lambda c: (c + rng.standard_normal(32) * 0.01).tolist()
    rows = [(5, near(a)), (6, near(a)), (5, near(b)), (7, near(b)), (8, near(b)), (9, [1.0] * 32), (9, [1.0] * 32)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5), (9, 1, 9), (9, 1, 9)]


def test_dense_group_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * 0.15).tolist()) for i in range(800)] + [(5000 + i, rng.standard_normal(64).tolist()) for i in range(400)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("96", "false")):  # the group alone fills some 64 range partitions
        spark.conf.set(k, v)
    try:
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    n, _ = brute(rows)
    assert sum(n.values()) > 0.99 * 800 * 799
    assert 0.99 * sum(n.values()) <= sum(r.n_links for r in got.values()) <= sum(n.values())
    assert all((got[i].component_id == 0) == (i < 800) for i, _ in rows)


def isolated(n, pairs, cosine=0.951, dims=64, seed=9):
    """n random unit vectors; the first ``pairs`` have a partner at the cosine, the ids of both are 2k and 2k + 1."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[: 2 * pairs : 2]
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    x[1 : 2 * pairs : 2] = cosine * a + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    return x.astype(np.float32)


def test_passes_grow_so_that_isolated_pairs_are_met():
    """The share of pairs whose blocks ever meet, from the operator's own keys and blocks; larger tables are in the README."""
    grown = [embedding_dedup.passes_for(n) for n in (10**3, 10**5, 10**6, 4 * 10**6, 10**9)]
    assert grown == sorted(grown) and grown[0] == embedding_dedup.PASSES and grown[-1] < 60
    x = isolated(300_000, 1500)
    met = np.zeros(1500, bool)
    for p in range(embedding_dedup.passes_for(len(x))):
        place = np.empty(len(x), np.int64)
        place[np.argsort(embedding_dedup.keys(x, embedding_dedup.SEED + p), kind="stable")] = np.arange(len(x))
        met |= np.abs(place[:3000:2] // embedding_dedup.WINDOW - place[1:3000:2] // embedding_dedup.WINDOW) <= 1
    assert met.mean() >= 0.95


def test_isolated_pairs_in_a_large_table(spark):
    import pyarrow as pa

    x = isolated(200_000, 1000)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": lists})).repartition(16)
    got = embedding_dedup.near_duplicates(df).where("n_links > 0").collect()
    linked = {r.vec_id for r in got}
    assert linked <= set(range(2000)) and len(linked) >= 0.95 * 2000 and {r.n_links for r in got} == {1}
