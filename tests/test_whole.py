"""Queries over whole arrays and tables, by brute force on rows whose ends decide."""

import itertools
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from strandline.plans import registry


def test_whole_arrays(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 64)).round(2).astype(np.float32)
    x[:10, 63] += 9  # decided by the last component
    pq.write_table(pa.table({"vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 20, pa.int32())}), tmp_path / "embeddings.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    slopes = {r.id: r.slope for r in run("theil_sen_slope_whole")}
    votes = {(r.id, r.label): r.votes for r in run("one_vs_one_votes_whole")}
    calls = {r.id: r.call for r in run("gated_calls_whole")}
    assert len(slopes) == len(calls) == 20 and sum(votes.values()) == 20 * 64 * 63 // 2
    for k, v in enumerate(x.astype(float)):
        pairs = list(itertools.combinations(range(64), 2))
        assert abs(slopes[k] - median((v[j] - v[i]) / (j - i) for i, j in pairs)) < 1e-6
        for c in range(64):
            assert votes.get((k, c + 1), 0) == sum((i if v[i] > v[j] else j) == c for i, j in pairs if c in (i, j))
        p = np.exp(v) / np.exp(v).sum()
        a, b = np.sort(p)[:-3:-1]
        assert calls[k] == (63 - int(p[::-1].argmax()) if a - b >= 0.02 else -1)
    assert all(calls[k] == 63 for k in range(10))


def test_whole_merge_inputs(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    first = [r.read_id for r in registry.QUERIES["merge_first_wins_whole"](spark, sf).collect()]
    both = [r.read_id for r in registry.QUERIES["merge_keep_duplicates_whole"](spark, sf).collect()]
    moved = {i + 7 for i in ids}
    assert len(first) == len(ids | moved) and set(first) == ids | moved and len(both) == 2 * len(ids)
