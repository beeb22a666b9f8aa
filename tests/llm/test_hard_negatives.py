"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from strandline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= hn.LARGEST for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, k == label) for b, (j, w, k) in enumerate(kept) if b != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, every=100, schema=SCHEMA):
    found = hn.mine_hard_negatives(spark.createDataFrame(rows, schema), every)
    assert found.schema == spark.createDataFrame([], hn.RESULT).schema or [f.name for f in found.schema] == [c.split()[0] for c in hn.RESULT.split(", ")]
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clusters(n, dims=16, seed=1, labels=4, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(8)] + spread * rng.normal(size=dims) + 0.4
        out.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype("f4")], int(rng.integers(labels))))
    return out


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in (("BLOCK", 8), ("GROUP", 4), ("CELL", 3), ("ROUND", 2), ("SAMPLE", 64)):
        monkeypatch.setattr(hn, name, value)


def test_clusters_over_many_blocks_groups_and_rounds(spark, small_parts):
    rows = clusters(600)
    got = run(spark, rows, every=20)
    assert got == plain(rows, 20) and len(got) > 300


def test_awkward_rows(spark, small_parts):
    rng = random.Random(2)
    rows = clusters(150, dims=6)
    rows += [(200, None, 1), (201, [], 1), (210, [1.0, None], 1), (220, [float("nan")] * 6, 2), (230, [float("inf")] * 6, 2), (240, [1e6] * 6, 0), (250, [0.0] * 6, 1), (None, [1.0] * 6, 1), (260, [1.0] * 6, None), (270, [1.0, 0.5], 2), (280, [90000.0, -90000.0], 3)]
    rows += [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(6)], rng.choice([0, 1, 9])) for i in range(300, 420)]
    rows += [rows[300 - 290], rows[20], rows[20], (20, [0.5] * 6, 2), (-40, [0.3] * 6, 3)]
    got = run(spark, rows, every=10)
    assert got == plain(rows, 10)


def test_a_third_are_copies_of_one_vector(spark):
    rows = clusters(600, labels=3) + [(1000 + i, clusters(1)[0][1], i % 2) for i in range(300)]
    assert run(spark, rows, every=50) == plain(rows, 50)


def test_one_label_and_extra_columns(spark):
    rows = [(i, v, 1) for i, v, _ in clusters(120)]
    assert run(spark, rows, every=10) == plain(rows, 10) == []
    rows = clusters(300)
    wide = [(*r, "x", 1, b"y", 2.0) for r in rows]
    assert run(spark, wide, 10, SCHEMA + ", block string, n int, vectors binary, score double") == plain(rows, 10)


def test_empty_and_without_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []
    assert run(spark, [(i, v, k) for i, v, k in clusters(40) if i % 100]) == []


def test_brackets_hold_every_score():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-300, 300, (200, 12)), rng.integers(-300, 300, (9, 12))
    space = hn._Space(v[:50], int((v**2).sum(1).max()), 8)
    d, a = space.of_rows(v), space.of_anchors(q)
    least, most = hn._brackets(space.largest, (q**2).sum(1), (q**2).sum(1), a, a, d.min(0), d.max(0))
    s = q @ v.T
    assert (least <= s.min(1)).all() and (s.max(1) <= most).all()
    each = [hn._brackets(space.largest, (q**2).sum(1), (q**2).sum(1), a, a, x, x) for x in d]
    assert all((lo <= s[:, i]).all() and (s[:, i] <= hi).all() for i, (lo, hi) in enumerate(each))
