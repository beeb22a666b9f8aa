"""Shards against a plain prefix sum."""

import zlib
from collections import Counter

import pytest

from strandline.llm import sharding

from . import helpers


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_shards_equal_plain_prefix_sums(spark, make):
    rows = helpers.awkward()
    got = sharding.shard_by_bytes(make(spark, rows), n_shards=5).collect()
    flat = sorted(((-1 if i is None else i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, before, want, slots = sum(x[2] for x in flat), 0, Counter(), Counter()
    for i, crc, size in flat:
        shard = min(4, before * 5 // total)
        want[(i, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        before += size
    assert Counter(((-1 if r.doc_id is None else r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_shards_are_near_equal(spark):
    got = sharding.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    sizes, most = Counter(), max(r.size for r in got)
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * most


def test_one_id_holds_a_third(spark):
    rows = [(7, "same")] * 300 + [(i, f"text {i}") for i in range(600)]
    got = sharding.shard_by_bytes(helpers.docs(spark, rows)).collect()
    assert len(got) == 900
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty(spark):
    assert sharding.shard_by_bytes(helpers.docs(spark, [])).count() == 0
