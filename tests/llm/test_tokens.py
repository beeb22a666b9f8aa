"""Packing, BPE and token counts against the tokenizer libraries and plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import bpe, packing, token_counts

from . import helpers

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


def sample_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows] + [t or "" for _, t in helpers.awkward()]


def test_ids_equal_the_library(spark, reference):
    own, texts = bpe.codec(MULTI)
    for t in sample_texts(spark):
        ids = texts.text(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabé \n\t\x1c\x85 'st1.日😀-"), max_size=60))
def test_odd_texts_equal_the_library(text):
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    _, texts = bpe.codec(MULTI)
    assert np.frombuffer(texts.text(text), "<u4").tolist() == reference.encode_ordinary(text)


_kept = {}


def _ranks():
    return _kept.setdefault("ranks", bpe.load_ranks(MULTI))


def test_very_long_pretokens(reference):
    own, _ = bpe.codec(MULTI)
    rng = random.Random(3)
    for piece in ("a" * 20001, "".join(rng.choice("abcdeé") for _ in range(20000)), "ab" * 9000, "日本" * 3000):
        assert own.merge(piece.encode()) == reference.encode_ordinary(piece)


def test_rank_queue_pops_in_order():
    rng, queue, want = random.Random(5), bpe.RankQueue(50256), []
    for i in range(2000):
        entry = (rng.randrange(50256), i)
        want.append(entry)
        queue.push(*entry)
    got = []
    while (x := queue.pop()) is not None:
        got.append(x)
    assert got == sorted(want) and queue.top == 0 and not any(queue.low)


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_round_trip_rows(spark, reference, make):
    rows = helpers.awkward()
    df = make(spark, rows)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(df).collect())
    want = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    decoded = bpe.decode_ids(bpe.encode_texts(df)).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded) == Counter((i, (t or "").encode()) for i, t in rows)
    assert bpe.round_trip_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_packing(spark, make):
    rows = helpers.awkward()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack_powers_of_two(make(spark, rows), max_length=256).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        start = 0
        for n in packing.pieces(len(ids), 256):
            want[(i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids))] += 1
            start += n
        assert start == len(ids)
    assert Counter((r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens) for r in packed) == want
    for r in packed:
        assert r.offset == 0 and r.length == 2**r.bucket <= 256
    with pytest.raises(ValueError):
        packing.pack_powers_of_two(make(spark, rows), max_length=100)


def test_packing_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    parts = {}
    for r in packing.pack_powers_of_two(docs).collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, t in texts.items():
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(x for _, x in sorted(parts[i])), "<u4").tolist() == want


def test_pieces():
    assert packing.pieces(0) == [] and packing.pieces(1) == [1] and packing.pieces(4096 * 2 + 5) == [4096, 4096, 4, 1]


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_token_counts(spark, make):
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = helpers.awkward()
    lengths = [len(own.encode_ordinary(t or "")) for _, t in rows]
    counted = token_counts.token_lengths(make(spark, rows))
    assert Counter((r.doc_id, r.n_tokens) for r in counted.collect()) == Counter(zip([i for i, _ in rows], lengths))
    histogram = token_counts.length_histogram(counted)
    got = {r.n_tokens: r for r in histogram.collect()}
    assert {k: r.n_docs for k, r in got.items()} == dict(Counter(lengths))
    for limit, r in got.items():
        longer = [x for x in lengths if x > limit]
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert (r.n_docs_longer, r.tokens_longer) == (len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
    limits = [0, 1, 7, 100, 10**6]
    assert {r.limit: r.truncated_total for r in token_counts.truncated_totals(histogram, limits).collect()} == {x: sum(min(n, x) for n in lengths) for x in limits}
    ordered = sorted(lengths)
    for r in token_counts.quantiles(histogram, [0.25, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for i, x in enumerate(ordered, 1) if i >= r.p * len(ordered))
    assert token_counts.length_histogram(counted.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbßÀéİıſΣςσ'´stdeg 0 9.,!?\t\n\x1c\x85\u0301\u3000日本😀ﬁŉ"), max_size=40), min_size=1, max_size=6))
def test_word_encoder_equals_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.word_encoder(path)(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == packing.word_encoder(path).tokenizer.encode(text, add_special_tokens=False).ids


def test_buckets(spark, tmp_path):
    rows = [(1, "some words here and there " * 40), (2, "x"), (3, None), (None, "")]
    packed = packing.pack_powers_of_two(helpers.docs(spark, rows), max_length=64)
    packing.write_buckets(packed, str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert read.count() == packed.count() and all(r.length == 2**r.bucket for r in read.collect())
    assert {r.bucket: (r.length, r.n_tokens) for r in packing.bucket_totals(packed).collect()}[0][0] == 1
    empty = packing.pack_powers_of_two(helpers.docs(spark, rows).limit(0))
    assert empty.count() == 0 and packing.bucket_totals(empty).count() == 0
