"""Toxicity: held-out accuracy, determinism and the awkward cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import toxicity

from . import helpers

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    return toxicity.train(read("documents"), read("labels"))


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    caught = [r for r in rows if r.predicted == 1]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.toxic for r in caught) / len(caught) >= 0.9
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.75
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_rows_are_not_learnt_from(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, turned) == model
    for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).limit(200).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_awkward_rows(spark, model, make):
    rows = helpers.awkward()
    df = make(spark, rows)
    got = toxicity.score(df, model).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _ in rows)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxic_text_scores_higher(spark, model):
    plain = "the of and to in that is was for on as with be by at this from are " * 5
    bad = plain.replace("with", "idiot").replace("from", "scum")
    rows = {r.doc_id: r.score for r in toxicity.score(helpers.docs(spark, [(1, plain), (2, bad)]), model).collect()}
    assert rows[1] < 0.3 and rows[2] > 0.7


def test_no_labels(spark):
    docs = helpers.docs(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.drop_toxic(docs, model).count() == 2


def test_scores_equal_plain_python(spark, model):
    """Words, windows, compressed lengths and the calibration recomputed without Spark, ties at the threshold included."""
    import math

    import zstandard

    params = zstandard.ZstdCompressionParameters(
        window_log=12, hash_log=10, chain_log=10, search_log=4, min_match=5, target_length=1,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    made = []
    for content in (model.toxic, model.ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def plain(text):
        words = (text or "").split()
        saved = 0
        for at in range(0, len(words), 8):
            window = b"".join(toxicity.code(toxicity.stem(w)) for w in words[at : at + 8])
            saved += max(0, len(made[1].compress(window)) - len(made[0].compress(window)))
        hits, w = saved / 8, model.weights
        return 1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(hits) + w[2] * math.log1p(100 * hits / max(len(words), 1)) + w[3] * math.log1p(len(words)) / 5)))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(i, t) for i, t in helpers.awkward() if i is not None]
    want = sorted((i, round(plain(t), 9)) for i, t in rows)
    got = toxicity.score(helpers.docs(spark, rows), model).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in got) == want
    tie = got[0].score
    assert all(r.predicted == int(r.score >= tie) for r in toxicity.score(helpers.docs(spark, rows), model, threshold=tie).collect())
