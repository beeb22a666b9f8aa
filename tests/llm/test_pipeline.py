"""The pipeline, stage by stage, against plain versions of each stage on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import packing, pii, toxicity
from strandline.llm.common import materialize

from . import test_pii, test_simhash, test_substring_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "packing"]
    given = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        seen.append(docs)
    rows = [[r.asDict() for r in df.collect()] for df in (given, *seen)]
    assert all(df.columns == given.columns for df in seen[:-1])

    scored = toxicity.score(given, toxicity.train(given, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(r.doc_id for r in scored if r.predicted == 0)

    fps = {r["doc_id"]: test_simhash.plain_fingerprint(r["text"]) for r in rows[1]}
    component = test_simhash.plain_components(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(set(component.values()))
    texts = {r["doc_id"]: r["text"] for r in rows[1]}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows[2])

    want = {i: (k, t) for i, _, k, t in test_substring_dedup.plain([(r["doc_id"], r["text"]) for r in rows[2]])}
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    assert len(rows[3]) == len(rows[2])
    for r in rows[3]:
        removed, kept = want[r["doc_id"]]
        assert r["text"] == (kept if removed else before[r["doc_id"]]) and r["n_chars"] == len(r["text"])

    before = {r["doc_id"]: r["text"] for r in rows[3]}
    assert len(rows[4]) == len(rows[3])
    for r in rows[4]:
        assert not test_pii.base(r["text"])
        if not test_pii.base(before[r["doc_id"]]) and "[secret]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]

    tokenizer, parts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in rows[5]:
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert len(parts) == len(rows[4])
    for r in rows[4]:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID]
        assert b"".join(x for _, x in sorted(parts[r["doc_id"]])) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run_equals_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]
    assert got.count() > 0 and pii.KINDS[0] == "email"


def test_stages_take_awkward_rows(spark):
    """Nulls, empty texts, repeated rows, a very long text, an empty table and columns with clashing names go through every stage."""
    from . import helpers

    docs = materialize(helpers.clashing(spark, helpers.awkward(n=12)).withColumnRenamed("word", "key").withColumnRenamed("part", "spans"))
    empty = materialize(docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs, empty = materialize(stage(spark, docs, SF)), materialize(stage(spark, empty, SF))
        assert empty.count() == 0 and docs.count() > 0
        if stage is not corpus_pipeline.pack:
            assert docs.columns == empty.columns == columns
    assert {r.doc_tokens for r in docs.where("doc_id = 0").collect()} <= {1}
