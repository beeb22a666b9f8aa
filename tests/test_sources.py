"""Sources, sinks, streaming and the checks of the relational operators."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import relations as R
from strandline.sources import archive, lists
from strandline.streaming import ingest

A, B, C = (str(uuid.UUID(int=i)) for i in (1, 2, 3))


def test_id_list(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text(f"# comment\n{A}\n\n  {B.replace('-', '').upper()}  \n{A}\n")
    assert sorted(r.read_id for r in lists.read_ids(spark, str(p)).collect()) == [A, B]
    p.write_text(f"{A}\nnot-an-id\n")
    with pytest.raises(Exception, match="not a read id"):
        lists.read_ids(spark, str(p)).collect()


def test_mapping_last_wins(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(f"read_id, barcode\n{A},BC01\n{B},\n,BC09\n{A},BC02\n")
    assert {r.read_id: r.barcode for r in lists.read_mapping(spark, str(p), ["barcode", "predicted_barcode"]).collect()} == {A: "BC02"}
    assert lists.read_mapping(spark, str(p), ["barcode"], keep_empty=True).count() == 2
    with pytest.raises(ValueError):
        lists.read_mapping(spark, str(p), ["output"])


def test_fasta_and_kmers(spark, tmp_path):
    p = tmp_path / "r.fa"
    p.write_text(">one first\nacg\nTT\n>two\nGGA\n")
    assert {r.name: r.sequence for r in lists.read_fasta(spark, str(p)).collect()} == {"one": "ACGTT", "two": "GGA"}
    p.write_text("# c\nkmer\tlevel\nacg\t1.5\nAAA\tx\nACG\t2.5\nCC\n")
    assert [(r.kmer, r.level) for r in lists.read_kmer_levels(spark, str(p)).collect()] == [("ACG", 2.5)]


def test_design(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("ldx,edx,condition,replicate\nL1,E1,fresh,r1\nL2,E2,frozen,\n")
    design, keys = lists.read_design(spark, str(p), ["ldx", "edx", "other"])
    assert keys == ["ldx", "edx"]
    reads = spark.createDataFrame([(A, "L1", "E1"), (B, "L2", "E2"), (C, "L1", "E2")], "read_id string, ldx string, edx string")
    R.check_design(design, keys)
    got = {r.read_id: (r.condition, r.replicate) for r in R.derive_design(reads, design, keys).collect()}
    assert got == {A: ("fresh", "r1"), B: ("frozen", None), C: (None, None)}
    with pytest.raises(ValueError):
        R.check_design(design.union(design), keys)


def test_archive_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(str(uuid.UUID(int=i)), rng.integers(-500, 500, n).tolist()) for i, n in enumerate([1, 100, 250, 1000])]
    reads = spark.createDataFrame(rows, "read_id string, signal array<smallint>")
    chunks = archive.split_chunks(reads, 100)
    info = spark.createDataFrame([("acq", 4000)], "acquisition_id string, sample_rate int")
    archive.write_archive({"reads": reads.select("read_id", F.size("signal").cast("long").alias("num_samples")), "signal": chunks, "run_info": info}, str(tmp_path / "a"))
    back = archive.open_archive(spark, str(tmp_path / "a"))
    assert back["reads"].select("tracked_scaling_scale").distinct().collect()[0][0] == 1.0
    assert {r.read_id: r.signal for r in archive.signal_of(back["signal"]).collect()} == dict(rows)
    assert {r.read_id: r.signal for r in archive.signal_of(back["signal"], first=150).collect()} == {i: s[:150] for i, s in rows}
    few = back["reads"].where("num_samples > 200")
    assert archive.signal_of(back["signal"], few).count() == 2
    assert {r.read_id: r.samples for r in archive.byte_counts(back["signal"]).collect()} == {i: len(s) for i, s in rows}


def test_fields_and_criteria(spark):
    assert R.resolve_fields(ids_only=True) == ["read_id"] and R.resolve_fields() == R.DEFAULT_FIELDS
    assert R.resolve_fields(exclude=["well"]) == [f for f in R.DEFAULT_FIELDS if f != "well"]
    for bad in ({"include": ["nope"]}, {"include": ["well"], "exclude": ["well"]}):
        with pytest.raises(ValueError):
            R.resolve_fields(**bad)
    with pytest.raises(ValueError):
        R.filter_reads(spark.range(1), min_samples=None)


def test_streaming_merge_and_activity(spark, tmp_path):
    rows = [(i % 6, f"2024-01-01 00:{i:02d}:00", i % 2, 10) for i in range(12)]
    src = spark.createDataFrame(rows, "read_id long, t string, channel int, num_samples long").withColumn("t", F.to_timestamp("t"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.landed(spark, str(tmp_path / "in"), "read_id long, t timestamp, channel int, num_samples long", 1)
    assert ingest.run_to_end(ingest.merged(stream, "t"), "merged_reads", str(tmp_path / "c1")).count() == 6
    got = ingest.run_to_end(ingest.channel_activity(stream, "t", "6 minutes"), "activity", str(tmp_path / "c2"), "complete").collect()
    assert sum(r.reads for r in got) == 12 and {r.channel for r in got} == {0, 1}


def test_outputs_are_found_through_their_file_system(spark, tmp_path):
    from strandline.sources import sinks

    spark.range(3).write.parquet(f"{tmp_path}/old")
    spark.range(10).write.parquet(f"{tmp_path}/new")
    for target in (f"file://{tmp_path}/old", f"file:{tmp_path}/old", f"{tmp_path}/old"):
        assert sinks.repack(spark, f"{tmp_path}/new", target, 5) is False
        assert spark.read.parquet(target).count() == 3
        with pytest.raises(FileExistsError):
            sinks.check_output(target, [])
    for source in (f"file://{tmp_path}/new", f"{tmp_path}/new/part.parquet", f"{tmp_path}"):
        with pytest.raises(ValueError):
            sinks.check_output(f"{tmp_path}/new", [source], force=True)
    assert sinks.repack(spark, f"{tmp_path}/new", f"file://{tmp_path}/old", 5, force=True)
    assert spark.read.parquet(f"{tmp_path}/old").count() == 10
