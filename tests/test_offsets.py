"""Running offsets of one large file: no window holds all of its reads."""

import contextlib
import io
import re

from strandline.operators import relations as R
from strandline.plans import registry


def test_offsets_by_batch(spark):
    rows = [("f" if i % 5 else None, i // 7 if i // 7 != 3 else None, i, i * i % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "source_file string, batch_idx int, row_idx int, num_samples long")
    want = R.running_offsets(df, "source_file", ["batch_idx", "row_idx"], "num_samples", "first_row")
    got = R.batched_offsets(df, "source_file", "batch_idx", ["row_idx"], "num_samples", "first_row")
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_window_over_the_reads_of_a_file(spark):
    with contextlib.redirect_stdout(text := io.StringIO()):
        registry.QUERIES["signal_row_offsets"](spark, "/root/testdata/sf0.001").explain()
    windows = re.findall(r"Window \[.*", text.getvalue())
    assert len(windows) == 2 and sum("_b#" in w for w in windows) == 1 and sum("_total#" in w for w in windows) == 1
