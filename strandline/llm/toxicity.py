"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Each word becomes a 12-byte code of its stem (its first characters, lower-cased), since a match of
a short word hardly pays in zstandard's format, while a match of a code always saves the same.
Dictionaries of raw content hold the codes common to all training rows, then the codes that are
typical of one class. A window of a text is compressed with both; where the toxic dictionary wins,
the bytes saved count as evidence. The evidence of a text, its density and the text's length go
through a logistic calibration that is fitted on the training rows.

Training takes at most ``ROWS_PER_CLASS`` labelled documents of each class; everything else covers
all documents and whole texts. Scoring is one narrow stage.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, materialize, table

ROWS_PER_CLASS = 4000
STEM, CODE, WINDOW_WORDS = 4, 12, 8
#: A stem is typical of a class if this share of its rows and so many rows have it, with these odds against the other class.
LEAST_SHARE, LEAST_ROWS, LEAST_ODDS = 0.03, 4, 4.0
COMMON_STEMS = 60
THRESHOLD = 0.7
CACHE_WORDS, CACHE_CHARS = 300_000, 40
SLICE_ROWS = 256
_EDGES = ".,;:!?#*$%&|<>\"'()[]{}…"


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of (1, evidence, density, length)."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def stem(word: str) -> str:
    return word.lower().strip(_EDGES)[:STEM]


def code(text: str) -> bytes:
    return (xxhash.xxh64_digest(text) + xxhash.xxh64_digest(text, 1))[:CODE]


class Codes(dict):
    """Codes of words, kept for the frequent ones."""

    def __missing__(self, word: str) -> bytes:
        found = code(stem(word))
        if len(word) <= CACHE_CHARS:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


_CODES = Codes()


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=12, hash_log=10, chain_log=10, search_log=4, min_match=5, target_length=1,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def evidence(text: str, toxic: bytes, ordinary: bytes) -> tuple[int, int]:
    """Bytes that the toxic dictionary saves over all windows where it wins, and the number of words."""
    coded = b"".join(map(_CODES.__getitem__, text.split()))
    by_toxic, by_ordinary, step, saved = compressor(toxic).compress, compressor(ordinary).compress, WINDOW_WORDS * CODE, 0
    for at in range(0, len(coded), step):
        window = coded[at : at + step]
        gain = len(by_ordinary(window)) - len(by_toxic(window))
        if gain > 0:
            saved += gain
    return saved, len(coded) // CODE


def features(saved: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    hits = saved / 8.0
    return np.column_stack([np.ones(len(hits)), np.log1p(hits), np.log1p(100 * hits / np.maximum(n_words, 1)), np.log1p(n_words) / 5])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found = sorted({s for w in set((text.as_py() or "").split()) if (s := stem(w))})
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(found, pa.string())], names=["toxic", "stem"])


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``rows_per_class`` labelled, not held-out documents of each class, chosen by a hash of the id.

    An id labelled more than once is toxic if any label says so; null ids and null labels are left
    out. If a class has no rows the model scores every text by the share of toxic rows, 0 if none.
    """
    labelled = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for c in (0, 1):
        of_class = labelled.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen = of_class if chosen is None else chosen.unionByName(of_class)
    sample = materialize(documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic"))

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = 1.0 if n.get(1) else 0.0
        return Model(b"", b"", (math.inf if share else -math.inf, 0.0, 0.0, 0.0))
    counts = (
        sample.mapInArrow(_stems, "toxic int, stem string")
        .groupBy("stem")
        .agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary"))
    )
    # A text has a bounded number of stems of such a share, so few come to the driver.
    least = {c: max(LEAST_ROWS, LEAST_SHARE * n[c]) for c in n}
    shared = counts.where((F.col("toxic") >= least[1]) | (F.col("ordinary") >= least[0])).collect()

    def odds(r) -> float:
        return ((r.toxic + 0.5) / (n[1] + 1)) / ((r.ordinary + 0.5) / (n[0] + 1))

    common = sorted(shared, key=lambda r: (-(r.toxic + r.ordinary), r.stem))[:COMMON_STEMS][::-1]
    toxic = sorted((r for r in shared if r.toxic >= least[1] and odds(r) >= LEAST_ODDS), key=lambda r: (odds(r), r.stem))
    ordinary = sorted((r for r in shared if r.ordinary >= least[0] and odds(r) <= 1 / LEAST_ODDS), key=lambda r: (-odds(r), r.stem))
    made = [b"".join(map(code, [*(r.stem for r in common), *(r.stem for r in own), "\n"])) for own in (toxic, ordinary)]  # never empty

    seen = sample.mapInArrow(_evidence_of(*made, ["toxic"]), "toxic int, saved long, n_words long").toPandas()
    x = features(seen.saved.to_numpy(float), seen.n_words.to_numpy(float))
    return Model(*made, tuple(fit_logistic(x, seen.toxic.to_numpy(float)).tolist()))


def _evidence_of(toxic: bytes, ordinary: bytes, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [evidence(t or "", toxic, ordinary) if toxic else (0, 0) for t in part.column("text").to_pylist()]
                columns = [part.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([s for s, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64())],
                    names=[*keep, "saved", "n_words"],
                )

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null, empty and blank texts have no evidence and are scored by the calibration at zero words.
    Null ids are not held out. Repeated rows are scored alike; an empty table gives no rows.
    """
    w = model.weights
    scored = documents(docs, id_col, text_col).mapInArrow(_evidence_of(model.toxic, model.ordinary, ["doc_id"]), "doc_id long, saved long, n_words long")
    hits = F.col("saved") / F.lit(8.0)
    if math.isinf(w[0]):
        p = F.lit(1.0 if w[0] > 0 else 0.0)
    else:
        logit = (
            F.lit(w[0])
            + F.lit(w[1]) * F.log1p(hits)
            + F.lit(w[2]) * F.log1p(F.lit(100.0) * hits / F.greatest("n_words", F.lit(1)))
            + F.lit(w[3]) * F.log1p(F.col("n_words").cast("double")) / F.lit(5.0)
        )
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        p.alias("score"),
        (p >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns kept, whose text scores below ``threshold``."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if math.isinf(w[0]):
                    p = np.full(part.num_rows, float(w[0] > 0))
                else:
                    found = np.array([evidence(t or "", model.toxic, model.ordinary) for t in part.column(text_col).to_pylist()], float).reshape(-1, 2)
                    p = 1 / (1 + np.exp(-(features(found[:, 0], found[:, 1]) @ w)))
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(clean, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
