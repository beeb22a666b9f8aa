"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n ids gives n div L full sequences of L ids and one sequence for each set bit of the
rest, longest first. Sequences of equal length form a bucket, so a training step draws one bucket
and needs no padding. Everything happens in one narrow stage: no shuffle, whatever the input size.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, table

MAX_LENGTH = 4096
END_ID = 2
#: Bounds of the cache of words in a Python worker: entries, and characters of a word.
CACHE_WORDS, CACHE_CHARS = 400_000, 40
#: Rows encoded together; more of them share more words.
SLICE_ROWS = 2048
#: White space for ``str.split`` but not for the vocabulary's own pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Lower-case Latin letters, whose case and composed form need no context, then punctuation; else two empty groups.
#: Bytes as the letters that a byte-level vocabulary spells them with: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = dict(zip(sorted(set(range(256)) - set(_PRINTABLE)), range(256, 512)))
_LATIN = re.compile(r"^(?:([a-z\u00df-\u00f6\u00f8-\u024f]{1,40})([.,;:!?#*$%&|]{0,8})|.*)$", re.MULTILINE)



class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so texts are encoded word by word
    and frequent words are looked up; each different word of a batch is looked up once. New words
    that are Latin letters and then punctuation are two pre-tokens, and the letters go straight to
    the merges. Texts with separators that only Python calls white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.merges = self.tokenizer.model.tokenize

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters, which is one pre-token: straight from the merges."""
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merges(spelled)]).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of the words ``new``; short ones are kept."""
        known, letters, rare = self.known, self.letters, {}
        parts = _LATIN.findall("\n".join(new).lower())
        wanted = {run for run, _ in parts} - letters.keys() - {""}
        letters.update(zip(wanted, map(self._run, wanted)))
        marks = {mark for _, mark in parts} - letters.keys() - {""}
        if marks:
            marks = list(marks)
            letters.update(zip(marks, self._encode(marks)))
        letters[""] = b""
        known.update((w, letters[run] + letters[mark]) for w, (run, mark) in zip(new, parts) if run)
        whole = [w for w, (run, _) in zip(new, parts) if not run]
        for w, ids in zip(whole, self._encode(whole) if whole else ()):
            (known if len(w) <= CACHE_CHARS else rare)[w] = ids
        return rare

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.letters) > CACHE_WORDS:
            self.letters.clear()
        odd = [i for i, t in enumerate(texts) if any(c in t for c in _SEPARATORS)]
        split = pc.utf8_split_whitespace(pa.array(["" if i in odd else t for i, t in enumerate(texts)] if odd else texts, pa.string()))
        found = split.flatten().dictionary_encode()
        words, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        known = self.known
        new = [w for w in words if w not in known]
        rare = self._learn(new) if new else {}
        own = [known[w] if w in known else rare[w] for w in words] if rare else list(map(known.__getitem__, words))
        # Each different word once, then a gather for all words.
        flat = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        ids = flat[np.repeat(starts[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for i in odd:
            out[i] = self._encode([texts[i]])[0]
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first: ``most`` as often as it fits, then the set bits of the rest."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_powers_of_two(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per sequence: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    ``max_length`` must be a power of two. Each piece is a sequence of its own, so ``offset`` is 0
    and ``sequence_id`` numbers the pieces uniquely. ``bucket`` is log2 of the length; write with
    ``partitionBy("bucket")`` to lay equal lengths together.

    A null or empty text gives the end id alone. Null and repeated ids are kept as they are; each
    row is packed for itself. An empty table gives no rows.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]
    types = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in pieces(total, max_length):
                        for column, value in zip(out, (doc_id, start, n, ids[4 * start : 4 * (start + n)], total)):
                            column.append(value)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, types)], schema=types)

    packed = documents(docs, id_col, text_col).mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return packed.select(
        "*",
        F.round(F.log2("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences with one folder per bucket, so a training step reads equal lengths only; no shuffle, existing data is an error."""
    packed.write.partitionBy("bucket").parquet(path)


def bucket_totals(packed: DataFrame) -> DataFrame:
    """bucket, length, n_sequences and n_tokens of each bucket that occurs; an empty table gives no rows."""
    return packed.groupBy("bucket").agg(F.max("length").alias("length"), F.count("*").alias("n_sequences"), F.sum("length").alias("n_tokens"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
