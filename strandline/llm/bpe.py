"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of one pre-token wait in buckets, one per merge rank, that hold positions of a linked
list of parts. A bitmap with a bit per rank, and bitmaps over its words, find the lowest rank that
waits by find-first-set, in time independent of the length of the pre-token. Entries whose pair has
changed since are skipped when they come up. Pre-tokens that come often are looked up instead.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, table

#: Bounds of a worker's caches: entries, and characters of a key.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 40
SLICE_ROWS = 256


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank and its leftmost position."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heappush(bucket, position)

    def remove(self, rank: int) -> None:
        """Forget an empty bucket."""
        del self.buckets[rank]
        middle = rank >> 6
        word = self.low[middle] = self.low[middle] & ~(1 << (rank & 63))
        if not word:
            high = rank >> 12
            word = self.mid[high] = self.mid[high] & ~(1 << (middle & 63))
            if not word:
                self.top &= ~(1 << high)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        word = self.mid[high]
        middle = high << 6 | (word & -word).bit_length() - 1
        word = self.low[middle]
        rank = middle << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.remove(rank)
        return rank, position


class ByteBpe:
    """A vocabulary of byte strings with ranks that are also their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks), default=1)
        self.strings = [b""] * (max(ranks.values(), default=-1) + 1)
        for string, i in ranks.items():
            self.strings[i] = string
        self.queue = RankQueue(len(self.strings))
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, longest = self.ranks, self.longest
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        queue, rank_of = self.queue, ranks.get
        buckets, low, mid, push = queue.buckets, queue.low, queue.mid, queue.push
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waiting = [-1] * (n + 1)  # rank of the pair that starts at a position, -1 for none
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions come in order, so the list stays a heap
                else:
                    push(rank, i)
        while top := queue.top:
            # The lowest waiting rank, by find-first-set on three levels, and its leftmost position.
            high = (top & -top).bit_length() - 1
            word = mid[high]
            middle = high << 6 | (word & -word).bit_length() - 1
            word = low[middle]
            rank = middle << 6 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                low[middle] = word
                if not word:
                    word = mid[high] = mid[high] & ~(1 << (middle & 63))
                    if not word:
                        queue.top &= ~(1 << high)
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            waiting[gone] = waiting[i] = -1
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (new := rank_of(piece[i:stop])) is not None:
                    waiting[i] = new
                    push(new, i)
            if i:
                j = before[i]
                new = rank_of(piece[j:end]) if end - j <= longest else None
                if new is None:
                    waiting[j] = -1
                elif new != waiting[j]:
                    waiting[j] = new
                    push(new, j)
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out

    def pretokens(self, text: str) -> bytes:
        """Ids of each match of the pattern, as little-endian unsigned 32-bit bytes."""
        known, out = self.known, []
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= CACHE_CHARS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class SpacedTexts(dict):
    """Looks up what stands between single spaces, then joins.

    A pre-token that holds a space starts with it, so in a text whose only white space is single
    spaces and line feeds next to none, cutting before each space never splits a pre-token. Other
    texts go through ``encode`` whole. A key stands for itself with a space in front.
    """

    #: White space other than space and line feed for the pattern or for Python, and doubled or outer white space.
    _ODD = [c for c in map(chr, range(0x3001)) if (c.isspace() or regex.match(r"\s", c)) and c not in " \n"] + ["  ", " \n", "\n ", "\n\n"]

    def _odd(self, text: str) -> bool:
        return text[0] == " " or text[-1] == " " or any(map(text.__contains__, self._ODD))

    def __init__(self, encode: Callable[[str], bytes | int], joined: Callable):
        super().__init__()
        self.encode, self.joined = encode, joined
        self.bare: dict[str, bytes | int] = {}

    def _bare(self, key: str) -> bytes | int:
        value = self.bare.get(key)
        if value is None:
            value = self.encode(key)
            if len(key) <= CACHE_CHARS:
                if len(self.bare) > CACHE_ENTRIES // 4:
                    self.bare.clear()
                self.bare[key] = value
        return value

    def __missing__(self, key: str) -> bytes | int:
        if "\n" in key:
            first, *rest = key.split("\n")
            line = self._bare("\n")
            parts = [self[first]]
            for x in rest:
                parts += [line, self._bare(x)] if x else [line]
            return self.joined(parts)
        value = self.encode(" " + key)
        if len(key) <= CACHE_CHARS:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value

    def text(self, text: str) -> bytes | int:
        if not text or self._odd(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        lines = first.split("\n")
        line = self._bare("\n") if len(lines) > 1 else None
        head = [self._bare(lines[0])] if lines[0] else []
        for x in lines[1:]:
            head += [line, self._bare(x)] if x else [line]
        return self.joined([*head, *map(self.__getitem__, rest)])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[ByteBpe, SpacedTexts]:
    own = ByteBpe(load_ranks(path), public_tokenizers.PATTERN)
    return own, SpacedTexts(own.pretokens, b"".join)


def encode_texts(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit), n_tokens.

    Null and empty texts have no ids. Null and repeated doc_ids are kept; an empty table gives no
    rows. The length of a text or of a pre-token is not limited.
    """
    return _coded(docs, ranks_path, id_col, text_col).select("doc_id", "ids", "n_tokens")


def decode_ids(encoded: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, decoded (bytes); the reverse of ``encode_texts``. Null ids give no bytes."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    types = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [own.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], schema=types)

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(decode, "doc_id long, decoded binary")


def _coded(docs: DataFrame, ranks_path: str | None, id_col: str, text_col: str, digests: bool = False) -> DataFrame:
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids"]
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((x, pa.string() if digests else pa.binary()) for x in names)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [texts.text(t or "") for t in part.column(1).to_pylist()]
                columns = [[len(x) // 4 for x in found]]
                if digests:
                    columns += [[hashlib.sha256(x).hexdigest() for x in found], [hashlib.sha256(own.decode(x)).hexdigest() for x in found]]
                else:
                    columns.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(types)[1:]))], schema=types)

    return documents(docs, id_col, text_col).mapInArrow(encode, f"doc_id long, n_tokens long, {', '.join(f'{x} {"string" if digests else "binary"}' for x in names)}")


def round_trip_digests(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass, with digests in place of ids and bytes."""
    return _coded(docs, ranks_path, id_col, text_col, digests=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
