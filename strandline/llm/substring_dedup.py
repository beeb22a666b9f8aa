"""Substring deduplication with a compressed FM-index per shard.

A repeated window is 50 consecutive words of a document that also start in a document with a smaller
id. Shards are named by content: every window takes the least hash among its short word runs (its
anchor), so equal windows always meet in one shard, and neighbouring windows with the same anchor
travel as one region of text. Only regions whose anchor occurs in two documents are sent, and equal
regions only once, for the document with the smallest id.

In a shard the regions are indexed: a suffix order, its Burrows-Wheeler transform in a wavelet
matrix of packed bits, and the smallest document of each group of suffixes that agree in 50 words.
The regions are then streamed against the index from right to left: backward search gives the
interval of each suffix, cut back to 50 words after every step (matching statistics at the
threshold), and the interval's smallest document. Runs of windows go back to all documents that
hold the region.

Inside a passage that many documents share, an anchor would gather all the different windows at the
passage's borders in one shard. So short runs that occur in many documents are hot, and a window
takes a hot one only if it has no other. A window that reaches over the border has a run that ends in
the document's own words, so the windows left to hot anchors lie within the passage, and equal
regions are sent once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import discard, documents, join_hot, materialize, table

WINDOW = 50
#: Words of a run that may anchor a window.
RUN = 8
#: A run is hot if it occurs in more documents than this, or than this share of all runs counted, as
#: estimated from one document in HOT_SAMPLE. The share bounds the list that every task gets.
HOT_DOCUMENTS, HOT_SHARE, HOT_SAMPLE = 256, 1e-6, 32
#: Words of one index; a shard's anchors are indexed in groups of about so many.
INDEX_WORDS = 400_000
SLICE_ROWS = 128
#: Odd bases of the hashes of words, of runs and of regions.
_WORD_BASE, _RUN_BASE, _REGION_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


@functools.lru_cache(maxsize=12)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, from one prefix sum."""
    room = 1 << max(17, int(len(values)).bit_length())
    power, inverse = _powers(base, room)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * power[: len(values)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def run_hashes(data: bytes, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and of its runs; both empty for a text without a window."""
    starts, ends = word_bounds(data)
    if len(starts) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = _span_hashes(np.frombuffer(data, np.uint8).astype(np.uint64), starts, ends, _WORD_BASE)
    at = np.arange(len(words) - run + 1)
    return words, _span_hashes(words, at, at + run, _RUN_BASE)


def regions(data: bytes, hot: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window and number of windows of each region of a text."""
    words, runs = run_hashes(data, window, run)
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    order = runs >> np.uint64(1)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, runs), len(hot) - 1)
        order |= (hot[place] == runs).astype(np.uint64) << np.uint64(63)
    inside = window - run + 1
    least = np.empty(n, np.int64)
    for a in range(0, n, 4096):  # bounded memory for long texts
        b = min(n, a + 4096)
        least[a:b] = np.lib.stride_tricks.sliding_window_view(order[a : b + inside - 1], inside).argmin(1) + np.arange(a, b)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    content = _span_hashes(words, first, first + count + window - 1, _REGION_BASE)
    return runs[least[first]].view(np.int64), content.view(np.int64), first, count


class PackedBits:
    """A bit vector with constant-time rank: packed words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, PackedBits, int]] = []
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1
            zeros = int(len(values) - bits.sum())
            self.levels.append((shift, PackedBits(bits), zeros))
            values = values[np.argsort(bits, kind="stable")]
        self.first = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, i) - self.first[symbol]


class FmIndex:
    """Index of several sequences of words for queries of at most ``window`` + 1 words.

    Suffixes are ordered by their first 64 words, which is all that such queries compare.
    """

    def __init__(self, sequences: list[np.ndarray], documents: np.ndarray, n_symbols: int, window: int = WINDOW):
        text = np.concatenate([np.concatenate([s, [0]]) for s in sequences]).astype(np.int64)
        lengths = np.array([len(s) + 1 for s in sequences])
        owner = np.repeat(documents, lengths)
        n, self.window = len(text), window
        rank, depth = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        halves = {1: rank}
        while depth <= window:
            ahead = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, n), np.int64)])[:n]
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            depth *= 2
            halves[depth] = rank
        order = np.argsort(rank, kind="stable")
        # Suffixes that agree in the window: two overlapping powers of two cover it.
        half = 1 << (window.bit_length() - 1)
        back = window - half
        ahead = np.concatenate([halves[half][back:] + 1, np.zeros(min(back, n), np.int64)])[:n]
        same = halves[half][order], ahead[order]
        cut = np.concatenate([[True], (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])])
        self.group = np.cumsum(cut) - 1
        self.group_start = np.flatnonzero(cut)
        self.group_end = np.concatenate([self.group_start[1:], [n]])
        self.group_least = np.minimum.reduceat(owner[order], self.group_start)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.transform = WaveletMatrix(text[order - 1], n_symbols)
        self.n = n

    def least_documents(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each sequence the smallest document that holds it (sequences must be indexed)."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        width = int(lengths.max(initial=0))
        backward = np.zeros((len(sequences), width), np.int64)
        for row, j in enumerate(order):
            backward[row, : lengths[j]] = sequences[j][::-1]
        found = np.zeros((len(sequences), max(0, width - self.window + 1)), np.int64)
        low, high = np.zeros(len(sequences), np.int64), np.full(len(sequences), self.n, np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(1, width + 1), side="right")
        for step in range(width):
            live = int(active[step])
            symbol = backward[:live, step]
            both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low[:live], high[:live]]))
            low[:live] = self.counts[symbol] + both[:live]
            high[:live] = self.counts[symbol] + both[live:]
            if step >= self.window - 1:
                group = self.group[low[:live]]
                low[:live], high[:live] = self.group_start[group], self.group_end[group]
                found[:live, step - self.window + 1] = self.group_least[group]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        for row, j in enumerate(order):
            out[j] = found[row, : max(0, lengths[j] - self.window + 1)][::-1]
        return out


_CUT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("most", pa.int64()), ("words", pa.binary())])
_RUNS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("least", pa.int64())])


def _pack(texts: pd.Series) -> pd.Series:
    codec = pa.Codec("zstd", compression_level=1)
    raw = [None if t is None else t.encode() for t in texts]
    return pd.Series([None if r is None else len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw], dtype=object)


def packed(text: Column) -> Column:
    """Texts in UTF-8 and zstandard, since a shuffle writes them in 0.43 of their size instead of 0.64; null stays null."""
    return F.pandas_udf(_pack, "binary")(text)


def unpacked(data: bytes | None) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True) if data else b""


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("__id", "__text"))


def _regions(docs: DataFrame, hot: list[int]) -> DataFrame:
    marked = np.array(sorted(h & (1 << 64) - 1 for h in hot), np.uint64)
    types = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [regions((t or "").encode(), marked) for t in part.column(2).to_pylist()]
                sizes = [len(x[0]) for x in out]
                columns = [np.repeat(part.column(c).to_numpy(), sizes) for c in (0, 1)] + [np.concatenate([x[c] for x in out]) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if c is columns[4] or c is columns[5] else c) for c in columns], schema=types)

    chosen = docs.where(F.col("__id").isNotNull()).select("__key", "__id", "__text")
    return materialize(chosen.mapInArrow(run, "key long, doc_id long, anchor long, content long, start int, n int"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the wanted regions: packed text, list of (anchor, content, start, n, most), doc_id."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part, out = batch.slice(at, SLICE_ROWS), []
            for text, wanted, doc_id in zip(*(part.column(c).to_pylist() for c in (0, 1, 2))):
                words = unpacked(text).split()  # bytes are cut at the same characters
                for w in wanted:
                    out.append((w["anchor"], w["content"], doc_id, w["most"], b" ".join(words[w["start"] : w["start"] + w["n"] + WINDOW - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _CUT)], schema=_CUT)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index and stream the regions of a partition, sorted by anchor, in groups of whole anchors."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in row[4].split(b" ")], np.int64) for row in held]
        index = FmIndex(sequences, np.array([row[2] for row in held], np.int64), len(ids) + 1)
        out = []
        for row, least in zip(held, index.least_documents(sequences)):
            cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(least)]):
                if least[a] < row[3]:  # some document with this region has a larger id
                    out.append((row[0], row[1], int(a), int(b) + WINDOW - 1, int(least[a])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _RUNS)], schema=_RUNS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= INDEX_WORDS and held[-1][0] != row[0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += row[4].count(b" ") + 2
    if held:
        yield flush()


def _distinct(found: DataFrame) -> DataFrame:
    """Each different region once, for the smallest document that holds it, with its number of copies."""
    return found.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "key", "start")).alias("owner"), F.max("doc_id").alias("most"), F.first("n").alias("n"), F.count("*").alias("copies"))


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different runs of a slice of documents, and in how many of them they occur."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            each = [np.unique(run_hashes((t or "").encode())[1]) for t in batch.column(0).slice(at, SLICE_ROWS).to_pylist()]
            runs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n)], names=["run", "n"])


def _hot_runs(docs: DataFrame) -> list[int]:
    """Runs that occur in many documents, estimated from every HOT_SAMPLE-th document by a hash of its key.

    They only choose the shard of a window, so the estimate can't change a result. There are at most
    1 / HOT_SHARE of them.
    """
    sample = docs.where((F.col("__key") % HOT_SAMPLE == 0) & F.col("__id").isNotNull()).select("__text")
    counted = materialize(sample.mapInArrow(_counted_runs, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where((F.col("n") > HOT_DOCUMENTS / HOT_SAMPLE) & (F.col("n") > total * HOT_SHARE)).select("run").toArrow()
    discard(counted)
    return hot.column(0).to_pylist()


def repeated_words(docs: DataFrame) -> DataFrame:
    """For keyed documents (__id, __text, __key): key, doc_id and ``spans``, the word ranges that repeat, for each that has any."""
    found = _regions(docs, _hot_runs(docs))
    distinct = materialize(_distinct(found).select("*", F.col("owner.doc_id").alias("least")))
    of_anchor = distinct.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    shared = of_anchor.where("least < most").select("anchor")
    wanted = distinct.join(shared, "anchor", "left_semi").select("anchor", "content", F.col("owner.doc_id").alias("doc_id"), F.col("owner.key").alias("key"), F.col("owner.start").alias("start"), "n", "most")
    by_key = wanted.groupBy("key", "doc_id").agg(F.collect_list(F.struct("anchor", "content", "start", "n", "most")).alias("wanted"))
    texts = docs.where("__id is not null").select("__key", "__id", packed(F.col("__text")).alias("__text"))
    cut = texts.join(by_key, (texts["__key"] == by_key.key) & (texts["__id"] == by_key.doc_id)).select("__text", "wanted", "doc_id").mapInArrow(_cut, "anchor long, content long, doc_id long, most long, words binary")
    runs = materialize(cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search, "anchor long, content long, a int, b int, least long").distinct())
    # A region that very many documents share is one row here and, being hot, joined by broadcast.
    region = F.struct("anchor", "content").alias("region")
    repeats = runs.groupBy(region).agg(F.collect_list(F.struct("a", "b", "least")).alias("repeats"))
    sized = materialize(repeats.join(distinct.select(region, "copies"), "region"))
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    discard(distinct)
    discard(runs)
    met = join_hot(found.select("key", "doc_id", "start", region), sized, "region", "copies", total)
    hits = met.select("key", "doc_id", "start", F.inline("repeats")).where("least < doc_id")
    return hits.groupBy("key", "doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))


def _without(data: bytes, spans: list[dict] | None) -> tuple[int, int, bytes | None]:
    """Number of words, of removed words, and the kept words joined by a space (None: nothing removed)."""
    starts, ends = word_bounds(data)
    n = len(starts)
    if not spans:
        return n, 0, None
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [s["a"] for s in spans], 1)
    np.add.at(change, [s["b"] for s in spans], -1)
    keep = np.cumsum(change[:-1]) == 0
    return n, int(n - keep.sum()), b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Null texts have no words. A row without an id has no smaller or larger one: nothing is removed
    from it or because of it. Repeated ids do not count against each other. An empty table gives no rows.
    """
    own = _keyed(documents(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")))
    spans = repeated_words(own)
    types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, rows = batch.slice(at, SLICE_ROWS), []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = unpacked(text)
                    n, removed, kept = _without(data, found)
                    rows.append((n, removed, (b" ".join(data.split()) if kept is None else kept).decode()))
                kept = [r[2] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(kept, pa.string())], schema=types)

    own = own.withColumn("__text", packed(F.col("__text")))
    return own.join(spans, (own["__key"] == spans.key) & (own["__id"] == spans.doc_id), "left").select("__id", "__text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with repeated words taken out; texts without any stay as they are."""
    own = _keyed(docs.withColumns({"__id": F.col(id_col).cast("long"), "__text": F.col(text_col)}))
    spans = repeated_words(own.select("__id", "__text", "__key"))
    names = docs.columns
    at, last = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = []
                for text, found in zip(part.column(at).to_pylist(), part.column(last).to_pylist()):
                    kept = _without(text.encode(), found)[2] if found else None
                    texts.append(text if kept is None else kept.decode())
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = spans.select(F.col("key").alias("__of"), F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans"))
    joined = own.join(found, (F.col("__key") == F.col("__of")) & (F.col("__id") == F.col("__doc")), "left")
    return joined.select(*names, "__spans").mapInArrow(run, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rows by windows spelled out; a word has no space in it.
SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
repeated as (select doc_id, i from windows join (select k, min(doc_id) as least from windows group by k) using (k) where doc_id > least),
covered as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from repeated)),
kept as (select doc_id, string_agg(v, ' ' order by p) as text from (select doc_id, unnest(w) as v, unnest(range(1, len(w) + 1)) as p from d) anti join covered using (doc_id, p) group by doc_id),
removed as (select doc_id, count(*) as n from covered group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join removed using (doc_id) left join kept using (doc_id)"""
