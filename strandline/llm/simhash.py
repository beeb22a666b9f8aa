"""SimHash near-duplicates by vantage points and vantage-point trees.

Fingerprints are linked at Hamming distance 4 or less. Equal fingerprints are one point. Vantage
points are drawn from the points themselves; every point has its home in the shard of the nearest
one. Let p and q be within r of each other and p no farther from its vantage point v than q is from
its own. By the triangle bound q is within h(q) + r of v, where h(q) is the distance to q's own
vantage point. So each point also visits the shards of all vantage points within h(q) + r, those
whose boundary it may overlap, and every link is met in the shard where one of its ends is at home.

Inside a shard a vantage-point tree compares the points at home with all that are there: a node
takes a vantage point, cuts at the median distance, and the triangle bound prunes what can't be
within r. The number of vantage points grows with the square root of the points, so both routing and
comparing grow as about their power 1.5. Shards with very many visitors are split by visitor.

A shard hands on a spanning forest of its links, never all pairs of a dense group: points within
r / 2 of a vantage point are within r of each other and are linked through it at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import discard, documents, join_hot, materialize, table
from strandline.llm.components import connected_components

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4
LEAF = 96
#: Vantage points for each square root of the number of points, and at most; they are sent to every task.
VANTAGE_SHARE, VANTAGE_MOST = 2.0, 1 << 16
#: Visitors of one group; a shard with more is split, its own points going to every part.
VISITORS = 1 << 15
#: Distances computed at once.
CHUNK = 1 << 20
SLICE_ROWS = 256
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFTS = np.arange(BITS - 1, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    words = _WORD.findall((text or "").encode().translate(_UPPER))
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    view = memoryview(joined)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # bounded memory for long texts
        ones += np.unpackbits(hashes[at : at + 8192].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int((np.uint64(1) << _SHIFTS)[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""
    types = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], schema=types)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` names each point's set by its smallest point; the sets of a[k] and b[k] become one."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != (further := label[label])).any():
            label = further


def _distances(points: np.ndarray, own: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(points[own] ^ points[v]).astype(np.int16)


def _compared(points: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links of all of ``a`` with all of ``b``, in bounded pieces; pairs that are connected already need no look."""
    step = max(1, CHUNK // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[b][None, :]) <= radius)
        if len(i):
            label = _unite(label, rows[i], b[j])
    return label


def tree_links(points: np.ndarray, home: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """Root of each point under the links that have an end in ``home`` (places in ``points``), and how many nodes the tree had.

    A node takes a vantage point among its points at home. Those within radius / 2 of it are linked to
    it, then compared with what lies within radius of them, and leave. The others are cut at the median
    distance m: the near ones can only link with points at m + radius or less, the far ones only with
    points above m - radius.
    """
    label, nodes = np.arange(len(points)), 0
    stack = [(home, np.arange(len(points)))]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= leaf * leaf:
            label = _compared(points, label, a, b, radius)
            continue
        nodes += 1
        v = a[len(a) // 2]
        da, db = _distances(points, a, v), _distances(points, b, v)
        core, around = da <= radius // 2, db <= radius // 2 + radius
        linked = b[db <= radius]
        label = _unite(label, np.full(len(linked), v), linked)
        if core.sum() > 1:
            others = b[around]
            label = _compared(points, label, a[core], others[label[others] != label[v]], radius)
        a, da = a[~core], da[~core]
        if not len(a):
            continue
        m = int(np.median(da))
        near = da <= m
        if near.all():
            near = da < m
        stack.append((a[near], b[db <= (da[near].max(initial=-radius - 1) + radius)]))
        stack.append((a[~near], b[db >= (da[~near].min() - radius)]))
    return label, nodes


def vantage_tree_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """Root of each point under all links of distance <= radius."""
    return tree_links(points, np.arange(len(points)), radius, leaf)[0]


def vantage_points(points: DataFrame, n: int, radius: int = RADIUS) -> np.ndarray:
    """Vantage points among ``n`` distinct fingerprints, chosen by a hash; none within 2 * radius of an earlier one.

    Keeping them apart lets a dense group have few, so its points visit few shards.
    """
    wanted = min(VANTAGE_MOST, math.ceil(VANTAGE_SHARE * math.sqrt(n)))
    chosen = np.array([r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()], np.int64).view(np.uint64)
    kept = np.empty(len(chosen), np.uint64)
    size = 0
    for p in chosen:
        if not size or np.bitwise_count(kept[:size] ^ p).min() > 2 * radius:
            kept[size] = p
            size += 1
    return kept[:size]


def _routed(vantage: np.ndarray, radius: int):
    """Each point with the shards it is in, and whether it is at home there."""
    types = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // len(vantage))
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(points), step):
                own = points[at : at + step]
                d = np.bitwise_count(own[:, None] ^ vantage[None, :])
                nearest = d.argmin(1)
                i, shard = np.nonzero(d <= d[np.arange(len(own)), nearest][:, None] + np.uint8(radius))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(own[i].view(np.int64)), pa.array(nearest[i] == shard)], schema=types)

    return run


def _shard_links(radius: int):
    def run(group: pa.Table) -> pa.Table:
        points, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy()
        order = np.argsort(points)  # copies of a home point that is also a visitor of this part are neighbours
        points, home = points[order], home[order]
        first = np.concatenate([[True], points[1:] != points[:-1]])
        own = np.flatnonzero(np.logical_or.reduceat(home, np.flatnonzero(first)))
        points = points[first]
        label, nodes = tree_links(points, own, radius)
        moved = np.flatnonzero(label != np.arange(len(points)))
        a, b = points[moved].view(np.int64), points[label[moved]].view(np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "nodes": pa.array(np.full(len(a), nodes, np.int32))})

    return run


def near_fingerprints(points: DataFrame, radius: int = RADIUS, fp_col: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within ``radius``.

    Null fingerprints have no link; without points there are no rows. ``nodes`` tells of how many
    nodes the shard's tree had.
    """
    distinct = materialize(points.select(F.col(fp_col).alias("fp")).where(F.col("fp").isNotNull()).distinct())
    n = distinct.count()
    if not n:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(0).alias("nodes"))
    vantage = vantage_points(distinct, n, radius)
    routed = materialize(distinct.mapInArrow(_routed(vantage, radius), "shard int, fp long, home boolean"))
    discard(distinct)
    # One row per vantage point, so the broadcast is bounded.
    parts = routed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(VISITORS)).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(parts), "shard")
    visiting = dealt.select("shard", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"), "fp", F.lit(False).alias("home"))
    at_home = dealt.where("home").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "fp", "home")
    return visiting.unionByName(at_home).groupBy("shard", "part").applyInArrow(_shard_links(radius), "a long, b long, nodes int")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable by links, itself included).

    Documents of equal fingerprint are one class, represented by the smallest id; links and
    components are found between classes. Null and blank texts have fingerprint 0 and are linked
    like any other. Null ids keep their row and take their class's component (null only if the
    whole component has no id); repeated ids are one node per fingerprint. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    linked = connected_components(near_fingerprints(classes, radius), "a", "b")
    joined = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first", "size", F.coalesce("component", "fp").alias("group"))
    joined = materialize(joined)
    discard(classes)
    total = marked.count()
    least = joined.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    of_class = join_hot(joined, least, "group", "members", total).select("fp", "size", "component_id")
    return join_hot(marked, of_class, "fp", "size", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose id is the smallest of its component.

    An id that stays is kept with each of its different texts, so no class of texts is lost where an
    id repeats; repeated rows of one id and text (null counts as empty) leave one row. Rows without an id can't be told
    apart and always stay. An empty table gives no rows.
    """
    found = near_duplicates(docs, radius, id_col, text_col)
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
    own = F.col(id_col).cast("long")
    again = F.when(F.col("__rows") > 1, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kept = docs.join(keep, own == F.col("__id")).withColumn("__again", again).dropDuplicates(["__id", "__again"])
    return kept.select(*docs.columns).unionByName(docs.where(own.isNull()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
