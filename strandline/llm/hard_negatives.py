"""Hard negatives for anchor vectors by exact search over a pivot table.

Vectors are integers, scores inner products. A vector v with squared norm n gets one more coordinate,
sqrt(M - n) with M the largest squared norm, an anchor gets 0 there; then
distance(anchor, v)^2 = |anchor|^2 + M - 2 * score, so a larger score is a smaller Euclidean distance.
The pivot table stores each vector's distances to a few pivots. Rows near each other (same label, same
nearest pivot, similar distance) share a block of BLOCK rows with the least and largest distance to each
pivot; by the triangle inequality these bracket the distance, and so the score, of an anchor to every
row of the block. Only blocks whose bracket meets what an anchor still looks for are compared, exactly.

Anchors are searched in groups, blocks in chunks; a cell (group, chunk) holds a bounded number of
either. Every cell returns the best of its rows for each anchor, and the best of these are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import discard, materialize, table

SCALE = 256
#: Components of this magnitude and more count as not finite, so that scores are exact in 64 bits.
LARGEST = 131_072
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows of a block, anchors of a group, blocks of a cell (at most), pivots, rows that pivots are chosen from.
BLOCK, GROUP, CELL, PIVOTS, SAMPLE = 256, 1024, 256, 16, 4096
#: Groups whose summaries (about 300 bytes each) go to the tasks in one round; more groups take more rounds.
ROUND = 32_768
#: Score of which nothing is below, and above.
NONE, ANY = -(2**62), 2**62

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BLOCKS = "block long, n int, label_lo long, label_hi long, ids binary, labels binary, vectors binary, lo binary, hi binary"
_ANCHORS = "anchor long, anchor_id long, label long, near int, reach double, vector binary, distances binary, floor long"
_GROUPS = "`group` long, n int, label_lo long, label_hi long, anchors binary, labels binary, vectors binary, distances binary, low binary, high binary"
_FOUND = "anchor long, slot int, score long, other_id long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (floor of SCALE times each component) of the rows that take part.

    Rows with a null id, label or vector, or a null, non-finite or huge (LARGEST) component, are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("e"))
    usable = rows.where("vec_id is not null and label is not null and e is not null").where(
        F.forall("e", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST), F.lit(False)))
    )
    return usable.select("vec_id", "label", F.transform("e", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _read(b: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b, dtype=kind).reshape(shape)


def _stack(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of the same length; missing components count as 0."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Space:
    """The pivots and the largest squared norm; distances in the space with one more coordinate."""

    def __init__(self, sample: np.ndarray, largest: int, count: int = PIVOTS):
        """Pivots are taken from the sample one by one, each the row farthest from those taken."""
        self.largest = float(largest)
        self.pivots = np.zeros((0, sample.shape[1]))
        self.extra = np.zeros(0)
        far = np.full(len(sample), np.inf)
        for _ in range(min(count, len(sample))):
            i = int(np.argmax(far))
            if far[i] == 0:
                break
            self.pivots = np.vstack([self.pivots, sample[i : i + 1].astype(float)])
            self.extra = np.sqrt(np.maximum(self.largest - (self.pivots**2).sum(1), 0))
            far = np.minimum(far, self.of_rows(sample)[:, -1])

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        own = np.sqrt(np.maximum(self.largest - (v**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.largest - 2 * (v @ self.pivots.T + own[:, None] * self.extra), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.largest - 2 * (q @ self.pivots.T), 0))


def _brackets(largest: float, q2_lo, q2_hi, a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of anchors, whose pivot distances lie in [a_lo, a_hi], to rows in [b_lo, b_hi]; pivots are the last axis."""
    near = np.maximum(np.maximum(a_lo - b_hi, b_lo - a_hi), 0).max(-1)
    far = (a_hi + b_hi).min(-1)
    slack = 1 + 1e-9 * (largest + np.asarray(q2_hi))  # distances are rounded, scores are whole
    return (q2_lo + largest - far**2) / 2 - slack, (q2_hi + largest - near**2) / 2 + slack


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles where they hold every partial sum, else in 64-bit integers."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ v.T.astype(np.int64)


def _blocks(rows: DataFrame, space: _Space, dims: int) -> DataFrame:
    """The pivot table in blocks of rows with near labels, pivots and distances."""

    def place(batches):
        for t in batches:
            if len(t):
                d = space.of_rows(_stack(t.v, dims))
                near = d.argmin(1)
                yield t.assign(near=near.astype("int32"), reach=d[np.arange(len(d)), near])

    def cut(batches):
        number, rest = 0, None
        for t in batches:
            rest = t if rest is None else pd.concat([rest, t], ignore_index=True)
            whole = len(rest) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                yield block(rest.iloc[i : i + BLOCK], number)
                number += 1
            rest = rest.iloc[whole:]
        if rest is not None and len(rest):
            yield block(rest, number)

    def block(t: pd.DataFrame, number: int) -> pd.DataFrame:
        v = _stack(t.v, dims)
        d = space.of_rows(v)
        labels = t.label.to_numpy()
        row = ((TaskContext.get().partitionId() << 32) + number, len(t), int(labels.min()), int(labels.max()), _pack(t.vec_id, "i8"), _pack(labels, "i8"), _pack(v, "i4"), _pack(d.min(0), "f8"), _pack(d.max(0), "f8"))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    order = ["label", "near", "reach", "vec_id"]
    placed = rows.mapInPandas(place, "vec_id long, label long, v array<int>, near int, reach double")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, _BLOCKS)


def _anchors(blocks: DataFrame, space: _Space, dims: int, every: int, positives: int) -> DataFrame:
    """The rows whose id is divisible by ``every``, with the score that their positives reach in their own block at least."""

    def pick(batches):
        for t in batches:
            for b in t.itertuples():
                ids, labels, v = _read(b.ids, "i8", -1), _read(b.labels, "i8", -1), _read(b.vectors, "i4", b.n, dims)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    s = np.where(labels[own, None] == labels[None, :], _product(v[own], v), NONE)
                    s[np.arange(len(own)), own] = NONE
                    seed = np.partition(s, -positives, axis=1)[:, -positives] if b.n >= positives else np.full(len(own), NONE)
                    d, of_rows = space.of_anchors(v[own]), space.of_rows(v[own])
                    near = of_rows.argmin(1)
                    yield pd.DataFrame(
                        {
                            "anchor": b.block * BLOCK + own, "anchor_id": ids[own], "label": labels[own], "near": near.astype("int32"), "reach": of_rows[np.arange(len(own)), near],
                            "vector": [_pack(x, "i4") for x in v[own]], "distances": [_pack(x, "f8") for x in d], "floor": seed,
                        }
                    )

    return blocks.mapInPandas(pick, _ANCHORS)


def _numbered(anchors: DataFrame) -> DataFrame:
    """``group``: anchors in the order of the blocks, GROUP at a time. Numbers come from totals of partitions, so no task sees all."""
    order = ["label", "near", "reach", "anchor"]
    ranged = materialize(anchors.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(bases), "part").withColumn("group", F.expr(f"(base + place) div {GROUP}"))
    out = materialize(numbered.drop("part", "place", "base"))
    discard(ranged)
    return out


def _groups(anchors: DataFrame, dims: int) -> DataFrame:
    """Anchors (with arrays ``low`` and ``high``, the scores they look for in each slot) packed by group, GROUP at most."""

    def pack(key, t):
        t = t.sort_values("anchor")
        n = len(t)
        v = np.stack([np.frombuffer(x, "i4") for x in t.vector]).reshape(n, dims)
        low, high = np.stack(t.low), np.stack(t.high)
        row = (key[0], n, int(t.label.min()), int(t.label.max()), _pack(t.anchor, "i8"), _pack(t.label, "i8"), _pack(v, "i4"), b"".join(t.distances), _pack(low, "i8"), _pack(high, "i8"))
        return pd.DataFrame([row], columns=[c.split()[0].strip("`") for c in _GROUPS.split(", ")])

    return anchors.groupBy("group").applyInPandas(pack, _GROUPS)


def _pairs(blocks: DataFrame, groups: DataFrame, largest: int, dims: int, same: bool) -> DataFrame:
    """Pairs (group, block) that the labels and the brackets of pivot distances leave. ROUND groups at a time go to the tasks."""

    def summary(batches):
        for t in batches:
            out = []
            for g in t.itertuples():
                d, v = _read(g.distances, "f8", g.n, -1), _read(g.vectors, "i4", g.n, dims).astype(float)
                q2, low, high = (v**2).sum(1), _read(g.low, "i8", g.n, -1), _read(g.high, "i8", g.n, -1)
                out.append((g.group, g.label_lo, g.label_hi, _pack(d.min(0), "f8"), _pack(d.max(0), "f8"), q2.min(), q2.max(), int(low.min()), int(high.max())))
            yield pd.DataFrame(out, columns=["group", "label_lo", "label_hi", "lo", "hi", "q2_lo", "q2_hi", "low", "high"])

    short = materialize(groups.mapInPandas(summary, "`group` long, label_lo long, label_hi long, lo binary, hi binary, q2_lo double, q2_hi double, low long, high long"))
    last = short.agg(F.max("group")).first()[0]
    narrow, found = blocks.select("block", "label_lo", "label_hi", "lo", "hi"), None
    for start in range(0, (last if last is not None else -1) + 1, ROUND):
        some = short.where((F.col("group") >= start) & (F.col("group") < start + ROUND)).toPandas()
        if not len(some):
            continue
        lo, hi = np.stack([np.frombuffer(x, "f8") for x in some.lo]), np.stack([np.frombuffer(x, "f8") for x in some.hi])
        g = {c: some[c].to_numpy() for c in ("group", "label_lo", "label_hi", "q2_lo", "q2_hi", "low", "high")}

        def meet(batches, g=g, lo=lo, hi=hi):
            for t in batches:
                for b in t.itertuples():
                    if same:
                        ok = (g["label_lo"] <= b.label_hi) & (g["label_hi"] >= b.label_lo)
                    else:  # of another label, unless all are of one
                        ok = ~((g["label_lo"] == g["label_hi"]) & (b.label_lo == b.label_hi) & (g["label_lo"] == b.label_lo))
                    least, most = _brackets(float(largest), g["q2_lo"], g["q2_hi"], lo, hi, np.frombuffer(b.lo, "f8"), np.frombuffer(b.hi, "f8"))
                    ok &= (most >= g["low"]) & (least <= g["high"])
                    yield pd.DataFrame({"group": g["group"][ok], "block": np.full(int(ok.sum()), b.block)})

        met = materialize(narrow.mapInPandas(meet, "`group` long, block long"))
        found = met if found is None else found.unionByName(met)
    discard(short)
    return found if found is not None else narrow.select(F.lit(None).cast("long").alias("group"), "block").limit(0)


class _Best:
    """The best ``k`` rows (score, then smaller id) of each anchor and slot so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.low, self.high = k, low, high
        n, slots = low.shape
        self.score = np.full((slots, n, k), NONE)
        self.id = np.full((slots, n, k), ANY)

    def wanted(self) -> np.ndarray:
        """The least score that can still change each anchor's result."""
        return np.maximum(self.low, self.score[:, :, -1].T).min(1)

    def add(self, anchors: np.ndarray, s: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        for slot in range(len(self.score)):
            last, last_id = self.score[slot, anchors, -1], self.id[slot, anchors, -1]
            ok = allowed & (s <= self.high[anchors, slot, None]) & (s >= np.maximum(self.low[anchors, slot], last)[:, None])
            ok &= (s > last[:, None]) | (ids[None, :] < last_id[:, None])
            a, r = np.nonzero(ok)
            if not len(a):
                continue
            touched, a = np.unique(a, return_inverse=True)
            whom = anchors[touched]
            who = np.concatenate([np.repeat(np.arange(len(touched)), self.k), a])
            score = np.concatenate([self.score[slot, whom].ravel(), s[touched[a], r]])
            ident = np.concatenate([self.id[slot, whom].ravel(), ids[r]])
            order = np.lexsort((ident, -score, who))
            first = np.searchsorted(who[order], np.arange(len(touched)))
            keep = order[first[:, None] + np.arange(self.k)]
            self.score[slot, whom], self.id[slot, whom] = score[keep], ident[keep]

    def rows(self, anchors: np.ndarray) -> pd.DataFrame:
        slot, a, place = np.nonzero(self.score > NONE)
        return pd.DataFrame({"anchor": anchors[a], "slot": slot.astype("int32"), "score": self.score[slot, a, place], "other_id": self.id[slot, a, place]})


def _search(blocks: DataFrame, groups: DataFrame, largest: int, dims: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows for each anchor and slot: anchor, slot, score, other_id; ``same``: of the anchor's label, or of others."""
    spark = blocks.sparkSession
    n_blocks, n_groups = blocks.count(), groups.count()
    parallel = 4 * spark.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(n_blocks / CELL), min(n_blocks, math.ceil(parallel / max(n_groups, 1))))
    pairs = _pairs(blocks, groups, largest, dims, same).withColumn("chunk", F.expr(f"pmod(xxhash64(block), {chunks})"))
    with_groups = pairs.select(F.col("group").alias("of"), F.col("chunk").alias("part")).distinct().join(groups.withColumnRenamed("group", "of"), "of")
    with_blocks = pairs.join(blocks, "block")

    def cell(_, g, b):
        if not len(g) or not len(b):
            return pd.DataFrame({"anchor": [], "slot": [], "score": [], "other_id": []})
        g = next(g.itertuples())
        q, labels, anchors = _read(g.vectors, "i4", g.n, dims), _read(g.labels, "i8", -1), _read(g.anchors, "i8", -1)
        d, q2 = _read(g.distances, "f8", g.n, -1), (q.astype(float) ** 2).sum(1)
        best = _Best(_read(g.low, "i8", g.n, -1), _read(g.high, "i8", g.n, -1), k)
        most_wanted = best.high.max(1)
        for t in b.sort_values("block").itertuples():
            least, most = _brackets(float(largest), q2, q2, d, d, np.frombuffer(t.lo, "f8"), np.frombuffer(t.hi, "f8"))
            who = np.flatnonzero((most >= best.wanted()) & (least <= most_wanted))
            if len(who):
                ids, theirs = _read(t.ids, "i8", -1), _read(t.labels, "i8", -1)
                allowed = (labels[who, None] == theirs[None, :]) == same
                allowed &= anchors[who, None] != t.block * BLOCK + np.arange(t.n)[None, :]
                best.add(who, _product(q[who], _read(t.vectors, "i4", t.n, dims)), ids, allowed)
        return best.rows(anchors)

    found = with_groups.groupBy("of", "part").cogroup(with_blocks.groupBy("group", "chunk")).applyInPandas(cell, _FOUND)
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def mine_hard_negatives(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (RESULT).

    Anchors are the rows whose id is divisible by ``every``; their positives the first POSITIVES other rows
    of the same label, by score and then smaller id. For each positive the first NEGATIVES rows of other
    labels with LOW * positive_score <= 100 * score <= HIGH * positive_score are ranked from 1; a
    positive without such rows (as one with a negative score) gives no row.

    For rows that take part see ``integer_vectors``. Rows of a repeated id are rows of their own, as
    anchors, positives and negatives; vectors of different lengths are compared as if the shorter one had
    zeros at its end. Without rows that take part there is no result.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, id_col, vector_col, label_col))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(F.size("v")).alias("dims")).first()
    if not stats["n"]:
        return spark.createDataFrame([], RESULT)
    dims, largest = max(stats["dims"], 1), stats["largest"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    space = _Space(_stack(sample.v, dims), largest)
    blocks = materialize(_blocks(rows, space, dims))
    discard(rows)

    anchors = _numbered(_anchors(blocks, space, dims, every, POSITIVES))
    first = materialize(_groups(anchors.withColumns({"low": F.array("floor"), "high": F.array(F.lit(ANY))}), dims))
    positives = materialize(_search(blocks, first, largest, dims, True, POSITIVES).select("anchor", (F.col("place") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id")))
    discard(first)

    # What each positive allows, a slot for each; an empty slot allows nothing.
    bounds = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    slots = F.sequence(F.lit(0), F.lit(POSITIVES - 1))
    low = F.transform(slots, lambda i: F.coalesce(F.ceil(F.col("p")[i] * LOW / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(ANY)))
    high = F.transform(slots, lambda i: F.coalesce(F.floor(F.col("p")[i] * HIGH / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(NONE)))
    second = materialize(_groups(anchors.join(bounds, "anchor").withColumns({"low": low, "high": high}), dims))
    negatives = _search(blocks, second, largest, dims, False, NEGATIVES).select("anchor", "slot", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("anchor", "anchor_id"), "anchor")
    return negatives.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the labels of the contract: every seventh id takes the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    return mine_hard_negatives(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


SQL = f"""
with e as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.rid as anchor, a.vec_id as anchor_id, b.rid as other, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.rid <> b.rid where a.vec_id % 100 = 0
), p as (
  select * from s where same qualify row_number() over (partition by anchor order by score desc, other_id) <= {POSITIVES}
)
select p.anchor_id, p.other_id as positive_id, cast(row_number() over w as integer) as rank, n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor = p.anchor and not n.same and {LOW} * p.score <= 100 * n.score and 100 * n.score <= {HIGH} * p.score
window w as (partition by p.anchor, p.other order by n.score desc, n.other_id)
qualify row_number() over w <= {NEGATIVES}
"""
