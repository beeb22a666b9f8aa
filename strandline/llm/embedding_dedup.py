"""Embedding near-duplicates by sorted projection passes.

In each pass a vector gets a key of concatenated random hashes (signs of random projections); the
vectors are numbered in lexicographic order of their keys over all partitions, and the order is cut
into fixed blocks. Each block is compared with itself and the next one, and with blocks farther and
farther on while it keeps finding links, so a dense group is met whole wherever partitions end. Links
are counted where they are found and only a spanning forest is stored; components follow from it. The
number of passes grows with the number of vectors (``passes_for``), so isolated pairs near the threshold are met at
every size. How far a block has come is kept in tables, joined by pass and block.

Cosines are computed in double precision. Vectors alike in every component are one class, so copies
are neither compared nor expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import discard, join_hot, materialize, table
from strandline.llm.components import connected_components

COSINE = 0.95
#: Least number of passes, hashes of a key, vectors of a block.
PASSES, HASHES, WINDOW, SEED = 12, 64, 64, 20240
#: Share of isolated pairs at the threshold that the passes are to meet.
RECALL = 0.97
BLOCK = 512
#: Blocks of ``window`` vectors in a tile, the unit that is compared in one group.
TILE = 64
#: Vectors a block has been compared with, in blocks, after so many rounds.
REACH = np.array([0] + [1 << r for r in range(1, 63)])


def _directions(seed: int, n: int, dims: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dims))


def passes_for(n: int, threshold: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """So many passes let an isolated pair at the threshold share its blocks in one of them with probability ``recall``.

    A hash parts such a pair with probability angle / pi and halves the vectors beside it. About
    log2(n / (1.5 window)) hashes must agree before a block and its neighbour hold all that are left, so a
    pass meets the pair with probability (1.5 window / n) ** rho, rho = -log2(1 - angle / pi), 0.154 at 0.95.
    """
    rho = -math.log2(1 - math.acos(threshold) / math.pi)
    met = min(1.0, 1.5 * window / max(n, 1)) ** rho
    return max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else PASSES


def keys(unit: np.ndarray, seed: int) -> np.ndarray:
    """The sort key of each unit vector: the signs of HASHES projections, a bit each, the first most significant."""
    signs = unit @ _directions(seed, HASHES, unit.shape[1]).T > 0
    return np.packbits(signs, axis=1).view(">u8").ravel().astype(np.uint64)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` names each node's set by its smallest node; the sets of a[k] and b[k] become one."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != (further := label[label])).any():
            label = further


def classes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, vector or null) and the classes as (vector, first, size, class_id).

    A class holds the vectors alike in every component; ``first`` is its smallest id and ``class_id`` a
    number of its own, since a repeated id may be the first of several classes. Vectors that are null,
    empty, zero, or hold a null or non-finite component have no class; neither have rows without an id.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0)
    # Adding 0.0 makes -0.0 equal to 0.0.
    rows = materialize(rows.withColumn("vector", F.when(usable, F.transform(v, lambda x: x + 0.0))))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()))  # written once, so it holds
    return rows, classes


def _keyed(passes: int):
    types = pa.schema([("class_id", pa.int64()), ("dims", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                unit = _unit(_matrix(part.column(1)))
                found = np.stack([(keys(unit, SEED + p) ^ np.uint64(1 << 63)).view(np.int64) for p in range(passes)], 1)  # signed order
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, passes, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(unit), dims, np.int32)), lists], schema=types)

    return run


def _placed(classes: DataFrame, passes: int, window: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The classes with ``places``, their number in the global order of each pass, and the first and last block of each vector length.

    Partitions are counted and a prefix sum over these few totals gives each its base, as in op9. Every
    length starts a new tile.
    """
    keyed = classes.select("class_id", "vector").mapInArrow(_keyed(passes), "class_id long, dims int, keys array<long>")
    narrow = keyed.select("class_id", "dims", F.posexplode("keys").alias("pass", "key"))
    ranged = materialize(narrow.repartitionByRange("pass", "dims", "key", "class_id").withColumn("part", F.spark_partition_id()))
    of = ["part", "pass", "dims"]
    totals = materialize(ranged.groupBy(*of).agg(F.count("*").alias("n")))
    blocks, first = {}, 0
    for dims, n in sorted((r["dims"], r["n"]) for r in totals.where("pass = 0").groupBy("dims").agg(F.sum("n").alias("n")).collect()):
        last = first + (n - 1) // window
        blocks[dims] = (first, last)
        first = (last // TILE + 1) * TILE
    # One row per partition, pass and length: their number bounds this window and the broadcasts.
    before = Window.partitionBy("pass", "dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.sparkSession.createDataFrame([(d, f * window) for d, (f, _) in blocks.items()], "dims int, start long")
    bases = totals.join(F.broadcast(starts), "dims").select(*of, (F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*of).orderBy("key", "class_id"))
    numbered = ranged.withColumn("row", inside).join(F.broadcast(bases), of).select("class_id", "pass", (F.col("base") + F.col("row")).alias("place"))
    places = numbered.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda s: s["place"]).alias("places"))  # one per pass
    # Single precision where it holds every component exactly; cosines are taken in double precision all the same.
    exact = F.forall("vector", lambda x: x.cast("float").cast("double") == x)
    vector = F.col("vector").cast("array<float>") if classes.where(~exact).isEmpty() else F.col("vector")
    return materialize(classes.select("class_id", "size", vector.alias("vector")).join(places, "class_id")), blocks


def _compared(blocks: dict[int, tuple[int, int]], at: int, threshold: float, window: int, pairs: bool):
    """Compares the active blocks of tile ``i_tile`` in pass ``pass`` with those of tile ``j_tile`` that lie in the reach of round ``at``.

    ``state`` has, for each pass, twice the rounds that the row's block has behind it, plus 1 if it is active now.

    Rows (kind, x, y, z): 0, a class and the vectors linked to it; 1, a pair of linked classes (all, or a
    spanning forest); 2, a pass, a block that goes on and the last block of its length. Every pair of
    classes counts in the first comparison only that covers it, by rounds, then passes; where that was
    follows from the places of both.
    """
    lo, hi = int(REACH[at]), int(REACH[at + 1])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        p, i_tile, j_tile = (group.column(c)[0].as_py() for c in ("pass", "i_tile", "j_tile"))
        places = _matrix(group.column("places").chunk(0), np.int64)
        order = np.argsort(places[:, p])
        places = places[order]
        unit = _unit(_matrix(group.column("vector").chunk(0))[order])
        state = _matrix(group.column("state").chunk(0), np.int64)[order] if at else np.ones_like(places)
        done, active = state // 2, state % 2
        after = done + active
        ids, sizes = (group.column(c).to_numpy()[order] for c in ("class_id", "size"))
        mine, of = places[:, p], places // window
        last = blocks[unit.shape[1]][1]
        counts, label, found, further = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], []
        for i in np.unique(of[:, p]):
            s, e = np.searchsorted(mine, (i * window, (i + 1) * window))
            if i // TILE != i_tile or not active[s, p]:
                continue
            js, je = np.searchsorted(mine, (max(i + lo, j_tile * TILE) * window, min(i + hi, (j_tile + 1) * TILE) * window))
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
            outer = False
            for start in range(js, je, BLOCK):
                u, v = np.nonzero(unit[s:e] @ unit[start : min(je, start + BLOCK)].T >= threshold)
                u, v = u + s, v + start
                gap = mine[v] - mine[u]
                u, v = u[gap > 0], v[gap > 0]
                outer |= bool((gap > (0 if at else window // 2)).any())
                for q in range(places.shape[1]):
                    if q == p or (q > p and not at) or not len(u):
                        continue
                    m, n = of[u, q], of[v, q]
                    rounds = (after if q < p else done)[np.where(m <= n, u, v), q]
                    new = np.abs(m - n) >= REACH[rounds]
                    u, v = u[new], v[new]
                a, b = np.concatenate([a, u]), np.concatenate([b, v])
            if outer and i + hi <= last:
                further.append(i)
            if len(a):
                np.add.at(counts, a, sizes[b])
                np.add.at(counts, b, sizes[a])
                if pairs:
                    found.append((ids[a], ids[b]))
                else:
                    label = _unite(label, a, b)
        if not pairs:
            below = np.nonzero(label != np.arange(len(ids)))[0]
            found.append((ids[below], ids[label[below]]))
        x = [ids[counts > 0], *[f[0] for f in found], np.full(len(further), p)]
        y = [counts[counts > 0], *[f[1] for f in found], np.array(further, np.int64)]
        kind = np.repeat([0] + [1] * len(found) + [2], [len(c) for c in x])
        return pa.table({"kind": pa.array(kind, pa.int32()), "x": pa.array(np.concatenate(x), pa.int64()), "y": pa.array(np.concatenate(y), pa.int64()), "z": pa.array(np.full(len(kind), last), pa.int64())})

    return run


def _with_state(rows: DataFrame, history: list[DataFrame]) -> DataFrame:
    """``rows`` with ``state`` (see ``_compared``).

    history: the blocks (pass, i) that went on to round 1, 2 and so on, the last to the one that begins;
    all blocks have round 0 behind them. Only classes of ``rows`` are looked up.
    """
    went = None
    for k, go in enumerate(history):
        now = k + 1 == len(history)
        one = go.select("pass", F.col("i").alias("block"), F.lit(2 * (k + 1) + 1 if now else 2 * (k + 2)).cast("long").alias("s"))
        went = one if went is None else went.unionByName(one)
    own = rows.select("class_id", "blocks").distinct().select("class_id", F.posexplode("blocks").alias("pass", "block"))
    own = own.join(went.groupBy("pass", "block").agg(F.max("s").alias("s")), ["pass", "block"], "left")
    states = own.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", F.coalesce("s", F.lit(2).cast("long")).alias("s")))), lambda x: x["s"]).alias("state"))  # one per pass
    return rows.drop("blocks").join(states, "class_id")


def _rounds(classes: DataFrame, threshold: float, passes: int | None, window: int, pairs: bool) -> DataFrame | None:
    """The rows of ``_compared`` of all rounds, null without classes.

    Round 0 compares every block with itself and the next one; a block that found links in the outer half
    of what it saw looks twice as far in the next round, over any number of tiles and partitions.
    """
    passes = passes or passes_for(classes.count(), threshold, window)
    placed, blocks = _placed(classes, passes, window)
    if not blocks:
        return None
    spark, found, at = classes.sparkSession, None, 0
    ranges = spark.createDataFrame(list(blocks.values()), "first long, last long")
    go = ranges.select(F.explode(F.sequence("first", "last")).alias("i"), "last").select(F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"), "i", "last")
    history: list[DataFrame] = []
    while True:
        lo, hi = int(REACH[at]), int(REACH[at + 1])
        end = F.least(F.col("i") + hi - 1, "last")
        tiles = go.select("pass", "i", end.alias("end"), F.expr(f"i div {TILE}").alias("i_tile"), F.explode(F.expr(f"sequence((i + {lo}) div {TILE}, least(i + {hi - 1}, last) div {TILE})")).alias("j_tile"))
        others = tiles.select("pass", F.explode(F.expr(f"sequence(greatest(i + {lo}, j_tile * {TILE}), least(end, j_tile * {TILE} + {TILE - 1}))")).alias("block"), "i_tile", "j_tile")
        needed = tiles.select("pass", F.col("i").alias("block"), "i_tile", "j_tile").unionByName(others).distinct()
        each = placed.select("class_id", "size", "vector", "places", F.posexplode("places").alias("pass", "place")).withColumn("block", F.expr(f"place div {window}")).drop("place")
        rows = each.join(needed, ["pass", "block"]).drop("block")
        if at:
            rows = _with_state(rows.withColumn("blocks", F.transform("places", lambda x: F.floor(x / window))), history)
        one = materialize(rows.groupBy("pass", "i_tile", "j_tile").applyInArrow(_compared(blocks, at, threshold, window, pairs), "kind int, x long, y long, z long"))
        found = one if found is None else found.unionByName(one)
        go = materialize(one.where("kind = 2").select(F.col("x").cast("int").alias("pass"), F.col("y").alias("i"), F.col("z").alias("last")).distinct())
        if go.isEmpty():
            for t in (placed, go, *history):
                discard(t)
            return found
        history.append(go)
        at += 1


def class_links(classes: DataFrame, threshold: float = COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """For tests: all distinct links (a, b) between classes, each named by its smallest id, a <= b, from all passes.

    Vectors of different lengths never link.
    """
    found = _rounds(classes, threshold, passes, window, pairs=True)
    if found is None:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    first = classes.select("class_id", "first")
    named = found.where("kind = 1").join(first.toDF("x", "p"), "x").join(first.toDF("y", "q"), "y")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, passes: int | None = None, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    ``n_links`` counts the other vectors linked directly, copies included. Vectors without a class
    (see ``classes_of``) link with nothing and are their own component; a null id keeps its row,
    with a null component. Repeated ids count as vectors of their own. An empty table gives no rows.
    """
    rows, classes = classes_of(vectors, id_col, vector_col)
    found = _rounds(classes, threshold, passes, window, pairs=False)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "kind int, x long, y long, z long")
    n_links = found.where("kind = 0").groupBy(F.col("x").alias("a")).agg(F.sum("y").alias("others"))
    component = connected_components(found.where("kind = 1"), "x", "y")
    of_class = materialize(
        classes.join(n_links, F.col("class_id") == n_links.a, "left")
        .join(component, F.col("class_id") == component.node, "left")
        .select("vector", "first", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("group"))
    )
    least = of_class.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    total = rows.count()
    named = join_hot(of_class, least, "group", "members", total).select("vector", "size", "n_links", "component_id")
    joined = join_hot(rows.where("vector is not null"), named, "vector", "size", total).select("vec_id", "n_links", "component_id")
    joined = joined.unionByName(rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
