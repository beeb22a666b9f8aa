"""Connected components of links, as DataFrame operations only.

Alternating large-star and small-star passes (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every pass is a map-side combined minimum and a join that never gathers a hub's edges
in one task. Each pass is written to the shared folder, and the pass before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, join_hot, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: rows (u, v), u > v. Hang the neighbours of each node on its smallest neighbour.

    large: the larger neighbours, seen from both ends; small: the smaller ones and the node itself.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    if large:
        moved = join_hot(seen.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = join_hot(seen, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) for each node that has a link; component is the smallest node reachable.

    Links may repeat, run either way or join a node to itself (which gives no row). Links with a null
    end are left out. Without links there are no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    edges, before = materialize(edges), None
    total = edges.count()
    for _ in range(MAX_ROUNDS):
        stars = materialize(_star(edges, True, total))
        discard(edges)
        edges = materialize(_star(stars, False, total))
        discard(stars)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
        if now == before:
            break
        before, total = now, now["n"]
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Now every edge joins a node to the least of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
