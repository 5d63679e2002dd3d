"""Connected components of edge tables by alternating large-star and small-star steps.

Nulls, ties, repeats: an edge with a null end and an edge from a node to itself join nothing and are
left out; repeated edges count once; a node without edges is not in the result; an empty table gives
an empty result. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) edges of longs -> (node, root): every node that has an edge, and its component's least node.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the
    logarithm of the components' sizes. Minima combine before the shuffle, and a hub's edges join
    under skew handling, so no component needs to fit anywhere.
    """
    now = stored(_small_star(edges.where("u <> v")), label)
    state = None
    while True:
        last, now = now, stored(_small_star(_large_star(now)), label)
        discard(last)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), label)
    discard(now)
    return out
