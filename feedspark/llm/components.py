"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.session import materialize


def _lowest(arcs: DataFrame) -> DataFrame:
    """For each node, the smallest node among itself and its neighbours."""
    return arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the smallest node reachable.

    A node's neighbours are hung on its smallest neighbour, first the larger ones, then the
    rest, until nothing changes. Each round needs one sum per node and one join on it, so a
    node with very many neighbours sends one row per task to its sum. The number of rounds
    follows the logarithm of the longest path. Self edges and null ends are ignored.
    """
    arcs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    arcs = materialize(arcs)
    known = None
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_lowest(both), "u")
            .filter("v > u AND v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small = large.join(_lowest(large), "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        arcs = materialize(small)
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    roots = arcs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(arcs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
