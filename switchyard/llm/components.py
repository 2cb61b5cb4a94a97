"""Connected components of a link table by alternating large and small stars.

Every round is written to the shared folder.  The minimum of each node is a
plain aggregate (one row per node and task is shuffled); it is written before
it is joined back, so that adaptive execution can split a node with a large
share of all links.  Rounds end when every node has links to larger nodes only
or one link to a smaller node only: the links are then (node, smallest node of
its component).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v) pairs -> each v, and u itself, pointing at the smallest of u and its v."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-min")
    joined = pairs.join(least, "u")
    return joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
        least.select(F.col("u").alias("src"), F.col("m").alias("dst")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)`` for every node that has a link.

    ``component`` is the smallest node reachable.  Nulls are not links, loops
    and repeated links change nothing, no links give no rows.
    """
    e = (edges.where("src is not null and dst is not null and src <> dst")
         .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    e = written(e, "cc-links")
    for _ in range(max_rounds):
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
            e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        # large star: only larger neighbours move to the minimum
        smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        unsettled = (smaller > 1) | ((smaller > 0) & (larger > 0))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), unsettled.alias("unsettled")), "cc-large-min")
        if least.where("unsettled").isEmpty():
            nodes = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return nodes.unionByName(roots)
        # one row of each link at most, so repeats wait for the small star's distinct
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = written(large.where("src <> dst"), "cc-large")
        # small star: a node and its smaller neighbours move to the minimum
        small = _star(large.select(F.col("src").alias("u"), F.col("dst").alias("v")), "cc-small")
        e = written(small.where("src <> dst").distinct(), "cc-links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
