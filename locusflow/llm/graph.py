"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; a component is named by its smallest node.

    Rounds of large-star and small-star hook every node to the smallest node it has seen,
    and end when the links no longer change.  The number of rounds grows with the
    logarithm of a component's size; links shrink to one per node.  Links to itself and
    null ends are ignored.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pair, before = checkpointed(pair), None
    while True:
        state = pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large star: the larger neighbours of a node move to its smallest neighbour.
        low = pair.groupBy("u").agg(F.min("v").alias("low"))
        at_smaller = pair.groupBy(F.col("v").alias("n")).agg(F.lit(1).alias("has"))
        low = low.join(at_smaller, low["u"] == at_smaller["n"], "left").select("u", "low")
        moved = pair.alias("p").join(low.alias("l"), F.col("p.v") == F.col("l.u"), "left")
        large = moved.select(F.col("p.u").alias("u"), F.coalesce("l.low", "p.v").alias("v")).distinct()
        # small star: all smaller neighbours of a node move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(least, "u")
        small = joined.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        hooks = least.select("u", F.col("low").alias("v"))
        pair = checkpointed(hooks.unionByName(small).distinct())
    roots = pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
