"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """edges: a, b. Returns node, comp (the smallest node reachable), for nodes that have an edge.

    Each round hooks every node to its smallest neighbour, shortens the hooks to their roots by doubling, and contracts
    the edges to those between roots; rounds and doublings are logarithmic. Counts are map-side combined, and nothing
    but whether a table is empty reaches the driver."""
    current = scratch.write(edges.filter("a <> b").select("a", "b").distinct(), f"{tag}-edges0")
    labels, step = None, 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), f"{tag}-hooks{step}-0")
        jump = 0
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jump += 1
            further = scratch.write(hooks.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), f"{tag}-hooks{step}-{jump}")
            hooks = further.select("node", "root")
            scratch.drop(f"{tag}-hooks{step}-{jump - 1}")
            if further.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("comp"))
        else:
            over = hooks.select(F.col("node").alias("comp"), "root")
            labels = labels.join(over, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        labels = scratch.write(labels, f"{tag}-labels{step}")
        low, high = hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        current = current.join(low, "a").join(high, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        step += 1
        current = scratch.write(current, f"{tag}-edges{step}")
        for done in (f"hooks{step - 1}-{jump}", f"edges{step - 1}", f"labels{step - 2}"):
            scratch.drop(f"{tag}-{done}")
        if current.isEmpty():
            return labels
