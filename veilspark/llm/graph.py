"""Connected components by hooking and pointer jumping (min labels, FastSV style).

Every round, each node's parent becomes the least of: its grandparent, the
grandparents of its neighbours, and - for a parent - what its children's
neighbours offer.  Rounds grow with the logarithm of the diameter.  The joins
run over the given edges, so a node costs its own degree; labels, which do
become hot, only meet in sums with a map-side part and as the many side of
joins with one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: the least node of its component,
    for every node with an edge.  Loops and repeated edges do no harm."""
    e = edges.select("a", "b").where("a <> b")
    both = scratch.cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    f = scratch.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("f")).withColumnRenamed("a", "node"))
    while True:
        up = f.select("node", "f").join(f.select(F.col("node").alias("f"), F.col("f").alias("gf")), "f")
        near = both.join(up.select(F.col("node").alias("b"), "gf"), "b").groupBy("a").agg(F.min("gf").alias("mn"))
        all_ = up.join(near.withColumnRenamed("a", "node"), "node")
        offers = all_.select(F.inline(F.array(
            F.struct(F.col("node"), F.least("f", "gf", "mn").alias("f"), F.col("f").alias("old")),
            F.struct(F.col("f").alias("node"), F.col("mn").alias("f"), F.lit(None).cast(f.schema["f"].dataType).alias("old")))))
        before = scratch.last
        f = scratch.cut(offers.groupBy("node").agg(F.min("f").alias("f"), F.max("old").alias("old")))
        if f.where("f <> old").isEmpty():
            return f.select("node", F.col("f").alias("root"))
        if before > 2:
            scratch.drop(before)
