"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discarded, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the component's smallest node.

    Each step hangs nodes on the smallest node near them, by a grouped minimum (combined before the shuffle)
    and a join. The minimum is a table of its own before the join, so that the join has an exchange on both sides and a node
    with very many neighbours is split like any skewed key. Every step's edges are a table
    in the shared folder; only whether they are stars by now reaches the driver. Null ends and loops are no edges.
    """
    a, b = F.col(src), F.col(dst)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "edges")
    while True:
        # stars only: every node hangs on one other, on which nothing else depends
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        both = edges.union(edges.select("v", "u")).toDF("u", "w")
        low = written(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("w > u").join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discarded(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.union(low).distinct(), "edges")
        discarded(old, large, low)
