"""Shortest paths in weighted directed graphs, edges (src, dst, weight), by frontier relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import stored


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """vertex, distance, prev for every vertex that the start reaches. Weights must not be negative.

    Each round relaxes the edges of the vertices that got nearer in the last one; rounds are the most edges on a shortest path.
    Of equally short ways the one over the smallest vertex is kept.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    known = spark.range(1).selectExpr(f"cast({start} as {kind}) as vertex", "0D as distance", f"cast(null as {kind}) as prev", "true as moved")
    known = stored(known, "paths")
    while True:
        front = known.where("moved")
        if front.isEmpty():
            return known.drop("moved")
        reached = front.join(edges, front["vertex"] == edges["src"]).select(F.col("dst").alias("vertex"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("prev"), F.lit(True).alias("moved"))
        merged = known.withColumn("moved", F.lit(False)).unionByName(reached).groupBy("vertex").agg(F.min(F.struct("distance", "prev")).alias("b"), F.min(F.when(~F.col("moved"), F.col("distance"))).alias("old"))
        known = stored(merged.select("vertex", "b.distance", "b.prev", F.coalesce(F.col("b.distance") < F.col("old"), F.lit(True)).alias("moved")), "paths")


def shortest_paths_dag(edges: DataFrame, start: int) -> DataFrame:
    """The same for graphs whose edges all lead to larger vertices; others are an error."""
    checked = edges.withColumn("dst", F.when(F.col("dst") > F.col("src"), F.col("dst")).otherwise(F.raise_error(F.lit("edges must lead to larger vertices")).cast(edges.schema["dst"].dataType)))
    return shortest_paths(checked, start)


def routes(paths: DataFrame) -> DataFrame:
    """vertex, distance, path (the vertices from the start) of shortest_paths(); a step of the walk back is a join."""
    steps = paths.select(F.col("vertex").alias("at"), F.col("prev").alias("before"))
    now = paths.select("vertex", "distance", F.col("prev").alias("at"), F.array("vertex").alias("path"))
    done = None
    while True:
        now = stored(now, "routes")
        ended = now.where("at IS NULL").select("vertex", "distance", "path")
        done = ended if done is None else done.unionByName(ended)
        now = now.where("at IS NOT NULL")
        if now.isEmpty():
            return done
        now = now.join(steps, "at").select("vertex", "distance", F.col("before").alias("at"), F.concat(F.array("at"), "path").alias("path"))
