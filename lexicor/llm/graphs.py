"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, component)``, the
    component being its smallest node; nodes without edges do not appear.

    Alternating large-star and small-star rounds: each links neighbours to
    the smallest one, so paths shrink by a constant factor a round. A round is
    two shuffles of rows of two ids (the neighbours of a node are only sorted
    past, and spilled to disk where they are many) and a written table, and
    never has more rows than the one before. While it runs it counts the edges
    at nodes that are neither a centre nor hang on one centre alone; a round
    that meets none found its input settled."""
    cur = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    around = Window.partitionBy("u")
    for _ in range(max_rounds):
        loose = Observation()
        both = (cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .select("u", "v", F.min("v").over(around).alias("low"), F.max("v").over(around).alias("high"))
                .observe(loose, F.count_if((F.col("low") < F.col("u")) & (F.col("low") < F.col("high"))).alias("n")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        small = large.repartition("u").distinct().withColumn("low", F.min("v").over(around))
        new = cut_lineage(small.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                       F.col("low").alias("v")), "edges")
        if not loose.get["n"]:
            # Equal edges became one in this round; a settled graph is its own next round.
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        cur = new
    raise RuntimeError("components did not settle")
