"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges`` (long ids); a component's name is its smallest node.

    Self loops, repeated edges and edges with a null end are ignored. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. No neighbour
    list is gathered: a node's smallest neighbour is an aggregate with map-side
    combining, so hubs stay cheap.
    """
    now = (edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v"))
           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, mark = materialise(now, "edges"), None
    while True:
        last, now = now, materialise(_small_star(_large_star(now)), "stars")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
