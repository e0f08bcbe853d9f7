"""Connected components of an edge table by alternating star steps.

Each round hangs every node's larger neighbours on its least neighbour, then does the same for smaller neighbours; the
rounds needed grow with the logarithm of a component's size. No group of edges is gathered: rounds are minima by
key, combined before they are shuffled, and joins, which the engine splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.shared import fresh_path, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long). Returns node, component (the least node reachable) for every node that has an edge."""
    spark, last = edges.sparkSession, None

    def kept(df: DataFrame) -> DataFrame:
        """The round's edges, written; those of the round before are deleted."""
        nonlocal last
        path = fresh_path(spark, "edges")
        df.write.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
        return spark.read.schema(df.schema).parquet(path)

    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        edges = kept(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # every edge now leads from a node to its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
