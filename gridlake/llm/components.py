"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.sources.scratch import shared_dir


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in links (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours move to its
    smallest neighbour, then its smaller neighbours do. Minima are combined before the
    shuffle and the links are joined to them, so a hub's links may be split over tasks.
    """
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    edges = (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .distinct().checkpoint())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of a node hang below its minimum
        edges = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # smaller neighbours of a node, and the node, hang below the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = moved.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
        if now == state:
            break
        state = now
    top = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        top.select("id", F.col("id").alias("component")))
