"""Connected components of an edge table, as DataFrame rounds.

Alternating stars: in the large star every vertex links its larger neighbours
to the smallest vertex it knows, in the small star its smaller ones. Both are a
minimum per vertex (combined before the shuffle) joined back to the edges, so
a vertex with very many edges is a skewed join, which Spark splits, and never a
collected group. Each round is staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, stage_table


def _signature(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst) of bigint vertices -> (id, component) for every
    vertex that has an edge to another one; component is the smallest vertex."""
    e = (edges.where(F.col("src") != F.col("dst"))
         .select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("m")).distinct())
    e = stage_table(spark, e, "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            e.select(F.col("m").alias("a"), F.col("v").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = (large.join(least, "v").where(F.col("m") != F.col("least"))
                 .select(F.col("m").alias("v"), F.col("least").alias("m"))
                 .unionAll(least.select("v", F.col("least").alias("m"))).distinct())
        before, e = e, stage_table(spark, small, "star")
        drop_staged(spark, before)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    # Every edge is now (vertex, smallest vertex); the smallest ones name themselves.
    roots = e.select(F.col("m").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("v").alias("id"), F.col("m").alias("component")).unionAll(roots)
