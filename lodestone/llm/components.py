"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exchange import scope, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node links its neighbours (large: those above it; small: those below it, and itself) to the least of them all."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = seen.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, component), the least node of each component. Nodes without edges do not come out.

    The edges stay on the executors; each round writes them to the shared folder, and ends when a round changes nothing.
    """
    spark, told = edges.sparkSession, [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    with scope(spark) as tables:
        now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        state = tuple(now.agg(*told).first())
        while True:
            now = written(_star(_star(now, True), False), "edges")
            tables.drop(spark, keep=[now])
            before, state = state, tuple(now.agg(*told).first())
            if before == state:
                break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
