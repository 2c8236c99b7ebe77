"""Connected components of a graph by alternating large-star and small-star steps.

Every step is an aggregation and a join on the node, so no neighbourhood is gathered in one task: the smallest neighbour
comes from an aggregation with map-side combine. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), both long -> node, root: the smallest node of its component, for every node but the roots themselves."""
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = written(both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low")), "low")  # AQE can then split a hub's rows
        large = both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct("node", F.col("low").alias("root")))).alias("e"))
        stars = written(small.select("e.*").where("node <> root").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return stars
        before = now
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
