"""Connected components by alternating stars, all in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verstore.llm.common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id that some edge (a, b) names; component is the smallest id reachable.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours; minima form before the shuffle, so a node with many
    neighbours is one row per task.  Rounds grow with the logarithm of the
    longest path.  Edges with a null end and loops are left out.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pairs = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(pairs.distinct())
        last, sign = sign, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if last == sign:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
