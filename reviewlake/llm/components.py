"""Connected components by large-star and small-star rounds; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for all nodes of the edges (u, v), of any order."""
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), name)
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if sums == seen or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = sums
        now = materialize(_small_star(_large_star(now)).where("u <> v").distinct(), name)
