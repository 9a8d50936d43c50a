"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import store


def _least(pairs: DataFrame) -> DataFrame:
    """u, m, top: the least of u and all its v, and the greatest v. Stored, so that a hub with very many neighbours
    meets its minimum in an ordinary skewed join, which Spark splits."""
    own = pairs.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("top"))
    return store(own.select("u", "low", F.least("u", "low").alias("m"), "top"), "cc-min")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of ``edges`` (u, v); component is the smallest node reachable.

    No edges give no rows. Loops are left out.
    """
    now = store(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        # Done when each node is a root, with greater neighbours only, or hangs on one root.
        settled = (F.col("low") > F.col("u")) | ((F.col("top") < F.col("u")) & (F.col("low") == F.col("top")))
        if low.where(~settled).isEmpty():
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.join(low.select("u", "m"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where(F.col("u") != F.col("v")).distinct(), "cc-large")
        small = large.join(_least(large).select("u", "m"), "u")
        now = small.select("u", F.col("m").alias("v")).unionByName(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = store(now.distinct(), "cc-small")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
