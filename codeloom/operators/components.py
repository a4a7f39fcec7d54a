"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, remove, scratch_scope


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node of its component.

    ``edges`` may be in any direction, repeated or loops; rows with nulls are
    ignored. Each round is two aggregates and joins, so a node with very many
    neighbours is pre-aggregated; rounds are about the
    logarithm of the longest path. Each round is written to the shared folder, and the one before it removed.
    Two numbers per round reach the driver.
    """
    u, v = F.col(a), F.col(b)
    pairs = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    spark = edges.sparkSession
    with scratch_scope(spark) as made:
        state, before = materialize(pairs, "components"), None
        while True:
            both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            state = materialize(small.select("e.*").where("u <> v").distinct(), "components")
            remove(spark, made.pop(0))  # the round before
            now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == before:
                made.clear()
                return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            before = now
