"""Connected components by alternating large-star and small-star rounds over durable edges.

Every round is two combining aggregates and two joins. Minima are written before they are joined, so
both sides of each join are plain exchanges, which adaptive execution can split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import by_shuffle
from lattica.session import checkpointed, free_shuffles


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


#: Links are far fewer than documents, so their frames have fewer parts.
FEWER = 8


def _star(sided: DataFrame, emit_if_above: bool) -> DataFrame:
    """For each u: its least neighbour m (itself included); its neighbours then point to m."""
    least = checkpointed(sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), FEWER)
    joined = sided.join(by_shuffle(least), "u")
    if emit_if_above:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    pointed = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the least node reachable. Loops are ignored."""
    edges = checkpointed(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), FEWER)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_star(both, True), FEWER)
        edges = checkpointed(_star(large, False), FEWER)
        now = _state(edges)
        del both, large
        free_shuffles(links.sparkSession)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
