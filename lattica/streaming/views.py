"""Incremental maintenance of the two-edge path view over a growing bag of edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.layers import Layers
from lattica.operators.relation import Relation
from lattica.session import checkpointed

#: Fixed value: the multiplier that picks the edge of a rewrite, modulo 2**64.
PICK = 11400714819323198485


def counted(edges: DataFrame) -> DataFrame:
    """A bag as distinct edges with their multiplicity ``n``."""
    if "n" in edges.columns:
        return edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def paths(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b, c, n): n ways to take an edge a→b of ``left`` and then b→c of ``right``."""
    x = left.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("x"))
    y = (left if right is None else right).select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("n").alias("y"))
    return x.join(y, "b").select("a", "b", "c", (F.col("x") * F.col("y")).alias("n"))


def delta_paths(old: DataFrame, delta: DataFrame) -> DataFrame:
    """What ``delta`` adds to the view of ``old``: Δ⋈E, E⋈Δ and Δ⋈Δ, as counted tuples.

    The old edges enter each join once; Δ is small and broadcast by its own size when it can be.
    """
    return paths(delta, old).unionByName(paths(old, delta)).unionByName(paths(delta))


def delta_by_cases(old: DataFrame, detours: DataFrame) -> DataFrame:
    """What detours a→b→c (a, b, c; b is new to the graph) add to the view of ``old``, case by case.

    A new path goes x→a→b, a→b→c or b→c→y, or joins two detours where one ends and another starts: no
    other pair of edges can meet, as b has no other edge.
    """
    d = detours.select("a", "b", "c")
    into = old.select(F.col("src").alias("x"), F.col("dst").alias("a"), "n").join(d, "a").select(F.col("x").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"), "n")
    through = d.withColumn("n", F.lit(1).cast("long"))
    onward = old.select(F.col("src").alias("c"), F.col("dst").alias("y"), "n").join(d, "c").select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("y").alias("c"), "n")
    chained = d.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("w")).join(d, F.col("w") == F.col("a")).select(F.col("v").alias("p"), F.col("w").alias("q"), F.col("b").alias("r")).toDF("a", "b", "c").withColumn("n", F.lit(1).cast("long"))
    return into.unionByName(through).unionByName(onward).unionByName(chained).groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def rewrites(edges: list[tuple[int, int]], steps: int, fresh: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """The two edges that each of ``steps`` rewrites adds: an edge (a, c) gets a detour a→b→c.

    Step i picks edge number i·PICK mod 2**64 mod |edges|; b is the next unused vertex. Plain integer
    arithmetic on the driver: picks depend on the number of edges alone.
    """
    known = list(edges)
    b = max((max(e) for e in known), default=-1) + 1 if fresh is None else fresh
    for i in range(steps):
        a, c = known[(i * PICK % (1 << 64)) % len(known)]
        added = [(a, b), (b, c)]
        known += added
        b += 1
        yield added


@dataclass
class PathView:
    """The view and its edges in durable layers, maintained batch by batch."""

    spark: SparkSession
    edges: Layers = field(default_factory=lambda: Layers(disjoint=False))
    view: Layers = field(default_factory=lambda: Layers(disjoint=False))
    #: Number of the last micro-batch that was applied.
    last: int = -1

    def apply(self, delta: DataFrame) -> DataFrame:
        """Add a batch of edges (src, dst); returns the added paths."""
        batch = Relation(checkpointed(counted(delta)), ("src", "dst"), "bag", "n")
        added = delta_paths(self.edges.total().df, batch.df) if self.edges.layers else paths(batch.df)
        out = Relation(checkpointed(added.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))), ("a", "b", "c"), "bag", "n")
        self.edges.push(batch)
        self.view.push(out)
        return out.df

    def apply_batch(self, delta: DataFrame, number: int) -> None:
        """Apply a micro-batch once: a batch that is delivered again after a failure is passed over."""
        if number > self.last:
            self.apply(delta)
            self.last = number

    def current(self) -> DataFrame:
        return self.view.total().df if self.view.layers else self.spark.createDataFrame([], "a long, b long, c long, n long")

    def recomputed(self) -> DataFrame:
        return paths(self.edges.total().df)

    def expected_total(self) -> int:
        """Σ in(v)·out(v) over the present edges, the size of the view by definition."""
        e = self.edges.total().df
        into = e.groupBy(F.col("dst").alias("v")).agg(F.sum("n").alias("i"))
        out = e.groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("o"))
        return into.join(out, "v").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0]


def maintain_stream(stream: DataFrame, view: PathView, checkpoint: str):
    """Extension: feed a streaming frame of edges (src, dst) to the view, one micro-batch at a time."""
    return stream.writeStream.foreachBatch(lambda batch, number: view.apply_batch(batch.select("src", "dst"), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
