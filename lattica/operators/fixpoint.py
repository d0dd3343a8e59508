"""Semi-naive evaluation on the driver; every round is one distributed job over durable deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.semiring import MIN, MINPLUS
from lattica.operators.layers import Layers
from lattica.operators.relation import Relation
from lattica.session import checkpointed

POLICIES = ("eager", "lazy", "adaptive")


class FixpointLimit(RuntimeError):
    """The given number of rounds did not reach a fixpoint; nothing is silently cut off."""


def _durable(relation: Relation) -> tuple[Relation, int]:
    out = relation._with(checkpointed(relation.df))
    return out, out.count()


def semi_naive(seed: Relation, step: Callable[[Relation], Relation], minify: str = "eager", threshold: int | None = None, max_rounds: int | None = None) -> Relation:
    """The least fixpoint of ``seed ∪ step(x)`` for a ``step`` that is linear in its argument.

    eager: known tuples leave each delta before it is stored. lazy: they leave when the delta is
    about to be joined, and one final distinct removes what was stored twice. adaptive: small deltas
    skip the antijoin until their sizes add up to ``threshold`` (None: the size of the seed). All give the same relation, but only
    eager deltas hold new tuples alone. Without an antijoin the threshold falls by the delta's size, so
    the next antijoin, and with it the end, is certain.
    """
    if minify not in POLICIES:
        raise ValueError(f"minify is one of {POLICIES}")
    delta, size = _durable(Relation.as_set(seed.df, *seed.keys))
    total, rounds, left = Layers(), 0, size if threshold is None else threshold
    known: Relation | None = None
    while size:
        if max_rounds is not None and rounds >= max_rounds:
            raise FixpointLimit(f"no fixpoint after {rounds} rounds")
        if minify == "lazy" and known is not None:
            delta, size = _durable(delta.antijoin(known))
            if not size:
                break
        total.push(delta, size)
        known = total.total()
        found = Relation.as_set(step(delta).df, *seed.keys)
        if minify == "eager" or minify == "adaptive" and size >= left:
            delta, size = _durable(found.antijoin(known))
            left = max(size, 1)
        else:
            delta, size = _durable(found)
            left -= size
        rounds += 1
    out = total.total() if total.layers else seed.empty()
    return out if minify == "eager" else Relation.as_set(out.df, *seed.keys)


def transitive_closure(edges: DataFrame, strategy: str = "left", minify: str = "eager", max_rounds: int | None = None) -> DataFrame:
    """All (a, c) with a path from a to c over ``edges`` (src, dst).

    left: new pairs are extended at their end. right: at their start. reversed: the closure is kept
    as (c, a). doubling: new pairs meet new and old ones, so rounds grow with the logarithm of the
    longest path in place of its length.
    """
    e = Relation.as_set(edges.select("src", "dst"), "src", "dst")
    e = e._with(checkpointed(e.df))
    if strategy == "left":
        step = e.rename("b", "c")
        return semi_naive(e.rename("a", "c"), lambda d: d.rename("a", "b").join(step), minify, max_rounds=max_rounds).df
    if strategy == "right":
        step = e.rename("a", "b")
        return semi_naive(e.rename("a", "c"), lambda d: d.rename("b", "c").join(step).project("a", "c"), minify, max_rounds=max_rounds).df
    if strategy == "reversed":
        step = e.rename("b", "c")
        return semi_naive(e.rename("a", "c").reverse(), lambda d: d.rename("b", "a").join(step).project("c", "a"), minify, max_rounds=max_rounds).df.select("a", "c")
    if strategy != "doubling":
        raise ValueError(f"unknown strategy {strategy!r}")
    total, rounds = Layers(), 0
    delta, size = _durable(e.rename("a", "c"))
    while size:
        if max_rounds is not None and rounds >= max_rounds:
            raise FixpointLimit(f"no fixpoint after {rounds} rounds")
        total.push(delta, size)
        known = total.total()
        ahead = delta.rename("a", "b").join(known.rename("b", "c")).df.select("a", "c")
        behind = known.rename("a", "b").join(delta.rename("b", "c")).df.select("a", "c")
        delta, size = _durable(Relation.as_set(ahead.unionByName(behind), "a", "c").antijoin(known))
        rounds += 1
    return total.total().df if total.layers else e.rename("a", "c").df


def labelled_reach(seed: DataFrame, edges: DataFrame, minify: str = "eager", max_rounds: int | None = None) -> DataFrame:
    """n(a, c) from n(a, b) and e(b, c), starting from ``seed`` (a, c) over ``edges`` (src, dst)."""
    e = Relation.as_set(edges.select("src", "dst"), "src", "dst").rename("b", "c")
    e = e._with(checkpointed(e.df))
    return semi_naive(Relation.as_set(seed.select("a", "c"), "a", "c"), lambda d: d.rename("a", "b").join(e).project("a", "c"), minify, max_rounds=max_rounds).df


def _improved(start: Relation, send: Callable[[Relation], Relation], max_rounds: int | None) -> DataFrame:
    """The least values that ``start`` and what ``send`` makes of improved ones reach.

    Improved values are layers, so a round writes what became smaller only; a key's value is the least of
    its layers.
    """
    total, rounds = Layers(disjoint=False), 0
    delta, size = _durable(start)
    while size:
        if max_rounds is not None and rounds >= max_rounds:
            raise FixpointLimit(f"no fixpoint after {rounds} rounds")
        total.push(delta, size)
        delta, size = _durable(send(delta).improving(total.total()))
        rounds += 1
    return total.total().df if total.layers else start.df


def min_reachable(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(v, m): the smallest vertex that a path of at least one edge leads to from v; sinks are absent.

    A round sends only values that became strictly smaller, so cycles end.
    """
    e = Relation.as_set(edges.select("src", "dst"), "src", "dst")
    e = e._with(checkpointed(e.df))
    back = e.df.select(F.col("dst").alias("w"), F.col("src").alias("v"))

    def send(delta: Relation) -> Relation:
        return Relation.as_map(delta.df.select(F.col("v").alias("w"), "m").join(back, "w").select("v", "m"), ["v"], "m", MIN)

    return _improved(Relation.as_map(e.df.select(F.col("src").alias("v"), F.col("dst").alias("m")), ["v"], "m", MIN), send, max_rounds)


def cheapest_paths(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(a, c, cost): the least sum of costs of a path from a to c over ``edges`` (src, dst, cost >= 0)."""
    step = Relation.as_map(edges.select("src", "dst", "cost"), ["src", "dst"], "cost", MINPLUS)
    step = step._with(checkpointed(step.df))

    def send(delta: Relation) -> Relation:
        return delta.rename("a", "b").join(step.rename("b", "c"), value="cost").project("a", "c")

    return _improved(step.rename("a", "c"), send, max_rounds)


def ranged_closure(edges: DataFrame, parts: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """The closure with each delta dealt to ranges of its first vertex, by which pairs stay dealt.

    New pairs keep the first vertex of the pair that they extend, so a pair that is derived twice is
    derived within one range: what is known need not move, only the edges do.
    """
    spark = edges.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = Relation.as_set(edges.select("src", "dst"), "src", "dst")
    e = e._with(checkpointed(e.df))
    step = e.rename("b", "c").df
    delta = checkpointed(e.rename("a", "c").df.repartitionByRange(parts, "a").sortWithinPartitions("a", "c"))
    known, rounds = delta, 0
    while not delta.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise FixpointLimit(f"no fixpoint after {rounds} rounds")
        found = delta.withColumnRenamed("c", "b").join(step, "b").select("a", "c").distinct()
        delta = checkpointed(found.join(known, ["a", "c"], "left_anti").repartitionByRange(parts, "a").sortWithinPartitions("a", "c"))
        known = known.unionByName(delta)
        rounds += 1
    return known
