"""Fixpoints against brute force, across strategies, and the layers below them."""

import random

import pytest

from lattica.operators.fixpoint import cheapest_paths, ranged_closure
from lattica.operators import FixpointLimit, Layers, Relation, closing_triangles, hypercube_triangles, labelled_reach, min_reachable, orient, transitive_closure, triangles


def closed(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def frame(spark, rows, names=("src", "dst")):
    return spark.createDataFrame(list(rows), f"{names[0]} long, {names[1]} long")


GOLDEN = [(1, 2), (2, 3), (3, 1), (3, 4)]


def test_golden(spark):
    got = {tuple(r) for r in transitive_closure(frame(spark, GOLDEN)).collect()}
    assert got == {(a, c) for a in (1, 2, 3) for c in (1, 2, 3, 4)}
    assert {tuple(r) for r in min_reachable(frame(spark, GOLDEN)).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {tuple(r) for r in labelled_reach(frame(spark, [(1, 2)], "ac"), frame(spark, [(2, 3), (3, 4)])).collect()} == {(1, 2), (1, 3), (1, 4)}


@pytest.mark.parametrize("strategy, minify", [("left", "eager"), ("left", "lazy"), ("left", "adaptive"), ("right", "eager"), ("reversed", "lazy"), ("doubling", "eager")])
def test_strategies(spark, strategy, minify):
    rng = random.Random(7)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)] + [(3, 3), (3, 3)]
    got = [tuple(r) for r in transitive_closure(frame(spark, edges), strategy, minify).collect()]
    assert len(got) == len(set(got))
    assert set(got) == closed(set(edges))


def test_min_reachable_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(15), rng.randrange(15)) for _ in range(20)]
    best = {}
    for a, c in closed(set(edges)):
        best[a] = min(best.get(a, c), c)
    assert {tuple(r) for r in min_reachable(frame(spark, edges)).collect()} == set(best.items())


def test_empty_and_limits(spark):
    assert transitive_closure(frame(spark, [])).count() == 0
    assert min_reachable(frame(spark, [])).count() == 0
    with pytest.raises(FixpointLimit):
        transitive_closure(frame(spark, [(i, i + 1) for i in range(6)]), max_rounds=2)


def test_layers(spark):
    layers = Layers(disjoint=False)
    for i in range(5):
        layers.push(Relation.rows(spark, [(i, 1), (0, 1)], "k long, v long", "map", "v"))
    assert layers.total().drain() == [(0, 6), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert len(layers.layers) < 5
    assert layers.compress().count() == 5


def test_triangles(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(40)}
    want = {(a, b, c) for a, b in edges for x, c in edges if x == b and (a, c) in edges}
    df = frame(spark, edges)
    assert {tuple(r) for r in triangles(df).collect()} == want
    assert {tuple(r) for r in hypercube_triangles(df, 3).collect()} == want
    flat = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    open_ = {(a, b, c) for a, b in flat for x, c in flat if x == b and (a, c) in flat}
    got = [tuple(r) for r in closing_triangles(orient(df)).collect()]
    assert set(got) == open_ and len(got) == len(open_)


def test_ranged_closure_and_cheapest_paths_with_cycles(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(14), rng.randrange(14)): rng.randrange(1, 9) for _ in range(30)}.items())
    costs = {k: v for k, v in rows}
    for m in range(14):
        for a in range(14):
            for c in range(14):
                if (a, m) in costs and (m, c) in costs:
                    costs[a, c] = min(costs.get((a, c), 10**9), costs[a, m] + costs[m, c])
    for _ in range(3):  # cycles through their own start
        for (a, b), v in list(costs.items()):
            for (b2, c), w in list(costs.items()):
                if b == b2:
                    costs[a, c] = min(costs.get((a, c), 10**9), v + w)
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in rows], "src long, dst long, cost long")
    assert {((r.a, r.c), r.cost) for r in cheapest_paths(edges).collect()} == set(costs.items())
    assert sorted((r.a, r.c) for r in ranged_closure(edges, parts=3).collect()) == sorted(costs)
    with pytest.raises(FixpointLimit):
        ranged_closure(edges, max_rounds=0)
