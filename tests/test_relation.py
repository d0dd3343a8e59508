"""Relations: golden inputs, the three kinds, joins, set operations and semiring laws."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import BOOL, COUNT, MIN, MINPLUS
from lattica.operators import Relation, merge_all, natural_join
from lattica.sources import graph


@pytest.fixture(scope="module")
def toy(spark):
    r = Relation.rows(spark, [("a", 1), ("a", 2), ("b", 1), ("b", 2)], "a string, b long")
    s = Relation.rows(spark, [(1, "one"), (1, "wun"), (2, "deux"), (2, "two")], "b long, c string")
    t = Relation.rows(spark, [("a", "one"), ("b", "deux"), ("mary", "mary")], "a string, c string")
    return r, s, t


def test_triangle_toy(toy):
    r, s, t = toy
    assert natural_join([r, s, t]).rename("a", "b", "c").drain() == [("a", 1, "one"), ("b", 2, "deux")]
    assert sorted(s.join(t).drain()) == [(1, "one", "a"), (2, "deux", "b")]
    assert r.join(s).count() == 8
    assert t.equal("a", "c").drain() == [("mary",)]


def test_annotations_multiply(toy):
    r, s, t = (x.map_value(F.lit(v).cast("long")) for x, v in zip(toy, (2, 3, 5), strict=True))
    assert [row[-1] for row in r.join(s).join(t).drain()] == [30, 30]


def test_annotated_toy(spark):
    r = Relation.rows(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2)], "a string, b long, v long", "map", "v")
    s = Relation.rows(spark, [(1, "one", 1), (1, "wun", 1), (2, "deux", 2), (2, "two", 2)], "b long, c string, v long", "map", "v")
    t = Relation.rows(spark, [("a", "one", 1), ("b", "deux", 2), ("mary", "mary", 3)], "a string, c string, v long", "map", "v")
    assert r.join(s).join(t).drain() == [("a", 1, "one", 1), ("b", 2, "deux", 8)]


def test_constant_lookup(spark, toy):
    r, s, _ = toy
    t = Relation.rows(spark, [("a", 17, "one"), ("b", 17, "deux"), ("mary", 23, "mary")], "a string, x long, c string")
    assert r.join(s).join(t.lookup("x", 17)).drain() == [("a", 1, "one"), ("b", 2, "deux")]


def test_kinds(spark):
    twice = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "B")], "x string, y string")
    assert Relation.as_bag(twice, "x", "y").drain() == [("a", "a", 2), ("b", "B", 1)]
    assert Relation.as_set(twice, "x", "y").drain() == [("a", "a"), ("b", "B")]
    bag = Relation.as_bag(twice, "x", "y")
    more = bag.insert(twice.limit(0)).insert(spark.createDataFrame([("b", "B")], "x string, y string"))
    assert more.drain() == [("a", "a", 2), ("b", "B", 2)]
    assert bag.remove(twice).drain() == []
    nulls = spark.createDataFrame([(None,), (1,)], "k long")
    assert Relation.as_set(nulls, "k").drain() == [(1,)]
    with pytest.raises(ValueError):
        Relation(twice, ("x",), "bag")


def test_keyed_maps(spark):
    x = Relation.rows(spark, [("alice", 2), ("bob", 1)], "k string, v long", "map", "v")
    y = Relation.rows(spark, [("bob", 10), ("charlie", 20)], "k string, v long", "map", "v")
    assert x.union(y).drain() == [("alice", 2), ("bob", 11), ("charlie", 20)]
    assert x.join(y).drain() == [("bob", 10)]
    assert merge_all([x, y, x], layers="n").df.where("k = 'bob'").first().asDict() == {"k": "bob", "v": 12, "n": 3}
    odd, even, ends = (Relation.rows(spark, [(i,) for i in r], "k long") for r in (range(1, 101, 2), range(0, 101, 2), (1, 100)))
    assert natural_join([odd, even, ends]).count() == 0


def test_outer_presence(spark):
    x = Relation.rows(spark, [(1, None), (2, 5)], "k long, v long", "map", "v", MIN)
    y = Relation.rows(spark, [(2, 7), (3, None)], "k long, v long", "map", "v", MIN)
    got = {tuple(r) for r in x.outer(y).collect()}
    assert got == {(1, None, None, True, False), (2, 5, 7, True, True), (3, None, None, False, True)}
    assert {r[0] for r in x.outer(y, "left").collect()} == {1, 2}
    assert {r[0] for r in x.outer(y, "right").collect()} == {2, 3}


def test_guarded_cross(spark):
    left = Relation.rows(spark, [("johnny",), ("ursula",)], "k1 string")
    right = Relation.rows(spark, [("bg",), ("kl",)], "k2 string")
    assert left.theta(right, F.col("k2") < F.col("k1")).drain() == [("johnny", "bg"), ("ursula", "bg"), ("ursula", "kl")]


def test_filters_reach_the_scan(spark, small):
    df = Relation.as_set(spark.read.parquet(f"{small}/lineitem.parquet"), "l_orderkey", "l_partkey").lookup("l_orderkey", 17).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,17)" in plan
    assert "l_quantity" not in plan


def test_graphs(spark, small):
    assert graph(spark, small, "edge").count() == 2752
    assert graph(spark, small, "step").count() > 1000


@given(st.integers(-9, 9), st.integers(-9, 9), st.integers(-9, 9))
def test_semiring_laws(a, b, c):
    for ring in (COUNT, MINPLUS, BOOL, MIN):
        if ring is BOOL:
            a, b, c = a > 0, b > 0, c > 0
        plus, times = ring.combine, ring.product
        assert plus(a, b) == plus(b, a)
        assert plus(a, plus(b, c)) == plus(plus(a, b), c)
        assert times(a, times(b, c)) == times(times(a, b), c)
        assert times(a, plus(b, c)) == plus(times(a, b), times(a, c))
        assert not ring.idempotent or plus(a, a) == a


def test_many_outer_joins(spark):
    from lattica.operators import outer_all

    parts = [Relation.rows(spark, [(k, v) for k in ks], f"k long, {n} long", "map", n) for ks, v, n in (((1, 2), 5, "x"), ((2, 3), 6, "y"), ((3,), 7, "z"))]
    assert sorted(map(tuple, outer_all(parts, default=0).select("k", "x", "y", "z").collect())) == [(1, 5, 0, 0), (2, 5, 6, 0), (3, 0, 6, 7)]
    assert {tuple(r) for r in outer_all(parts).select("k", "z").collect()} == {(1, None), (2, None), (3, 7)}
    with pytest.raises(ValueError):
        outer_all([parts[0], parts[0]])
