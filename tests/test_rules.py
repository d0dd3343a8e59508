"""Parser, planner and evaluation of rules."""

import pytest
from pyspark.sql import functions as F

from lattica.plans import Engine, UnsafeQuery, explain, parse_program, parse_query, parse_rule, plan, subsequence, variable_order


def steps(query, order):
    sorts, found = plan(parse_query(query), order)
    return len(sorts), [str(s) for s in found]


def test_plans():
    n, got = steps("r(a, b), s(b, c), t(a, 17, c)", ["a", "b", "c"])
    assert n == 0 and got == ["a <- r,t", "lookup t 17", "b <- r,s", "c <- s,t"]
    n, got = steps("r(a, b), s(b, c), t(c, 17, a)", ["a", "b", "c"])
    assert n == 1 and got == ["a <- r,t'", "b <- r,s", "c <- s,t'"]
    n, got = steps("r(a, b), s(b, b), t(a, 17, c)", ["a", "b", "c"])
    assert got == ["a <- r,t", "lookup t 17", "b <- r,s", "lookup s b", "c <- t"]
    assert variable_order(parse_query("r(a, b), s(b, c), t(a, c)")) == ["a", "b", "c"]
    assert subsequence("ac", "abc") == [0, 2]
    assert subsequence("ca", "abc") is None


def test_text_round_trip():
    text = 'relation e(long, long).\np(a, c) <- e(a, b), not q(b), e(b, c), a < 5.\nq(x) <- e(x, "k").'
    program = parse_program(text)
    assert str(program) == text
    assert "a <-" in explain(parse_rule("t(a) <- e(a, b), e(b, a)"))
    with pytest.raises(SyntaxError):
        parse_rule("t(a <- e(a)")


@pytest.fixture(scope="module")
def engine(spark):
    ab = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "x string, y long")
    bc = spark.createDataFrame([(1, "one"), (1, "wun"), (2, "deux"), (2, "two")], "x long, y string")
    ac = spark.createDataFrame([("a", "one"), ("b", "deux"), ("mary", "mary")], "x string, y string")
    return Engine(spark, {"foo": ab, "bar": bc, "baz": ac}, {"double": lambda x: x * 2, "half": lambda x: F.when(x % 2 == 0, (x / 2).cast("long"))})


def test_conjunctions(engine):
    assert engine.query("foo(a, b), bar(b, c)").count() == 8
    assert sorted(map(tuple, engine.query("foo(a, b), bar(b, c), baz(a, c)").collect())) == [("a", 1, "one"), ("b", 2, "deux")]
    assert [tuple(r) for r in engine.query("baz(x, x)").collect()] == [("mary",)]
    assert [tuple(r) for r in engine.query('foo("a", b), b > 1').collect()] == [(2,)]
    assert engine.query('foo("a", 2)').columns == ["holds"]
    assert engine.query('foo("z", 2)').count() == 0
    assert engine.query("foo(a, b), foo(a, b)").count() == 4


def test_functions(engine):
    assert sorted(map(tuple, engine.query("foo(a, b), double(b, d)").collect())) == [("a", 1, 2), ("a", 2, 4), ("b", 1, 2), ("b", 2, 4)]
    assert sorted(map(tuple, engine.query("foo(a, b), half(b, d)").collect())) == [("a", 2, 1), ("b", 2, 1)]
    with pytest.raises(UnsafeQuery):
        engine.query("foo(a, b), double(z, d)")


def test_safety_and_arity(engine):
    with pytest.raises(UnsafeQuery):
        engine.rule("h(z) <- foo(a, b)")
    with pytest.raises(UnsafeQuery):
        engine.rule("h(a) <- foo(a, b), not bar(q, a)")
    with pytest.raises(ValueError):
        engine.query("foo(a)")


def test_programs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    out = Engine(spark, {"e": e}).run("""
        path(a, b) <- e(a, b).
        path(a, c) <- path(a, b), path(b, c).
        node(a) <- e(a, b).
        node(b) <- e(a, b).
        apart(a, b) <- node(a), node(b), not path(a, b).
    """)
    assert out["path"].count() == 12
    assert sorted(map(tuple, out["apart"].collect())) == [(4, 1), (4, 2), (4, 3), (4, 4)]
    mutual = Engine(spark, {"e": e}).run("odd(a, b) <- e(a, b). odd(a, c) <- even(a, b), e(b, c). even(a, c) <- odd(a, b), e(b, c).")
    assert (1, 4) in {tuple(r) for r in mutual["odd"].collect()}
    assert (1, 3) in {tuple(r) for r in mutual["even"].collect()}
    with pytest.raises(ValueError):
        Engine(spark, {"e": e}).run("p(a) <- e(a, b), not q(a). q(a) <- e(a, b), not p(a).")
