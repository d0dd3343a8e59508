"""Queries over the star-schema tables with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.semiring import MIN, MINPLUS
from lattica.operators.fixpoint import cheapest_paths, labelled_reach, min_reachable, ranged_closure, transitive_closure
from lattica.operators.multiway import binary_triangles, closing_triangles, counted_triangles, hypercube_triangles, orient, symmetric, triangles
from lattica.operators.relation import Relation, merge_all, natural_join, outer_all
from lattica.plans.compile import Engine
from lattica.plans.language import parse_query, parse_rule
from lattica.plans.planner import explain, planned_order
from lattica.session import checkpointed, shared_dir
from lattica.sources.edges import edge_list, labelled_edges, weighted_edges
from lattica.sources.tables import graph, steps, successions, table
from lattica.streaming.views import PathView, counted, delta_by_cases, delta_paths, paths, rewrites

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions by name, with the ones that each needs.
_CTES = {
    "raw": ((), "raw as (select a.l_partkey as src, b.l_partkey as dst, a.l_quantity as q from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"),
    "edge": (("raw",), "edge as (select distinct src, dst from raw)"),
    "w": (("raw",), "w as (select src, dst, count(*)::bigint as n from raw group by 1, 2)"),
    "u": (("edge",), "u as (select distinct least(src, dst) as a, greatest(src, dst) as b from edge where src <> dst)"),
    "step": ((), "step as (select distinct a.l_orderkey * 8 + a.l_linenumber as src, b.l_orderkey * 8 + b.l_linenumber as dst, a.l_quantity::bigint as cost from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"),
    "tr": (("step",), "tr as (select src, dst from step union select tr.src, e.dst from tr join step e on tr.dst = e.src)"),
    "seed": ((), "seed as (select distinct o_custkey as a, o_orderkey * 8 + 1 as c from orders)"),
    "reach": (("step", "seed"), "reach as (select a, c from seed union select n.a, e.dst from reach n join step e on n.c = e.src)"),
    "loop": (("edge",), "loop as (select src as k from edge where src = dst)"),
}


def with_ctes(sql: str, *names: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for n in _CTES[name][0]:
            add(n)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return f"with recursive {', '.join(_CTES[n][1] for n in needed)} {sql}" if needed else sql


def query(sql: str, *ctes: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, or ``name``, with SQL over the tables and ``ctes``."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = with_ctes(sql, *ctes)
        return f

    return register


def _edge(spark: SparkSession, d: str) -> Relation:
    return Relation.as_set(graph(spark, d, "edge"), "src", "dst", unique=True)


def _loops(spark: SparkSession, d: str) -> Relation:
    return _edge(spark, d).equal("src", "dst").rename("k")


def _w(spark: SparkSession, d: str) -> Relation:
    return Relation(graph(spark, d, "w"), ("src", "dst"), "bag", "n")


def _parts(spark: SparkSession, d: str) -> Relation:
    return Relation.as_set(table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k", unique=True)


# -- leaves and access paths ------------------------------------------------------------------


@query("select src, dst from edge", "edge")
def edge_set(spark, d):
    return _edge(spark, d).df


@query("select src, dst, n from w", "w")
def edge_bag(spark, d):
    return _w(spark, d).df


@query("select dst as src, src as dst from edge", "edge")
def reverse_index(spark, d):
    return _edge(spark, d).reverse().rename("src", "dst").df


@query("select src, list_aggregate(list_sort(list(dst)), 'string_agg', ',') as reached from edge group by 1", "edge")
def nested_groups(spark, d):
    nested = _edge(spark, d).nested(1)
    return nested.select("src", F.array_join(F.transform("items", lambda x: x["dst"].cast("string")), ",").alias("reached"))


# -- selections, projections, computed columns ------------------------------------------------


@query("select dst from edge where src = 17", "edge")
def const_lookup(spark, d):
    return _edge(spark, d).lookup("src", 17).df


@query("select src as x from edge where src = dst", "edge")
def repeated_var(spark, d):
    return _edge(spark, d).equal("src", "dst").rename("x").df


@query("select src, dst from edge where src >= 10 and src < 20 and dst > src", "edge")
def in_range(spark, d):
    return _edge(spark, d).in_range("src", 10, 20).where(F.col("dst") > F.col("src")).df


@query("select src, dst, dst - src as gap from edge where dst > src", "edge")
def filter_map(spark, d):
    return _edge(spark, d).filter_map(F.when(F.col("dst") > F.col("src"), F.col("dst") - F.col("src")), "gap").df


@query("select src, dst, (src + dst) // 2 as m from edge where (src + dst) % 2 = 0", "edge")
def function_join(spark, d):
    return _edge(spark, d).extend("m", F.when((F.col("src") + F.col("dst")) % 2 == 0, F.expr("(src + dst) div 2")), partial=True).df


@query("select x.r_name as k1, y.r_name as k2 from region x, region y where y.r_name < x.r_name")
def guard_cross(spark, d):
    names = Relation.as_set(table(spark, d, "region"), "r_name")
    return names.rename("k1").theta(names.rename("k2"), F.col("k2") < F.col("k1")).df


@query("select x.s_suppkey as x, y.s_suppkey as y from supplier x join supplier y on x.s_suppkey <= y.s_suppkey")
def theta_le(spark, d):
    keys = Relation.as_set(table(spark, d, "supplier"), "s_suppkey", unique=True)
    return keys.rename("x").theta(keys.rename("y"), F.col("x") <= F.col("y")).df


@query("select x.s_suppkey as x, x.s_suppkey as y from supplier x")
def eq_rel(spark, d):
    return Relation.as_set(table(spark, d, "supplier"), "s_suppkey", unique=True).rename("x").extend("y", F.col("x")).df


@query("select distinct x.src as a, y.dst as c from edge x join edge y on x.dst = y.src", "edge")
def project_middle(spark, d):
    e = _edge(spark, d)
    return e.rename("a", "b").join(e.rename("b", "c")).project("a", "c").df


@query("select src, sum(n)::bigint as n from w group by 1", "w")
def project_trailing(spark, d):
    return _w(spark, d).project("src").df


# -- joins ------------------------------------------------------------------------------------


@query("select x.dst as mid, count(*)::bigint as n from edge x join edge y on x.dst = y.src group by 1", "edge")
def wedge_by_mid(spark, d):
    # Both factors are summed per vertex first, so no wedge is ever a row.
    e = graph(spark, d, "edge")
    into = Relation.as_bag(e.select(F.col("dst").alias("mid")), "mid")
    return into.join(Relation.as_bag(e.select(F.col("src").alias("mid")), "mid")).df


@query("select x.src as a, x.dst as b, y.dst as c from edge x join edge y on y.src = x.dst join edge z on z.src = x.src and z.dst = y.dst", "edge")
def triangle_directed(spark, d):
    return triangles(graph(spark, d, "edge"))


@query("select x.src as a, x.dst as b, y.dst as c from edge x join edge y on y.src = x.dst join edge z on z.src = x.src and z.dst = y.dst", "edge")
def triangle_hypercube(spark, d):
    return hypercube_triangles(graph(spark, d, "edge"))


_UNDIRECTED = "from u x join u y on y.a = x.b join u z on z.a = x.a and z.b = y.b"


@query(f"select x.a as a, x.b as b, y.b as c {_UNDIRECTED}", "u")
def triangle_undirected(spark, d):
    return closing_triangles(graph(spark, d, "u"))


@query(f"select count(*)::bigint as n {_UNDIRECTED}", "u")
def triangle_count(spark, d):
    return closing_triangles(graph(spark, d, "u")).agg(F.count(F.lit(1)).alias("n"))


@query("select r.src as a, r.dst as b, s.dst as c, (r.n * s.n * t.n)::bigint as mult from w r join w s on s.src = r.dst join w t on t.src = r.src and t.dst = s.dst", "w")
def triangle_bag(spark, d):
    return counted_triangles(graph(spark, d, "w"))


_DIRECTED = "select x.src as a, x.dst as b, y.dst as c from edge x join edge y on y.src = x.dst join edge z on z.src = x.src and z.dst = y.dst"


@query(_DIRECTED, "edge")
def triangle_binary_b(spark, d):
    return binary_triangles(graph(spark, d, "edge"), "b")


@query(_DIRECTED, "edge")
def triangle_binary_a(spark, d):
    return binary_triangles(graph(spark, d, "edge"), "a")


@query(_DIRECTED, "edge")
def triangle_binary_c(spark, d):
    return binary_triangles(graph(spark, d, "edge"), "c")


@query("select a, b from u", "u")
def oriented(spark, d):
    return orient(graph(spark, d, "edge"))


@query("select k, x.n * y.n * z.n as n from (select src k, count(*)::bigint n from edge group by 1) x join (select dst k, count(*)::bigint n from edge group by 1) y using (k) join (select l_partkey k, count(*)::bigint n from lineitem group by 1) z using (k)", "edge")
def inner_nway(spark, d):
    e = graph(spark, d, "edge")
    ends = [e.select(F.col("src").alias("k")), e.select(F.col("dst").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))]
    return natural_join([Relation.as_bag(x, "k") for x in ends]).df.select("k", "n")


@query("select coalesce(x.k, y.k) as k, coalesce(x.n, 0) as ln, coalesce(y.n, 0) as rn, x.k is not null as has_l, y.k is not null as has_r from (select src k, count(*)::bigint n from edge group by 1) x full join (select dst k, count(*)::bigint n from edge group by 1) y on x.k = y.k", "edge")
def full_outer(spark, d):
    e = graph(spark, d, "edge")
    left = Relation.as_bag(e.select(F.col("src").alias("k")), "k")
    right = Relation.as_bag(e.select(F.col("dst").alias("k")), "k")
    return left.outer(right, "full", "ln", "rn", default=0)


@query("select k, coalesce(max(n) filter (where s = 0), 0)::bigint as n0, coalesce(max(n) filter (where s = 1), 0)::bigint as n1, coalesce(max(n) filter (where s = 2), 0)::bigint as n2 from (select src k, dst % 3 as s, count(*) n from edge group by all) group by 1", "edge")
def outer_nway(spark, d):
    e = graph(spark, d, "edge")
    return outer_all([Relation.as_bag(e.where(F.col("dst") % 3 == i).select(F.col("src").alias("k")), "k", count=f"n{i}") for i in range(3)], default=0)


@query("select p_partkey as k, e.dst as dst from part left join edge e on p_partkey = e.src", "edge")
def left_outer(spark, d):
    return _parts(spark, d).outer(_edge(spark, d).rename("k", "dst"), "left").select("k", "dst")


@query("select e.src as src, p_partkey as k from edge e right join part on p_partkey = e.dst", "edge")
def right_outer(spark, d):
    return _edge(spark, d).rename("src", "k").outer(_parts(spark, d), "right").select("src", "k")


@query("select p_partkey as k from part where not exists (select 1 from loop where k = p_partkey)", "loop")
def antijoin(spark, d):
    return _parts(spark, d).antijoin(_loops(spark, d)).df


@query("select p_partkey as k from part where exists (select 1 from loop where k = p_partkey)", "loop")
def semijoin(spark, d):
    return _parts(spark, d).semijoin(_loops(spark, d)).df


@query("select w.src, w.dst, w.n from w left join (select dst as src, src as dst, n from w) o using (src, dst) where o.n is null or w.n < o.n", "w")
def improving(spark, d):
    w = _w(spark, d)
    return w.improving(w.reverse().rename("src", "dst")).df


# -- set operations and aggregates ------------------------------------------------------------


@query("select src, dst from edge union select dst, src from edge", "edge")
def union_symmetric(spark, d):
    return symmetric(graph(spark, d, "edge"))


@query("select a, b from (select src as a, dst as b from edge where src < dst union select dst as a, src as b from edge where dst < src)", "edge")
def union_set(spark, d):
    e = _edge(spark, d).rename("a", "b")
    return e.where(F.col("a") < F.col("b")).union(e.where(F.col("b") < F.col("a")).reverse().rename("a", "b")).df


@query("select k, sum(n)::bigint as n from (select src k, count(*) n from edge group by 1 union all select dst k, count(*) n from edge group by 1) group by 1", "edge")
def union_sum(spark, d):
    e = graph(spark, d, "edge")
    return Relation.as_bag(e.select(F.col("src").alias("k")), "k").union(Relation.as_bag(e.select(F.col("dst").alias("k")), "k")).df


@query("select k, sum(n)::bigint as n, count(*)::bigint as layers from (select src k, count(*) n from edge where dst % 3 = 0 group by 1 union all select src k, count(*) n from edge where dst % 3 = 1 group by 1 union all select src k, count(*) n from edge where dst % 3 = 2 group by 1) group by 1", "edge")
def union_nway(spark, d):
    e = graph(spark, d, "edge")
    return merge_all([Relation.as_bag(e.where(F.col("dst") % 3 == i).select(F.col("src").alias("k")), "k") for i in range(3)], layers="layers").df


@query("select src, dst from edge intersect select dst, src from edge", "edge")
def intersect_set(spark, d):
    e = _edge(spark, d)
    return e.intersect(e.reverse()).df


@query("select src, dst from edge except select dst, src from edge", "edge")
def difference_set(spark, d):
    e = _edge(spark, d)
    return e.difference(e.reverse()).df


@query("select src, min(dst) as m from edge group by 1", "edge")
def min_agg(spark, d):
    return Relation.as_map(graph(spark, d, "edge").select("src", F.col("dst").alias("m")), ["src"], "m", MIN).df


@query("select a.src as a, b.dst as c, min(a.q + b.q) as cost from (select src, dst, min(q) q from raw group by all) a join (select src, dst, min(q) q from raw group by all) b on a.dst = b.src group by all", "raw")
def min_plus(spark, d):
    cost = Relation.as_map(successions(spark, d), ["src", "dst"], "q", MINPLUS)
    return cost.rename("a", "b").join(cost.rename("b", "c"), value="cost").project("a", "c").df


@query("select src, dst, (n * 3)::bigint as n from w", "w")
def scale(spark, d):
    return _w(spark, d).scale(3).df


@query("select x.src, x.dst, x.n - 1 as n from w x where x.n > 1", "w")
def bag_remove(spark, d):
    w = _w(spark, d)
    return w.remove(graph(spark, d, "edge")).df


# -- rules ------------------------------------------------------------------------------------


@query("select y.b as y from u x join u y on x.b = y.a where x.a = 1", "u")
def datalog_const_dup(spark, d):
    # One row for each binding of x and y, as SQL counts them.
    return Engine(spark, {"u": graph(spark, d, "u")}).query("u(1, x), u(x, y)", ["x", "y"]).select("y")


@query("select distinct x.a as a, z.b as c from u x join u z on x.b = z.a where not exists (select 1 from u where u.a = x.a and u.b = z.b)", "u")
def datalog_negation(spark, d):
    out = Engine(spark, {"u": graph(spark, d, "u")}).rule("open(a, c) <- u(a, b), u(b, c), not u(a, c)")
    return out.toDF("a", "c")


@query("select distinct x.a as a, y.b as c, x.a + y.b as t from u x join u y on x.b = y.a where (x.a + y.b) % 2 = 0", "u")
def datalog_function(spark, d):
    even_sum = lambda x, y: F.when((x + y) % 2 == 0, x + y)  # noqa: E731  undefined for odd sums
    out = Engine(spark, {"u": graph(spark, d, "u")}, {"even_sum": even_sum}).rule("h(a, c, t) <- u(a, b), u(b, c), even_sum(a, c, t)")
    return out.toDF("a", "c", "t")


@query("select distinct a.l_partkey as src from lineitem a join orders on a.l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_nationkey = 7")
def datalog_star(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    stored = {"line": line, "placed": table(spark, d, "orders").select("o_orderkey", "o_custkey"), "lives": table(spark, d, "customer").select("c_custkey", "c_nationkey")}
    return Engine(spark, stored).rule("h(p) <- line(o, p), placed(o, c), lives(c, 7)").toDF("src")


@query("select src as a, dst as b, 'odd' as parity from (select distinct src, dst, k % 2 as p from (with recursive walk(src, dst, k) as (select src, dst, 1 from step union select w.src, e.dst, 1 + (w.k % 2) from walk w join step e on w.dst = e.src) select * from walk)) where p = 1", "step")
def datalog_mutual(spark, d):
    out = Engine(spark, {"e": graph(spark, d, "step")}).run("odd(a, b) <- e(a, b). odd(a, c) <- even(a, b), e(b, c). even(a, c) <- odd(a, b), e(b, c).")
    return out["odd"].toDF("a", "b").withColumn("parity", F.lit("odd"))


@query("select src as a, dst as c from tr", "tr")
def datalog_program(spark, d):
    out = Engine(spark, {"edge": graph(spark, d, "step")}).run("relation path(long, long). path(a, b) <- edge(a, b). path(a, c) <- path(a, b), edge(b, c).")
    return out["path"].toDF("a", "c")


_TR = "select src as a, dst as c from tr"


@query(_TR, "tr")
def closure(spark, d):
    return transitive_closure(graph(spark, d, "step"))


@query(_TR, "tr")
def closure_lazy(spark, d):
    return transitive_closure(graph(spark, d, "step"), minify="lazy")


@query(_TR, "tr")
def closure_adaptive(spark, d):
    return transitive_closure(graph(spark, d, "step"), minify="adaptive")


@query(_TR, "tr")
def closure_right(spark, d):
    return transitive_closure(graph(spark, d, "step"), "right")


@query(_TR, "tr")
def closure_reversed(spark, d):
    return transitive_closure(graph(spark, d, "step"), "reversed")


@query(_TR, "tr")
def closure_doubling(spark, d):
    return transitive_closure(graph(spark, d, "step"), "doubling")


@query("select a, c from reach", "reach", name="labelled_reach")
def labelled_reach_query(spark, d):
    return labelled_reach(graph(spark, d, "seed"), graph(spark, d, "step"))


@query("select a, c from reach", "reach")
def labelled_reach_adaptive(spark, d):
    return labelled_reach(graph(spark, d, "seed"), graph(spark, d, "step"), "adaptive")


@query(_TR, "tr")
def closure_ranged(spark, d):
    return ranged_closure(graph(spark, d, "step"))


@query("select dst as v, min(src) as m from tr group by 1", "tr", name="min_reachable")
def min_reachable_query(spark, d):
    """Over the reversed steps: the first line of each line's order."""
    return min_reachable(graph(spark, d, "step").toDF("dst", "src"))


@query("select a, c, min(cost)::bigint as cost from (with recursive walk(a, c, cost) as (select src, dst, cost from step union all select w.a, e.dst, w.cost + e.cost from walk w join step e on w.c = e.src) select * from walk) group by all", "step", name="cheapest_paths")
def cheapest_paths_query(spark, d):
    return cheapest_paths(steps(spark, d))


# -- incremental maintenance ------------------------------------------------------------------


@query("select x.src as a, x.dst as b, y.dst as c, count(*)::bigint as n from edge x join edge y on x.dst = y.src group by 1, 2, 3", "edge")
def ivm_wedges(spark, d):
    e = graph(spark, d, "edge")
    late = F.pmod(F.xxhash64("src", "dst"), F.lit(10)) == 0
    old, delta = checkpointed(counted(e.where(~late))), checkpointed(counted(e.where(late)))
    view = paths(old).unionByName(delta_paths(old, delta))
    return view.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


@query("select x.src as a, x.dst as b, y.dst as c, count(*)::bigint as n from raw x join raw y on x.dst = y.src group by 1, 2, 3", "raw")
def ivm_batches(spark, d):
    """A view that is fed in four batches, of which each is joined with what came before only."""
    view = PathView(spark)
    raw = checkpointed(successions(spark, d).select("src", "dst"))
    for i in range(4):
        view.apply(raw.where(F.pmod(F.xxhash64("src", "dst"), F.lit(4)) == i))
    return view.current()


_NATIONS = "nations as (select n_nationkey::bigint + 100 as src, n_regionkey::bigint as dst from nation union all select r_regionkey, 100 + r_regionkey * 5 from region)"
_NATION_PATHS = "select x.src as a, x.dst as b, y.dst as c, count(*)::bigint as n from e x join e y on x.dst = y.src group by 1, 2, 3"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    """A small graph: nations to regions, and regions to nations."""
    up = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return up.unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("src"), (F.col("r_regionkey") * 5 + 100).cast("long").alias("dst")))


@query(f"with {_NATIONS}, e as (select * from nations union all select src, 1000 + src from nations where src >= 100 union all select 1000 + src, dst from nations where src >= 100) {_NATION_PATHS}")
def ivm_cases(spark, d):
    """Every edge from a nation gets a detour by a new vertex; the cases give what the view gains."""
    old = checkpointed(counted(_nations(spark, d)))
    detours = old.where(F.col("src") >= 100).select(F.col("src").alias("a"), (F.col("src") + 1000).alias("b"), F.col("dst").alias("c"))
    return paths(old).unionByName(delta_by_cases(old, detours)).groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


@query(f"with {_NATIONS}, e as (select * from nations) {_NATION_PATHS}")
def ivm_tuples(spark, d):
    """The view after one batch for the nations and one tuple at a time for the regions."""
    view, edges = PathView(spark), checkpointed(_nations(spark, d))
    view.apply(edges.where(F.col("src") >= 100))
    for r in sorted(edges.where(F.col("src") < 100).collect()):  # five rows
        view.apply(spark.createDataFrame([tuple(r)], "src long, dst long"))
    return view.view.compress().df


@query(f"with {_NATIONS}, e as (select * from nations) {_NATION_PATHS}")
def ivm_recomputed(spark, d):
    view = PathView(spark)
    view.apply(_nations(spark, d))
    return view.recomputed()


@query(f"with {_NATIONS} select count(*)::bigint as n, sum(src)::bigint as s, sum(dst)::bigint as t from nations")
def rewrite_events(spark, d):
    """Undoing every rewrite's two edges by their fresh vertex gives the graph that was rewritten."""
    edges = sorted(tuple(r) for r in _nations(spark, d).collect())  # thirty rows
    grown = [e for added in rewrites(edges, 40, fresh=10_000) for e in added]
    assert len(grown) == 80
    left = spark.createDataFrame(edges + grown, "src long, dst long").where((F.col("src") < 10_000) & (F.col("dst") < 10_000))
    return left.agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("s"), F.sum("dst").alias("t"))


# -- text sources and literal relations -------------------------------------------------------


def _text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Write lines as text in the shared folder; the path."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _line(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")


@query("select src, dst, count(*)::bigint as n from raw group by 1, 2", "raw")
def text_edges(spark, d):
    path = _text(spark, successions(spark, d).select(_line("src", "dst")), "edges")
    return Relation.as_bag(edge_list(spark, path), "src", "dst").df


@query("select s_suppkey as src, s_nationkey::bigint as dst from supplier order by 1 limit 50")
def text_edges_capped(spark, d):
    lines = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").coalesce(1).sortWithinPartitions("s_suppkey")
    return edge_list(spark, _text(spark, lines.select(_line("s_suppkey", "s_nationkey")), "capped"), "50")


@query("select src, dst, count(*)::bigint as n from raw group by 1, 2", "raw")
def text_edges_weighted(spark, d):
    path = _text(spark, successions(spark, d).withColumn("w", F.lit("{'weight': 1}")).select(_line("src", "dst", "w")), "weighted")
    return Relation.as_bag(weighted_edges(spark, path), "src", "dst").df


@query("select distinct src, dst, 'n' as label from raw where src < dst union all select distinct src, dst, 'e' from raw where src >= dst", "raw")
def text_edges_labelled(spark, d):
    lines = successions(spark, d).withColumn("label", F.when(F.col("src") < F.col("dst"), "n").otherwise("e"))
    read = labelled_edges(spark, _text(spark, lines.select(_line("src", "dst", "label")), "labelled"))
    return read["n"].distinct().withColumn("label", F.lit("n")).unionByName(read["e"].distinct().withColumn("label", F.lit("e")))


@query("select * from (values (1::bigint, 'one'), (2, 'two'), (3, 'three')) t(k, name) join (select p_partkey as k from part) using (k)")
def literal_join(spark, d):
    return Relation.rows(spark, [(1, "one"), (2, "two"), (3, "three"), (3, "three")], "k long, name string").join(_parts(spark, d)).df


@query("select p_partkey as k, 'some' as leaf from part where p_partkey = 7 union all select 42 as k, 'singleton' as leaf")
def option_leaves(spark, d):
    """Some value, no value, a singleton and the empty relation as leaves of a union."""
    parts = _parts(spark, d)
    some = parts.where(F.col("k") == 7).df.withColumn("leaf", F.lit("some"))
    none = parts.empty().df.withColumn("leaf", F.lit("none"))
    one = Relation.rows(spark, [(42,)], "k long").df.withColumn("leaf", F.lit("singleton"))
    return some.unionByName(none).unionByName(one).unionByName(Relation.rows(spark, [], "k long").df.withColumn("leaf", F.lit("empty")))


@query("select src, dst, n from w", "w")
def stored_edges(spark, d):
    return _w(spark, d).stored("edges").df


@query("select r_regionkey as k, r_name as name from region")
def drained(spark, d):
    rows = Relation.as_set(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name")), "k", "name").drain()
    return spark.createDataFrame(rows, "k int, name string")


@query("select src, dst from edge where src > 10 and src < 20", "edge")
def range_open_low(spark, d):
    return _edge(spark, d).in_range("src", 10, 20, low_open=True).df


@query("select src, dst from edge where src >= 10 and src <= 20", "edge")
def range_closed_high(spark, d):
    return _edge(spark, d).in_range("src", 10, 20, high_closed=True).df


@query("select src, dst, k from edge cross join (select r_regionkey as k from region)", "edge")
def column_extension(spark, d):
    """A relation without a column holds for each value of it."""
    return _edge(spark, d).join(Relation.as_set(table(spark, d, "region").select(F.col("r_regionkey").alias("k")), "k", unique=True)).df


@query("select src, dst, null::bigint as n from w union all select null, null, n from w", "w")
def keys_and_values(spark, d):
    w = _w(spark, d)
    return w.keys_only().df.withColumn("n", F.lit(None).cast("long")).unionByName(w.values(), allowMissingColumns=True)


@query("select src, dst, n + 1 as n from w", "w")
def bag_insert(spark, d):
    return _w(spark, d).insert(graph(spark, d, "edge")).df


@query("select src as k, ((x + y) * z)::bigint as n from (select src, count(*) filter (where dst % 2 = 0) x, count(*) filter (where dst % 2 = 1) y, count(*) z from edge group by 1) order by 1", "edge")
def semiring_distributes(spark, d):
    """(x + y) z by its other side, x z + y z."""
    e = graph(spark, d, "edge")
    x, y, z = (Relation.as_bag(part.select(F.col("src").alias("k")), "k") for part in (e.where(F.col("dst") % 2 == 0), e.where(F.col("dst") % 2 == 1), e))
    return x.join(z).union(y.join(z)).df


@query("select x.a as a, x.b as b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b", "u")
def datalog_planned(spark, d):
    """The triangle rule in the order of its plan, which starts with the variables that most atoms share."""
    text = "u(a, b), u(b, c), u(a, c)"
    return Engine(spark, {"u": graph(spark, d, "u")}).query(text, planned_order(parse_query(text))).select("a", "b", "c")


@query("select unnest(['h(a, c) <- r(a, b), s(b, c).', 'b <- r'',s', 'a <- r''', 'c <- s']) as line")
def datalog_printed(spark, d):
    """The plan of a rule as text: a re-sorted copy is marked."""
    lines = explain(parse_rule("h(a, c) <- r(a, b), s(b, c)")).split("\n")
    return spark.createDataFrame([(x,) for x in lines if not x.startswith("sort")], "line string")


#: The queries that bench.py times: one for each family of plans.
HEADLINES = ("triangle_undirected", "triangle_directed", "triangle_bag", "closure", "closure_doubling", "labelled_reach", "min_reachable", "ivm_wedges", "wedge_by_mid", "full_outer", "union_nway", "datalog_negation")
