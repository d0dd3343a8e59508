"""Triangle queries: binary equi-joins, closing candidate wedges, and a HyperCube partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import checkpointed, ship_package


def orient(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected simple edges a < b from directed ones in any direction; self-loops go."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias(a), F.greatest("src", "dst").alias(b)).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def by_degree(pairs: DataFrame) -> DataFrame:
    """Undirected edges (a, b) turned so that ``lo`` has the smaller degree (ties: smaller id); other columns stay.

    Out-degrees are then at most the square root of twice the number of edges, whatever hubs the
    graph has, so the wedges below are bounded by m**1.5 in place of the sum of squared degrees.
    """
    degree = pairs.select(F.col("a").alias("x")).unionAll(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    both = pairs.join(degree.select(F.col("x").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("x").alias("b"), F.col("deg").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"), *[c for c in pairs.columns if c not in ("a", "b")])


def binary_triangles(edges: DataFrame, first: str = "b") -> DataFrame:
    """(a, b, c) with edges a-b, b-c and a-c by two binary joins; ``first`` is the variable joined first.

    Wedges on one vertex can be as many as the squares of degrees sum to: for graphs without hubs.
    """
    ab = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    bc = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    ac = edges.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    one, two, three, rest = {"b": (ab, bc, ac, ["a", "c"]), "a": (ab, ac, bc, ["b", "c"]), "c": (bc, ac, ab, ["a", "b"])}[first]
    return one.join(two, first).join(three, rest).select("a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with edges a-b, b-c and a-c, read as e(a,b), e(b,c), e(a,c) over columns src, dst."""
    return counted_triangles(edges.select("src", "dst").withColumn("n", F.lit(1).cast("long"))).select("a", "b", "c")


def counted_triangles(counted: DataFrame) -> DataFrame:
    """(a, b, c, mult): triangles e(a,b), e(b,c), e(a,c) of distinct edges (src, dst, n), with products of n.

    Undirected triangles come from wedges at their vertex of least degree, so hubs are safe; the six ways
    to read each as a directed one follow from the edges' counts in both directions. Triangles with a
    loop have two different vertices or one: they come from joins with the loops.
    """
    spark_pairs = counted.where(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = checkpointed(spark_pairs.agg(F.coalesce(F.sum(F.when(F.col("src") < F.col("dst"), F.col("n"))), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(F.col("src") > F.col("dst"), F.col("n"))), F.lit(0)).alias("down")))
    turned = by_degree(pairs)
    forward = F.col("lo") < F.col("hi")
    turned = checkpointed(turned.select("lo", "hi", F.when(forward, F.col("up")).otherwise(F.col("down")).alias("out"), F.when(forward, F.col("down")).otherwise(F.col("up")).alias("back")))
    x = turned.select(F.col("lo").alias("m"), F.col("hi").alias("x"), F.col("out").alias("mx"), F.col("back").alias("xm"))
    y = turned.select(F.col("lo").alias("m"), F.col("hi").alias("y"), F.col("out").alias("my"), F.col("back").alias("ym"))
    wedges = x.join(y, "m").where(F.col("x") < F.col("y"))
    closed = wedges.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("up").alias("xy"), F.col("down").alias("yx")), ["x", "y"])
    ways = [F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), (F.col(a + b) * F.col(b + c) * F.col(a + c)).alias("mult")) for a, b, c in permutations("mxy")]
    proper = closed.select(F.explode(F.filter(F.array(*ways), lambda t: t["mult"] > 0)).alias("t")).select("t.*")
    loops = counted.where(F.col("src") == F.col("dst")).select(F.col("src").alias("v"), F.col("n").alias("l"))
    edge = counted.select("src", "dst", "n")
    plain = edge.where(F.col("src") != F.col("dst"))
    at_first = edge.join(loops, edge["src"] == loops["v"]).select(F.col("src").alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), (F.col("l") * F.col("n") * F.col("n")).alias("mult"))
    at_last = plain.join(loops, plain["dst"] == loops["v"]).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").alias("c"), (F.col("n") * F.col("l") * F.col("n")).alias("mult"))
    there, back = plain.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("p")), plain.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("n").alias("q"))
    around = there.join(back, ["a", "b"]).join(loops, F.col("a") == loops["v"]).select("a", "b", F.col("a").alias("c"), (F.col("p") * F.col("q") * F.col("l")).alias("mult"))
    return proper.unionByName(at_first).unionByName(at_last).unionByName(around)


def closing_triangles(pairs: DataFrame) -> DataFrame:
    """Undirected triangles a < b < c of simple edges (a, b), safe with hubs: wedges from low degrees."""
    pairs = checkpointed(pairs.select("a", "b"))
    turned = checkpointed(by_degree(pairs))
    wedges = turned.select(F.col("lo").alias("m"), F.col("hi").alias("x")).join(turned.select(F.col("lo").alias("m"), F.col("hi").alias("y")), "m").where(F.col("x") < F.col("y"))
    closed = wedges.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi")
    ordered = F.sort_array(F.array("m", "x", "y"))
    return closed.select(ordered.alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


#: Edges that a cell of the HyperCube holds, about.
CELL_EDGES = 1_000_000


def hypercube_triangles(edges: DataFrame, side: int | None = None) -> DataFrame:
    """The result of :func:`triangles` in one shuffle: side**3 cells, each edge sent to 3·side of them.

    Every variable is hashed to ``side`` buckets. A cell (i, j, k) gets the edges that can be its
    e(a,b), e(b,c) and e(a,c), and joins them with sorted arrays. Cells hold about 3·m/side² edges;
    without ``side`` that is CELL_EDGES at most.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    side = side or max(2, ceil(sqrt(3 * edges.count() / CELL_EDGES)))

    def bucket(column: str):
        return F.pmod(F.xxhash64(column), F.lit(side)).cast("int")

    free = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    parts = [
        e.select(F.lit(0).alias("atom"), bucket("src").alias("i"), bucket("dst").alias("j"), free.alias("k"), "src", "dst"),
        e.select(F.lit(1).alias("atom"), free.alias("i"), bucket("src").alias("j"), bucket("dst").alias("k"), "src", "dst"),
        e.select(F.lit(2).alias("atom"), bucket("src").alias("i"), free.alias("j"), bucket("dst").alias("k"), "src", "dst"),
    ]
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2]).select((F.col("i") * side * side + F.col("j") * side + F.col("k")).alias("cell"), "atom", "src", "dst")
    ship_package(edges.sparkSession)
    return dealt.groupBy("cell").applyInArrow(_join_cell, "a long, b long, c long")


def _join_cell(table: pa.Table) -> pa.Table:
    atom, src, dst = (table.column(c).to_numpy() for c in ("atom", "src", "dst"))
    ab, bc, ac = (np.stack([src[atom == i], dst[atom == i]]) for i in range(3))
    bc = bc[:, np.lexsort((bc[1], bc[0]))]
    low, high = np.searchsorted(bc[0], ab[1], "left"), np.searchsorted(bc[0], ab[1], "right")
    known = np.empty(ac.shape[1], dtype=[("a", "i8"), ("c", "i8")])
    known["a"], known["c"] = ac
    known.sort()
    out = []
    for begin, end in _runs(high - low, 1 << 20):
        n = (high - low)[begin:end]
        at = np.repeat(low[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        wedge = np.empty(len(at), dtype=known.dtype)
        wedge["a"], wedge["c"] = np.repeat(ab[0][begin:end], n), bc[1][at]
        hit = np.isin(wedge, known) if len(known) else np.zeros(len(wedge), bool)
        out.append((wedge["a"][hit], np.repeat(ab[1][begin:end], n)[hit], wedge["c"][hit]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.empty(0, "i8") for i in range(3)]
    return pa.table(dict(zip("abc", columns, strict=True)))


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
