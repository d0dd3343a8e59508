"""The star-schema tables and the graphs that the queries read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag (src, dst, q): the part of one order line, that of the next line, the first line's quantity."""
    line = table(spark, sf_dir, "lineitem")
    first = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("q"))
    second = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    # Keys are never null: one filter here, for both ends, lets every query share one exchange below.
    return first.join(second, ["l_orderkey", "l_linenumber"]).select("src", "dst", "q").na.drop(subset=["src", "dst"])


def vertex(order: str, line: str) -> Column:
    """A number for each order line; an order has seven at most."""
    return F.col(order) * 8 + F.col(line)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, cost): each order line and the next one of its order, and the first one's quantity."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("cost"))
    first = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), vertex("l_orderkey", "l_linenumber").alias("src"), "cost")
    second = line.select("l_orderkey", "l_linenumber", vertex("l_orderkey", "l_linenumber").alias("dst"))
    return first.join(second, ["l_orderkey", "l_linenumber"]).select("src", "dst", "cost").na.drop(subset=["src", "dst"])


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """edge: parts, set; w: counted; u: undirected a < b; step: order lines, set; seed: customer to the first line of an order."""
    if name == "seed":
        return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 8 + 1).alias("c")).distinct()
    if name == "step":
        return steps(spark, sf_dir).select("src", "dst").distinct()
    raw = successions(spark, sf_dir)
    if name == "edge":
        return raw.select("src", "dst").distinct()
    if name == "w":
        return raw.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    if name == "u":
        return raw.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    raise KeyError(name)
