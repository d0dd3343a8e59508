"""Text edge lists; malformed lines fail the job in place of vanishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _strict_long(column: Column) -> Column:
    """ANSI casts raise anyway; this raises under any setting."""
    value = column.try_cast("bigint")
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a vertex id: "), F.coalesce(column, F.lit("nothing")))).cast("bigint"))


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return text.where(~F.col("value").rlike(r"^\s*(#|$)"))


def edge_list(spark: SparkSession, paths: str | Sequence[str], cap: int | str | None = None) -> DataFrame:
    """``src dst …`` separated by white space; blank lines and # comments are skipped."""
    lines = first_rows(_lines(spark, paths), cap)
    tokens = F.split(F.trim("value"), r"\s+")
    return lines.select(_strict_long(F.get(tokens, F.lit(0))).alias("src"), _strict_long(F.get(tokens, F.lit(1))).alias("dst"))


def weighted_edges(spark: SparkSession, paths: str | Sequence[str], cap: int | str | None = None) -> DataFrame:
    """``src dst {…}`` with whatever follows ignored; the cap counts lines."""
    lines = first_rows(spark.read.text([paths] if isinstance(paths, str) else list(paths)), cap)
    tokens = F.split("value", " ")
    return lines.select(_strict_long(F.get(tokens, F.lit(0))).alias("src"), _strict_long(F.get(tokens, F.lit(1))).alias("dst"))


def labelled_edges(spark: SparkSession, paths: str | Sequence[str], labels: Sequence[str] = ("n", "e")) -> dict[str, DataFrame]:
    """``x y label`` lines of one or several files, a frame for each label; other labels are ignored."""
    tokens = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, paths).select(_strict_long(F.get(tokens, F.lit(0))).alias("src"), _strict_long(F.get(tokens, F.lit(1))).alias("dst"), F.element_at(tokens, -1).alias("label"))
    return {x: rows.where(F.col("label") == x).drop("label") for x in labels}


def parse_cap(text: str | int | None) -> int | None:
    """``all``, an integer, or one with a k, m or M suffix."""
    if text is None or isinstance(text, int):
        return text
    text = text.strip()
    if text == "all":
        return None
    scale = {"k": 1_000, "m": 1_000_000, "M": 1_000_000}.get(text[-1:], 1)
    return int(text[:-1] if scale > 1 else text) * scale


def first_rows(lines: DataFrame, cap: int | str | None) -> DataFrame:
    """The first ``cap`` rows in file order.

    Rows are numbered within their partition and partitions by their counts, so only one small row a
    partition is ever gathered; no row moves.
    """
    n = parse_cap(cap)
    if n is None:
        return lines
    numbered = lines.withColumn("__id", F.monotonically_increasing_id())
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    marked = numbered.withColumn("__part", part).withColumn("__within", within)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    kept = starts.where(F.col("__start") < n).select("__part", "__start")
    return marked.join(kept, "__part").where(F.col("__start") + F.col("__within") < n).drop("__id", "__part", "__within", "__start", "__n")
