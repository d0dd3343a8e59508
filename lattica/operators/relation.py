"""Relations over flat key columns with set, bag or annotated semantics.

Every operator maps DataFrames to DataFrames and is lazy. A bag keeps one row per distinct tuple with
its multiplicity, so joins multiply small counts in place of repeating rows, and unions and
projections combine on the map side before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.bounds import between_bounds
from lattica.functions.semiring import COUNT, Semiring
from lattica.session import written

KINDS = ("set", "bag", "map")


@dataclass(frozen=True)
class Relation:
    """``keys`` are non-null columns; ``value`` is the annotation of a bag or map, None for a set."""

    df: DataFrame
    keys: tuple[str, ...]
    kind: str = "set"
    value: str | None = None
    semiring: Semiring = COUNT

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}, not {self.kind!r}")
        if (self.value is None) != (self.kind == "set"):
            raise ValueError("sets have no value column; bags and maps have one")
        wanted = [*self.keys, *([self.value] if self.value else [])]
        if missing := [c for c in wanted if c not in self.df.columns]:
            raise ValueError(f"no such columns: {missing}")
        if len(set(wanted)) != len(wanted):
            raise ValueError(f"columns repeat: {wanted}")

    # -- constructors -------------------------------------------------------------------------

    @staticmethod
    def as_set(df: DataFrame, *keys: str, unique: bool = False) -> Relation:
        """Rows with a null key are rejected: keys are totally ordered values."""
        kept = df.select(*keys).na.drop() if keys else df.select().limit(1)
        return Relation(kept if unique or not keys else kept.distinct(), keys)

    @staticmethod
    def as_bag(df: DataFrame, *keys: str, count: str = "n") -> Relation:
        return Relation(df.select(*keys).na.drop().groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), keys, "bag", count)

    @staticmethod
    def as_map(df: DataFrame, keys: Sequence[str], value: str, semiring: Semiring = COUNT, unique: bool = False) -> Relation:
        kept = df.select(*keys, value).na.drop(subset=list(keys))
        if not unique:
            kept = kept.groupBy(*keys).agg(semiring.plus(F.col(value)).alias(value))
        return Relation(kept, tuple(keys), "map", value, semiring)

    @staticmethod
    def rows(spark: SparkSession, rows: Sequence[tuple], schema: str, kind: str = "set", value: str | None = None, semiring: Semiring = COUNT) -> Relation:
        """A literal relation; an empty list is the empty relation, one row is a constant."""
        df = spark.createDataFrame(list(rows), schema)
        keys = tuple(c for c in df.columns if c != value)
        if kind == "set":
            return Relation.as_set(df, *keys)
        if value is None:
            return Relation.as_bag(df, *keys)
        return Relation.as_map(df, keys, value, semiring) if kind == "map" else Relation(df.groupBy(*keys).agg(F.sum(value).alias(value)), keys, "bag", value)

    def empty(self) -> Relation:
        return self._with(self.df.where(F.lit(False)))

    def _with(self, df: DataFrame, keys: Sequence[str] | None = None) -> Relation:
        return Relation(df, self.keys if keys is None else tuple(keys), self.kind, self.value, self.semiring)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *([self.value] if self.value else [])]

    # -- projection, selection, computed columns ----------------------------------------------

    def rename(self, *names: str) -> Relation:
        """New key names by position; the value column keeps its own."""
        if len(names) != len(self.keys):
            raise ValueError(f"{len(self.keys)} names are needed, not {len(names)}")
        columns = [F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)]
        return self._with(self.df.select(*columns, *([self.value] if self.value else [])), names)

    def reverse(self) -> Relation:
        """The same tuples with the key columns in opposite order (an index on the last column)."""
        return self._with(self.df.select(*reversed(self.keys), *([self.value] if self.value else [])), tuple(reversed(self.keys)))

    def where(self, condition: Column) -> Relation:
        return self._with(self.df.where(condition))

    def in_range(self, key: str, low: Any = None, high: Any = None, low_open: bool = False, high_closed: bool = False) -> Relation:
        return self.where(between_bounds(F.col(key), low, high, low_open, high_closed))

    def lookup(self, key: str, constant: Any) -> Relation:
        """The tuples with ``key = constant``, without that column."""
        rest = [k for k in self.keys if k != key]
        kept = self.df.where(F.col(key) == F.lit(constant))
        if rest:
            return self._with(kept.drop(key), rest)
        return Relation(kept.select(*([self.value] if self.value else [])), (), self.kind, self.value, self.semiring)

    def equal(self, key: str, repeated: str) -> Relation:
        """Tuples whose two key columns are equal, with the second one dropped."""
        return self._with(self.df.where(F.col(key) == F.col(repeated)).drop(repeated), [k for k in self.keys if k != repeated])

    def map_value(self, expression: Column, value: str = "v") -> Relation:
        return Relation(self.df.select(*self.keys, expression.alias(value)), self.keys, "map", value, self.semiring)

    def filter_map(self, expression: Column, value: str = "v") -> Relation:
        """As map_value, without the tuples for which the expression is null."""
        return self.map_value(expression, value).where(F.col(value).isNotNull())

    def extend(self, name: str, expression: Column, partial: bool = False) -> Relation:
        """Join with a function of bound columns; a partial one is null where it is undefined.

        If ``name`` is bound already, the function only tests it.
        """
        if name in self.keys:
            return self.where(F.col(name) == expression)
        out = self.df.withColumn(name, expression)
        return self._with((out.where(F.col(name).isNotNull()) if partial else out).select(*self.keys, name, *([self.value] if self.value else [])), (*self.keys, name))

    def scale(self, factor: Any) -> Relation:
        return self._with(self.df.withColumn(self.value, self.semiring.times(F.col(self.value), F.lit(factor))))

    def project(self, *keys: str) -> Relation:
        """Forget the other keys: distinct for sets, summed annotations otherwise."""
        if self.kind == "set":
            return Relation.as_set(self.df, *keys) if keys else Relation(self.df.select().limit(1), ())
        return self._with(self.df.groupBy(*keys).agg(self.semiring.plus(F.col(self.value)).alias(self.value)), keys)

    def keys_only(self) -> Relation:
        return Relation(self.df.select(*self.keys), self.keys)

    def nested(self, outer: int = 1) -> DataFrame:
        """One row per distinct prefix with the list of what hangs below it."""
        return self.df.groupBy(*self.keys[:outer]).agg(F.sort_array(F.collect_list(F.struct(*[c for c in self.columns if c not in self.keys[:outer]]))).alias("items"))

    def stored(self, name: str = "relation") -> Relation:
        """The same tuples, written once in the shared folder and read from there."""
        return self._with(written(self.df.select(*self.columns), name))

    def values(self) -> DataFrame:
        """The annotations alone, one a tuple."""
        return self.df.select(self.value)

    def count(self) -> int:
        return self.df.count()

    def drain(self) -> list[tuple]:
        """All tuples, in key order, on the driver: for tests and small results."""
        return [tuple(r) for r in self.df.select(*self.columns).orderBy(*self.keys).collect()]

    # -- joins --------------------------------------------------------------------------------

    def _annotated(self, name: str) -> tuple[DataFrame, Column | None]:
        if self.value is None:
            return self.df.select(*self.keys), None
        return self.df.select(*self.keys, F.col(self.value).alias(name)), F.col(name)

    def join(self, other: Relation, value: str | None = None) -> Relation:
        """Natural join on the shared keys; annotations multiply. Sets count as annotated with one."""
        shared = [k for k in self.keys if k in other.keys]
        left, lv = self._annotated("__l")
        right, rv = other._annotated("__r")
        joined = left.join(right, shared, "inner") if shared else left.crossJoin(right)
        keys = (*self.keys, *[k for k in other.keys if k not in shared])
        if lv is None and rv is None:
            return Relation(joined.select(*keys), keys)
        semiring = self.semiring if lv is not None else other.semiring
        out = lv if rv is None else rv if lv is None else semiring.times(lv, rv)
        name = value or self.value or other.value
        kind = "bag" if "map" not in (self.kind, other.kind) else "map"
        return Relation(joined.select(*keys, out.alias(name)), keys, kind, name, semiring)

    def outer(self, other: Relation, how: str = "full", left: str = "lv", right: str = "rv", default: Any = None) -> DataFrame:
        """Full, left or right outer join on the shared keys, with presence flags has_l and has_r."""
        shared = [k for k in self.keys if k in other.keys]
        l_side = self.df.select(*self.keys, *([F.col(self.value).alias(left)] if self.value else []), F.lit(True).alias("__hl"))
        r_side = other.df.select(*other.keys, *([F.col(other.value).alias(right)] if other.value else []), F.lit(True).alias("__hr"))
        joined = l_side.join(r_side, shared, how)
        rest = [c for c in joined.columns if c not in (*shared, "__hl", "__hr")]
        filled = [F.coalesce(F.col(c), F.lit(default)).alias(c) if default is not None and c in (left, right) else F.col(c) for c in rest]
        return joined.select(*shared, *filled, F.coalesce("__hl", F.lit(False)).alias("has_l"), F.coalesce("__hr", F.lit(False)).alias("has_r"))

    def _filtering(self, other: Relation, how: str) -> Relation:
        shared = [k for k in self.keys if k in other.keys]
        if not shared:
            raise ValueError("no key is shared")
        return self._with(self.df.join(other.df.select(*shared), shared, how).select(*self.columns))

    def semijoin(self, other: Relation) -> Relation:
        return self._filtering(other, "left_semi")

    def antijoin(self, other: Relation) -> Relation:
        return self._filtering(other, "left_anti")

    def theta(self, other: Relation, condition: Column) -> Relation:
        """Join on any condition; give equalities as shared keys of ``join`` where there are any."""
        keys = (*self.keys, *other.keys)
        return Relation(self.df.select(*self.keys).join(other.df.select(*other.keys), condition).select(*keys), keys)

    def improving(self, known: Relation) -> Relation:
        """The tuples that are absent from ``known`` or have a strictly smaller value there."""
        old = known.df.select(*self.keys, F.col(known.value).alias("__old"))
        kept = self.df.join(old, list(self.keys), "left").where(F.col("__old").isNull() | (F.col(self.value) < F.col("__old")))
        return self._with(kept.select(*self.columns))

    # -- set operations -----------------------------------------------------------------------

    def union(self, other: Relation) -> Relation:
        return merge_all([self, other])

    def intersect(self, other: Relation) -> Relation:
        return self.semijoin(other.rename(*self.keys) if other.keys != self.keys else other)

    def difference(self, other: Relation) -> Relation:
        return self.antijoin(other.rename(*self.keys) if other.keys != self.keys else other)

    def insert(self, rows: DataFrame) -> Relation:
        """A bag with each tuple of ``rows`` once more."""
        return self.union(Relation.as_bag(rows, *self.keys, count=self.value))

    def remove(self, rows: DataFrame) -> Relation:
        """A bag with each tuple of ``rows`` once less; counts never fall below zero."""
        less = Relation.as_bag(rows, *self.keys, count="__less").df
        left = self.df.join(less, list(self.keys), "left").withColumn(self.value, F.col(self.value) - F.coalesce("__less", F.lit(0)))
        return self._with(left.where(F.col(self.value) > 0).select(*self.columns))


def merge_all(relations: Sequence[Relation], layers: str | None = None) -> Relation:
    """Union of any number of relations with the same keys; equal tuples combine by the semiring.

    ``layers`` adds a column with the number of inputs that hold the tuple.
    """
    first = relations[0]
    if any(r.keys != first.keys or r.kind != first.kind for r in relations):
        raise ValueError("unions need the same keys and kind")
    value = [F.col(first.value)] if first.value else []
    stacked = reduce(DataFrame.unionByName, [r.df.select(*r.keys, *([F.col(r.value).alias(first.value)] if r.value else [])) for r in relations])
    sums: list[Column] = [first.semiring.plus(value[0]).alias(first.value)] if value else []
    if layers:
        sums.append(F.count(F.lit(1)).alias(layers))
    df = stacked.groupBy(*first.keys).agg(*sums) if sums else stacked.distinct()
    return Relation(df, first.keys, first.kind, first.value, first.semiring)


def natural_join(relations: Sequence[Relation], order: Callable[[list[Relation]], list[Relation]] | None = None) -> Relation:
    """Join many relations; each step takes one that shares a key with what is joined, if any does."""
    left = list(order(list(relations)) if order else relations)
    out = left.pop(0)
    while left:
        nearest = next((r for r in left if set(r.keys) & set(out.keys)), left[0])
        left.remove(nearest)
        out = out.join(nearest)
    return out


def outer_all(relations: Sequence[Relation], default: Any = None) -> DataFrame:
    """Full outer join of any number of annotated relations on their common keys, one column each.

    The inputs are stacked and grouped once: one shuffle whatever their number, in place of a chain of
    outer joins. Where a relation lacks a tuple its column is ``default``.
    """
    keys = relations[0].keys
    values = [r.value for r in relations]
    if any(r.keys != keys or r.value is None for r in relations) or len(set(values)) != len(values):
        raise ValueError("the same keys and different value columns are needed")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.df.select(*keys, r.value) for r in relations])
    out = stacked.groupBy(*keys).agg(*[r.semiring.plus(F.col(r.value)).alias(r.value) for r in relations])
    return out.na.fill(default, subset=values) if default is not None else out
