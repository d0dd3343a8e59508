"""What the operators share: reading columns safely, Arrow row loops, spans in code points."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import ship_package

#: Rows that are decoded to Python objects at a time; bounds a worker's memory beside one Arrow batch.
SLICE = 128


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only these two columns, whatever else the table holds; null text is empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def each_slice(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[tuple]]], schema: str) -> DataFrame:
    """A row for each document: doc_id and what the function that ``make`` builds says of its text.

    ``make`` runs once a task, so it can build tables and caches; the function gets some texts at a
    time. ``schema`` excludes doc_id.
    """
    full = f"doc_id long, {schema}"
    arrow = _arrow_schema(docs.sparkSession, full)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = list(zip(*of(part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    ship_package(docs.sparkSession)
    return id_and_text(docs).mapInArrow(rows, full)


def each_text(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], schema: str) -> DataFrame:
    """As each_slice, for functions of one text."""

    def of_slice():
        of = make()
        return lambda texts: [of(t) for t in texts]

    return each_slice(docs, of_slice, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in schema])


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark takes what Python makes of a small file for small as well, however many rows it makes, and would
    gather it in the driver. A side that grows with the table is marked by this.
    """
    return df.hint("merge")


#: Ids up to which a set of them is broadcast (16 bytes each and a hash table); more are joined.
BROADCAST_IDS = 500_000


def only_ids(docs: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (__id, without repeats), or is not.

    ``ids`` must be durable: it is counted first, and broadcast only if it is small. A null doc_id is
    never among them.
    """
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].cast("long") == ids["__id"], "left_semi" if keep else "left_anti")


def row_key(docs: DataFrame) -> Column:
    """With the id this tells rows of different texts apart; null text is empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def only_rows(docs: DataFrame, rows: DataFrame, keep: bool) -> DataFrame:
    """The rows of ``docs`` that are among ``rows`` (__id, __key: a row_key; without repeats), or are not.

    A null id equals a null id, so each row gets what was decided for its own text. ``rows`` must be
    durable: it is counted first, and broadcast only if it is small.
    """
    few = rows.count() <= BROADCAST_IDS
    same = docs["doc_id"].cast("long").eqNullSafe(rows["__id"]) & (row_key(docs) == rows["__key"])
    return docs.join(F.broadcast(rows) if few else rows, same, "left_semi" if keep else "left_anti")


Span = tuple[int, int, str]


def join_spans(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then by the kind's place in ``kinds``, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
