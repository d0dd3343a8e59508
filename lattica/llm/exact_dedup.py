"""Exact deduplication in combining steps, each of which compares whole texts.

Equal texts are those identical after lower-casing A-Z. Digests are counted first, so that texts whose
digest occurs once never move. A map task combines the other rows of its own. What is left of a digest is
merged within salted groups, so that a text with billions of copies reaches many reducers, each of which
gets at most one row a map task. The salts' winners are combined last. Rows then find their winner by
digest, text and a salt, of which a digest has the more the more rows it has. The text itself is part of
every grouping and joining key, so no step takes a digest's word for equality.

Cases: null text is empty; of a tie (the same doc_id twice with one text) both rows count in
group_size and one row stays; a null doc_id is smaller than any other; texts of any length are compared
whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_IDS, ascii_lower, documents, id_and_text, only_rows, row_key
from lattica.session import checkpointed

#: Salts a digest is spread over. Reducers of the last step get at most this many rows a text.
SALTS = 64
#: Rows of a digest for each salt by which they find their winner.
ROWS_A_SALT = 2_000

Digest = Callable[[Column], Column]


def _with_digest(docs: DataFrame, digest: Digest | None) -> DataFrame:
    """doc_id, raw (its digest, to find the row again), digest, norm."""
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("raw"), ascii_lower(F.col("text")).alias("norm"))
    return rows.select("doc_id", "raw", (digest or F.xxhash64)(F.col("norm")).alias("digest"), "norm")


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each different text of ``rows`` (doc_id, digest, norm): digest, norm, keep_id, group_size."""
    salted = rows.select("doc_id", "norm", "digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    local = salted.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return local.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _decided(docs: DataFrame, salts: int, digest: Digest | None, rows_a_salt: int = ROWS_A_SALT) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest occurs once, the other rows with digest, norm, keep_id, group_size, text_sha256)."""
    rows = _with_digest(docs, digest)
    repeated = checkpointed(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1))
    few = repeated.count() <= BROADCAST_IDS
    near = F.broadcast(repeated) if few else repeated
    alone = rows.join(F.broadcast(repeated.select("digest")) if few else repeated.select("digest"), "digest", "left_anti")
    spread = F.ceil(F.col("rows") / rows_a_salt).cast("int")
    crowd = rows.join(near, "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id", "raw", F.spark_partition_id()), spread).cast("int"))
    best = winners(rows.join(near.select("digest"), "digest"), salts).withColumn("text_sha256", F.sha2("norm", 256))
    dealt = best.join(near, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("rows")
    return alone, crowd.join(dealt, ["digest", "salt", "norm"]).drop("salt", "rows")


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Digest | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    alone, crowd = _decided(docs, salts, digest)
    one = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    return one.unionByName(crowd.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one of each group.

    Rows are decided by id and text, and only these keys of the rows that go are matched with the table,
    so texts need not move again. Where rows of one id have one text, any one of them stays.
    """
    _, crowd = _decided(docs, salts, None)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = checkpointed(crowd.where(F.col("group_size") > 1).groupBy(F.col("doc_id").alias("__id"), F.col("raw").alias("__key"), kept.alias("kept"), "text_sha256").agg(F.count(F.lit(1)).alias("n")))
    # Of the texts of one id that differ in case alone the first stays, and of equal rows any one.
    ties = rows.where("kept").groupBy("__id", "text_sha256").agg(F.min("__key").alias("first"), F.sum("n").alias("n")).where(F.col("n") > 1)
    ties = checkpointed(ties)
    gone = rows.where(~F.col("kept")).select("__id", "__key")
    if ties.isEmpty():
        return only_rows(docs, checkpointed(gone.distinct()), keep=False)
    same = rows["__id"].eqNullSafe(ties["__id"]) & (rows["text_sha256"] == ties["text_sha256"])
    others = rows.join(ties, same).where(rows["kept"] & (F.col("__key") != F.col("first"))).select(rows["__id"], "__key")
    stay = only_rows(docs, checkpointed(gone.unionByName(others).distinct()), keep=False)
    repeated = checkpointed(ties.select("__id", F.col("first").alias("__key")).distinct())
    once, twice = only_rows(stay, repeated, keep=False), only_rows(stay, repeated, keep=True)
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the table's
    return once.unionByName(twice.withColumn(own, row_key(twice)).dropDuplicates(["doc_id", own]).drop(own))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm)
"""
