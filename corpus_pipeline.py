"""A corpus pipeline: each stage reads what the one before wrote, and all of it.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``; the last one adds the copy number
and the shuffle key of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import only_rows
from lattica.llm.decontaminate import without_leaks
from lattica.llm.exact_dedup import keep_one
from lattica.llm.mixing import mix
from lattica.llm.near_dedup import keep_representatives
from lattica.llm.quality import scored_rows
from lattica.session import checkpointed, rest_executors, small_batches, written


def begin(spark: SparkSession) -> None:
    """Executors begin each stage with a heap no larger than what is in use, and take texts in small batches."""
    small_batches(spark)
    rest_executors(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: low quality or toxic."""
    begin(spark)
    scored = scored_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.where(~F.col("keep")).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    return only_rows(docs, checkpointed(rejected), keep=False)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    begin(spark)
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near copies join (links, and links of links) the row with the least id stays."""
    begin(spark)
    return keep_representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    begin(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated so that sources stand in proportion to the root of their sizes, and shuffled."""
    begin(spark)
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mixture),
]

#: A trained classifier is among the stages, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
