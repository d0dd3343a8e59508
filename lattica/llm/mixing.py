"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source whose n rows should become t gets the mean repetition rate λ = t / n. A row is repeated k
times, where k inverts the Poisson(λ) distribution at a uniform number from a hash of its id, so runs
repeat exactly and no row's fate depends on another row. The output is dealt to partitions and sorted
in them by a hash of (id, copy): a global shuffle.

Rates above CHUNK are split into equal parts with numbers of their own, whose sum is Poisson(λ)
again; so the distribution's table stays short for any rate and nothing underflows.

Cases: a null source is a source; sources without a weight, or with a weight of zero or less, vanish;
equal ids get equal counts, so repeated rows are repeated alike; rows without an id are told apart by their
texts; null and very long texts pass through; an empty table gives an empty result; other columns pass
through, whatever their names: where the table has a copy or shuffle_key of its own, the new columns are
called mix_copy and mix_shuffle_key, with more underscores in front until they are new.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import documents

#: Largest mean of one draw, and entries of its table: beyond, a draw's chance is under 2**-52.
CHUNK, ENTRIES = 8, 48
#: Rates of up to so many sources are broadcast; more are joined by source and salt.
BROADCAST_SOURCES, SALTS = 10_000, 64
SEED = 17
#: Sources get weights in proportion to their size to this power: small ones are seen more often.
POWER = 0.5


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column, entries: int = ENTRIES) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(entries - 1)), start, add, lambda s: s["cdf"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, power: float = POWER) -> DataFrame:
    """__source, __n, __rate for each source; the rates aim at ``epochs`` times the rows of all sources."""
    sizes = docs.select(F.col("source").cast("string").alias("__source")).groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weighted = sizes.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, __w double")
        weighted = sizes.join(given, F.col("__source").eqNullSafe(F.col("k"))).drop("k").where(F.col("__w") > 0)
    whole = weighted.agg(F.sum("__w").alias("__sum_w")).crossJoin(sizes.agg(F.sum("__n").alias("__sum_n")))  # one row with one row
    return weighted.crossJoin(whole).select("__source", "__n", (F.lit(float(epochs)) * F.col("__sum_n") * F.col("__w") / F.col("__sum_w") / F.col("__n")).alias("__rate"))


def _new_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    if name in taken:
        name = f"mix_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED, power: float = POWER) -> DataFrame:
    """The columns of ``docs`` with copy (from 1) and shuffle_key, one row a repetition, shuffled."""
    names = docs.columns
    copy_name, key_name = (_new_name(n, names) for n in ("copy", "shuffle_key"))
    own_names = [f"__{i}" for i in range(len(names))]
    at = {n.lower(): o for n, o in zip(names, own_names, strict=True)}
    source, doc_id = F.col(at["source"]).cast("string"), F.col(at["doc_id"])
    text = F.coalesce(F.col(at["text"]).cast("string"), F.lit("")) if "text" in at else F.lit("")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / CHUNK)).cast("int")
    table = rates(docs, weights, epochs, power).withColumn("__parts", parts).withColumn("__cdf", poisson_table(F.col("__rate") / F.col("__parts"))).select("__source", "__parts", "__cdf")
    known = table.limit(BROADCAST_SOURCES + 1).collect()
    rows = docs.toDF(*own_names)  # no name of the table's meets one of those below
    if len(known) <= BROADCAST_SOURCES:  # a bounded number of short rows
        small = docs.sparkSession.createDataFrame(known, table.schema)
        rated = rows.join(F.broadcast(small), source.eqNullSafe(F.col("__source")))
    else:  # a hot source is spread over SALTS reducers
        spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__mine", F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)).cast("int"))
        rated = dealt.join(spread, source.eqNullSafe(F.col("__source")) & (F.col("__mine") == F.col("__salt")))
    row_id = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.xxhash64(text).cast("string")))
    draw = lambda j: F.size(F.filter("__cdf", lambda c: c <= uniform(F.lit(str(seed)), row_id, j.cast("string")))).cast("int")
    times = F.when(F.col("__parts") == 1, draw(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0), lambda n, j: n + draw(j)))
    counted = rated.withColumn("__times", times).where(F.col("__times") > 0)
    repeated = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), row_id, F.col("__copy").cast("string")))
    out = repeated.select(*own_names, F.col("__copy").cast("long").alias("__number"), key.alias("__key"))
    return out.repartition(F.col("__key")).sortWithinPartitions("__key").toDF(*names, copy_name, key_name)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text"))


ORACLE = f"""
with sizes as (select source, count(*) as n from documents group by 1),
r as (select source, (sum(n) over ()) * pow(n::double, {POWER}) / (sum(pow(n::double, {POWER})) over ()) / n as rate from sizes),
p as (select source, greatest(1, ceil(rate / {CHUNK}))::bigint as parts, rate / greatest(1, ceil(rate / {CHUNK})) as mean from r),
mass as (select source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) as m from p, (select unnest(range(0, {ENTRIES})) as k)),
cdf as (select source, k, sum(m) over (partition by source order by k) as c from mass),
u as (select d.doc_id, d.source, ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13))::bigint / pow(2, 52) as u
      from documents d join p using (source), unnest(range(0, p.parts)) as t(j)),
times as (select u.doc_id, count(*) as times from u join cdf using (source) where cdf.c <= u.u group by 1)
select d.doc_id, d.source, d.lang, d.n_chars, d.text, copy, md5('order{SEED}:' || d.doc_id || ':' || copy) as shuffle_key
from documents d join times using (doc_id), unnest(range(1, times + 1)) as t(copy)
"""
