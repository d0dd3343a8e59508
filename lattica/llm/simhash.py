"""SimHash fingerprints, and links between near ones by anchor-point covering.

Anchors are the words of a covering code on the low 46 bits of a fingerprint: two copies of the
perfect binary Golay code, each of covering radius 3. A fingerprint's home is the anchor that is
nearest in both halves. It is replicated to every anchor that can be the home of a fingerprint within
the threshold: halves within radius 3 + i and 3 + j of it, i + j up to the threshold. Two near
fingerprints thus meet at the home of the smaller one, where all 64 bits are compared.

Homes are different fingerprints, not documents, so copies cost one row. An anchor with more than
HOT homes isn't compared pairwise: fingerprints within two bits share a word at distance one from
both, so there each one emits itself and its one-bit neighbours, and all that meet in a word are
linked to the least of them. That takes 65 rows a fingerprint whatever the anchor holds.

Cases: null text is empty; a text without words has fingerprint zero, linked like any other; repeated
rows get equal results; an empty table gives an empty result; other columns are ignored; a null
doc_id is never the least of its component unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import _arrow_schema, by_shuffle, documents, each_slice
from lattica.llm.components import components
from lattica.session import checkpointed, ship_package, written

#: Words a shingle, seed of its hash, and differing bits up to which fingerprints link.
WORDS, SEED, THRESHOLD = 3, 42, 2
#: Homes of an anchor up to which they are compared with each visitor.
HOT = 128
#: Length, radius and generator polynomial of the perfect binary Golay code.
BITS, RADIUS, GENERATOR = 23, 3, 0b110001110101

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle, none make none."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), seed)], np.uint64)
    joined = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    return np.fromiter((digest(s, seed) for s in joined), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def make():
        return lambda texts: [(signed(fingerprint(shingle_hashes(t, words, seed))),) for t in texts]

    return each_slice(docs, make, "fp long")


# -- the covering code ------------------------------------------------------------------------


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    x = np.array(x, np.int64)
    for bit in range(BITS - 1, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


@lru_cache(maxsize=8)
def patterns(weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of up to ``weight`` bits sorted by syndrome and weight; where each syndrome's begin; their weights."""
    found = np.array([sum(1 << b for b in c) for w in range(weight + 1) for c in combinations(range(BITS), w)], np.int64)
    size = np.bitwise_count(found).astype(np.int64)
    of = syndromes(found)
    order = np.lexsort((size, of))
    begin = np.searchsorted(of[order], np.arange((1 << 11) + 1))
    return found[order], begin, size[order]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, whether it is the home) of every replica."""
    mask = (1 << BITS) - 1
    halves = [fps & mask, (fps >> BITS) & mask]
    found, begin, size = patterns(RADIUS + threshold)
    owners, codes, extra = [], [], []
    for half in halves:
        s = syndromes(half)
        n = begin[s + 1] - begin[s]
        owner = np.repeat(np.arange(len(half)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
        owners.append(owner)
        codes.append((half[owner] ^ found[at]) >> 11)  # the top twelve bits name a word of a cyclic code
        extra.append(np.maximum(size[at] - RADIUS, 0))
    out = []
    for i in range(threshold + 1):
        left = extra[0] == i
        right = extra[1] <= threshold - i
        lo, lc = owners[0][left], codes[0][left]
        ro, rc, re_ = owners[1][right], codes[1][right], extra[1][right]
        first = np.searchsorted(ro, np.arange(len(fps) + 1))
        n = first[lo + 1] - first[lo]
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo], n)
        out.append((np.repeat(lo, n), np.repeat(lc, n) << 12 | rc[pick], (re_[pick] == 0) & (i == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def replicas(fps: DataFrame, threshold: int = THRESHOLD, homes_only: bool = False) -> DataFrame:
    """(anchor, fp) for each fingerprint of ``fps`` (fp) and each anchor that it visits."""
    schema = "anchor int, fp long"
    arrow = _arrow_schema(fps.sparkSession, schema)
    ship_package(fps.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                owner, anchor, home = anchors(part, 0 if homes_only else threshold)
                if homes_only:
                    owner, anchor = owner[home], anchor[home]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[owner])], schema=arrow)

    return fps.select("fp").mapInArrow(rows, schema)


def near_fingerprints(fps: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect every two of the different fingerprints ``fps`` (fp) within ``threshold``.

    Below ``hot`` homes an anchor gives each such pair; above it, links to one fingerprint of each
    one-bit ball, so that the same fingerprints stay connected (thresholds of up to two).
    """
    fps = fps.select("fp")
    homes = checkpointed(replicas(fps, threshold, homes_only=True))
    crowded = checkpointed(homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"))
    some = not crowded.isEmpty()
    visitors = replicas(fps, threshold).select("anchor", F.col("fp").alias("b"))
    quiet = homes.join(by_shuffle(crowded), "anchor", "left_anti") if some else homes
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    links = quiet.select("anchor", F.col("fp").alias("a")).join(by_shuffle(visitors), "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    if not some:
        return links
    if threshold > 2:
        raise ValueError("crowded anchors are exact for thresholds of up to two")
    dense = replicas(fps, threshold).join(by_shuffle(crowded), "anchor", "left_semi").select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if threshold < 2:
        flips = F.array(F.lit(0).cast("long")) if threshold == 0 else flips
    ball = checkpointed(dense.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp"))
    least = checkpointed(ball.groupBy("word").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("word", "m"))
    met = ball.join(by_shuffle(least), "word").where((F.col("fp") != F.col("m")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= threshold)).select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return links.unionByName(met).distinct()


def simhash_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    different = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_fingerprints(different, threshold, hot))
    placed = checkpointed(different.join(by_shuffle(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(placed.join(by_shuffle(least), "root").select("fp", "component_id"))
    return prints.join(by_shuffle(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
