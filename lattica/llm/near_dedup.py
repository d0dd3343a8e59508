"""Near-duplicate removal on word shingles, with SimHash candidates and an exact test.

Two documents are near copies if the sets of their five-word shingles have a Jaccard similarity of at
least 0.8. At that similarity fingerprints of whole documents differ in about ten bits, beyond any
threshold that a covering code can serve. Candidates therefore come from fingerprints of whole
documents within two bits, through anchors, and from fingerprints of small min-wise samples of the
shingles, of which near copies share most: a table's samples agree for half of the pairs at 0.8, so
one of the tables finds a pair with a chance of over 0.999.

Those tables only find most links cheaply: whoever shares a table's bucket is tested against the bucket's
least document. An exact join decides the rest: two sets at the threshold share one of the first shingles
of any common order, as many as the threshold leaves room to miss. Documents of different groups that
share such a shingle are compared: in pairs where they are few, else by the same join among themselves,
in the order of how frequent shingles are among just them. Common shingles come last in the order, as
counted over all documents; the counts have no say in what is found. Before the sets of a pair meet, parities of how many
shingles fall into each of some buckets do: each shingle that one set alone has turns one parity over, so
pairs with more different parities than the threshold allows different shingles go without a loss.

Cases: null text is empty and equal to other texts without words; rows with one id are one document, near
to whatever one of them is near to; a null doc_id is left alone; texts of any length are read whole; an empty table
gives an empty result; columns pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_IDS, SLICE, each_slice, id_and_text, only_ids
from lattica.llm.components import FEWER, components
from lattica.llm.meeting import Part, flat_lists, heads, meet, unique_pairs
from lattica.llm.simhash import SEED, fingerprint, near_fingerprints, shingle_hashes, signed
from lattica.session import checkpointed, free_shuffles, rest_executors, written

WORDS, SIMILARITY = 5, 0.8
#: Sampled fingerprints a document, and shingles in a sample.
TABLES, SAMPLE = 12, 3
#: Documents that share a shingle up to which their pairs are joined; more are compared in one task a block.
SMALL = 64
#: Documents of one pack that share a shingle up to which the shingle sends them one by one; else it is crowded.
IN_PACK = 16
#: Shingles in a block of a crowded shingle's documents; each two blocks are compared in one task.
BLOCK = 1_000_000
#: Documents that a shingle which isn't common may be in, and how many of the most common ones are remembered.
RARE, COMMON = 8, 131_072
#: Characters of text for a shingle, about.
WORD = 6


def multipliers(tables: int) -> np.ndarray:
    """Odd numbers that reorder hashes, one order a table."""
    return np.random.default_rng(SEED).integers(1 << 62, size=tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_prints(hashes: np.ndarray, factors: np.ndarray, sample: int = SAMPLE) -> list[int]:
    """SimHash of the ``sample`` shingles that come first in each table's order."""
    if len(hashes) <= sample:
        return [signed(fingerprint(hashes))] * len(factors)
    ranked = hashes[None, :] * factors[:, None]
    first = np.argpartition(ranked, sample - 1, axis=1)[:, :sample]
    chosen = hashes[first]
    bits = np.unpackbits(chosen.view(np.uint8).reshape(len(factors), sample, 8), axis=2, bitorder="little").sum(1)
    return np.packbits(bits * 2 > sample, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def short_hashes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _repeats(table: pa.Table) -> list[Part]:
    """Shingles that one of some documents has, and those that several have with how many."""
    s, n = np.unique(flat_lists(table.column("shingles"))[1].astype(np.uint32), return_counts=True)
    once = n == 1
    return [(s[once].astype(np.uint64), [s[once]]), (s[~once].astype(np.uint64), [s[~once], n[~once].astype(np.int32)])]


def _frequent(columns: list[np.ndarray], rare: int) -> list[np.ndarray]:
    """Shingles of one bucket that more than ``rare`` documents have, and how many."""
    once, more, times = columns
    s, n = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), times])
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    at = np.flatnonzero(heads(s))
    if not len(at):
        return [s, n]
    s, n = s[at], np.add.reduceat(n, at)
    return [s[n > rare], n[n > rare]]


def common_shingles(docs: DataFrame, words: int = WORDS, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted 32-bit hashes) that more than ``rare`` documents have, and how many. Orders shingles only.

    All documents are counted: what a sample of a fixed size takes for rare grows with the table, and the
    pairs that meet at such shingles with its square.
    """

    def read(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, SLICE):
            texts = batch.column(1).slice(at, SLICE).to_pylist()
            yield pa.record_batch({"shingles": pa.array([np.unique(short_hashes(shingle_hashes(t, words))) for t in texts], pa.list_(pa.uint32()))})

    rows = id_and_text(docs.where(F.col("doc_id").isNotNull()))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    counts = meet(rows, "shingles", letters // WORD, ["<u4", "<u4", "<i4"], _repeats, lambda columns: _frequent(columns, rare), "s long, n long", read)
    most = counts.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    shingles, n = most.column("s").to_numpy().astype(np.uint32), most.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


#: What documents without words share in place of a shingle.
NOTHING = np.zeros(1, np.uint64)


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of ``own`` (sorted), rarest first, of which any set that is similar enough has one."""
    if not len(own):
        return NOTHING
    first = room(len(own), similarity)
    shingles, n = common
    if not len(shingles):
        return own[:first]
    short = short_hashes(own)
    at = np.minimum(np.searchsorted(shingles, short), len(shingles) - 1)
    return own[np.argsort(np.where(shingles[at] == short, n[at], 0), kind="stable")[:first]]


def room(size: int, similarity: float) -> int:
    """Shingles from the first on, of a set of ``size``, one of which a similar enough set must have."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls into each bucket, as bits; two buckets a hash or more."""
    size = max(256, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, tables: int = TABLES, sample: int = SAMPLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, whole (fingerprint), keys (sampled fingerprints), n and parity, shingles (sorted 32-bit hashes), first (prefix)."""
    common = common_shingles(docs, words)
    free_shuffles(docs.sparkSession)

    def make():
        factors = multipliers(tables)

        def of(texts: list[str]) -> list[tuple]:
            out = []
            for t in texts:
                hashes = shingle_hashes(t, words)
                own = np.unique(hashes)
                short = np.unique(short_hashes(own)).view(np.int32)
                out.append((signed(fingerprint(hashes)), sampled_prints(own, factors, sample), len(own), parities(own), short, prefix(own, common, similarity).view(np.int64)))
            return out

        return of

    return each_slice(docs.where(F.col("doc_id").isNotNull()), make, "whole long, keys array<long>, n long, parity array<long>, shingles array<int>, first array<long>")


def _may_be_similar(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities differ no more than those of similar enough sets can."""

    def side(i: str) -> DataFrame:
        return sketched.select(F.col("doc_id").alias(i), F.col("n").alias(f"n_{i}"), F.col("parity").alias(f"p_{i}"))

    def folded(p: str, q: str) -> Column:
        """As many buckets as the other has, where it has half as many."""
        half = F.size(q)
        return F.when(F.size(p) == 2 * half, F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(p, i).bitwiseXOR(F.get(p, i + half)))).otherwise(F.col(p))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", folded("p_a", "p_b").alias("p"), folded("p_b", "p_a").alias("q"))
    differ = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-6)
    sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    return both.where(sized & ((F.size("p") != F.size("q")) | (differ <= most))).select("a", "b")


def similar(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. ``pairs`` must be durable."""
    pairs = checkpointed(_may_be_similar(pairs, sketched, similarity).distinct(), FEWER)
    ids = checkpointed(pairs.select(F.col("a").alias("__id")).unionByName(pairs.select(F.col("b").alias("__id"))).distinct(), FEWER)
    sets = only_ids(sketched.select("doc_id", "shingles"), ids, keep=True)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where((common >= similarity * union) | (union == 0)).select("a", "b")


def _stars(table: pa.Table) -> list[Part]:
    """Of each key among some documents the least one, and the pairs of that one with the others."""
    lengths, keys = flat_lists(table.column("keys"))
    docs = np.repeat(table.column("doc_id").to_numpy(), lengths)
    key, least, a, b = _star(keys, docs)
    return [(key, [key, least]), (b, [a, b])]


def _star(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = heads(keys)
    least = docs[new][np.cumsum(new) - 1]
    others = docs != least
    return keys[new], docs[new], *unique_pairs(least[others], docs[others])


def first_pairs(sketched: DataFrame) -> DataFrame:
    """Pairs (a, b) to test: of near fingerprints through anchors, and of those that share a sample, by stars.

    A sample's documents are linked to the least of their task, and these to the least of all.
    """
    whole = checkpointed(sketched.groupBy("whole").agg(F.min("doc_id").alias("least")))
    near = near_fingerprints(whole.select(F.col("whole").alias("fp")))
    ends = near.join(whole.select(F.col("whole").alias("a"), F.col("least").alias("la")), "a").join(whole.select(F.col("whole").alias("b"), F.col("least").alias("lb")), "b")
    across = ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    buckets = F.transform(F.concat(F.array("whole"), "keys"), lambda key, table: F.xxhash64(table, key))

    def decide(columns: list[np.ndarray]) -> list[np.ndarray]:
        keys, docs, a, b = columns
        _, _, more_a, more_b = _star(keys, docs)
        return unique_pairs(np.concatenate([a, more_a]), np.concatenate([b, more_b]))

    entries = sketched.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    within = meet(sketched.select("doc_id", buckets.alias("keys")), "keys", entries, ["<i8"] * 4, _stars, decide, "a long, b long")
    return across.unionByName(within).distinct()


def linked_groups(sketched: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(node, root) of the groups that the links between near copies make, from durable sketches."""
    spark = sketched.sparkSession
    rest_executors(spark)
    pairs = checkpointed(first_pairs(sketched), FEWER)
    free_shuffles(spark)
    rest_executors(spark)
    known = checkpointed(similar(pairs, sketched, similarity), FEWER)
    roots = checkpointed(components(known), FEWER)
    rest_executors(spark)
    more = checkpointed(_missing(sketched, roots, pairs, small, similarity), FEWER)
    del pairs, known
    free_shuffles(spark)
    if more.isEmpty():
        return roots
    # Links between groups join their roots; whoever has none yet is its own.
    named = lambda i: roots.select(F.col("node").alias(i), F.col("root").alias(f"root_{i}"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = checkpointed(components(ends), FEWER).select(F.col("node").alias("old"), F.col("root").alias("new"))
    before = roots.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    return before.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).distinct()


def _missing(sketched: DataFrame, roots: DataFrame, tested: DataFrame, small: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all groups (``roots``) which have near copies in each other.

    Documents meet at the shingles of their prefixes. A shingle within one group is left at once, and so
    is a pair if what follows its place in both prefixes is too little to reach the threshold. A shingle of
    more than ``small`` documents, or of more than some in one pack, is crowded: its documents stay where
    they are, and only their number, their sizes and a sum of their ids are gathered.
    """
    in_pack = min(IN_PACK, small)

    def pack(table: pa.Table) -> list[Part]:
        return packed_prefixes(table, in_pack)

    def decide(columns: list[np.ndarray]) -> list[np.ndarray]:
        return met_prefixes(columns, small, similarity)

    named = roots.withColumnRenamed("node", "doc_id")
    rooted = sketched.select("doc_id", "first", "n").join(F.broadcast(named) if roots.count() <= BROADCAST_IDS else named, "doc_id", "left")
    rooted = rooted.select("doc_id", F.coalesce("root", "doc_id").alias("root"), "n", "first")
    entries = sketched.agg(F.sum(F.col("n") * (1 - similarity) + 1)).first()[0] or 0
    met = checkpointed(meet(rooted, "first", int(entries), PREFIX_KINDS, pack, decide, "a long, b long, docs long, size long, who long"))
    pairs = met.where(F.col("docs") == 0).select("a", "b").distinct()
    new = checkpointed(pairs.join(tested, ["a", "b"], "left_anti"), FEWER)
    free_shuffles(sketched.sparkSession)
    links = checkpointed(similar(new, sketched, similarity), FEWER)
    free_shuffles(sketched.sparkSession)
    # Shingles that stand side by side have the same documents: one of them stands for all.
    once = checkpointed(met.where(F.col("docs") > 0).groupBy("docs", "size", "who").agg(F.min("a").alias("s")).select("s", "size"), FEWER)
    return links if once.isEmpty() else links.unionByName(_among_crowds(rooted, once, sketched, similarity)).distinct()


#: Types of packed prefixes: shingle, document, root, n and place of single ones; shingle, documents, sum of
#: n, sum of ids, least and greatest root of crowds.
PREFIX_KINDS = ["<i8", "<i8", "<i8", "<i4", "<i4", *["<i8"] * 6]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Ids spread over 64 bits, so that their exclusive or tells sets of documents apart."""
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _crowds(s: np.ndarray, docs: np.ndarray, size: np.ndarray, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Figures of each shingle, of entries sorted by shingle."""
    at = np.flatnonzero(heads(s))
    if not len(at):
        return [s, docs, size, who, lo, hi]
    return [s[at], np.add.reduceat(docs, at), np.add.reduceat(size, at), np.bitwise_xor.reduceat(who, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)]


def packed_prefixes(table: pa.Table, in_pack: int) -> list[Part]:
    """Entries of some documents' prefixes, singly, and crowds of shingles that more than ``in_pack`` have."""
    lengths, s = flat_lists(table.column("first"))
    doc, root, n = (np.repeat(table.column(c).to_numpy(), lengths) for c in ("doc_id", "root", "n"))
    place = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(s, kind="stable")
    s, doc, root, n, place = (x[order] for x in (s, doc, root, n, place))
    new = heads(s)
    times = np.diff(np.r_[np.flatnonzero(new), len(s)])
    many = np.repeat(times > in_pack, times)
    crowds = _crowds(s[many], np.ones(many.sum(), np.int64), n[many], _mixed(doc[many]), root[many], root[many])
    single = [x[~many] for x in (s, doc, root)] + [x[~many].astype(np.int32) for x in (n, place)]
    return [(single[0], single), (crowds[0], crowds)]


def met_prefixes(columns: list[np.ndarray], small: int, similarity: float) -> list[np.ndarray]:
    """Pairs (a, b, 0, 0, 0) to test, and crowds (shingle, -1, documents, sum of n, sum of ids), across roots."""
    single, crowds = columns[:5], columns[5:]
    order = np.argsort(single[0], kind="stable")
    s, doc, root, n, place = (x[order] for x in single)
    n, place = n.astype(np.int64), place.astype(np.int64)
    times = np.diff(np.r_[np.flatnonzero(heads(s)), len(s)])
    many = np.repeat(times > small, times) | np.isin(s, crowds[0])
    more = [s[many], np.ones(many.sum(), np.int64), n[many], _mixed(doc[many]), root[many], root[many]]
    both = [np.concatenate(x) for x in zip(crowds, more, strict=True)]
    order = np.argsort(both[0], kind="stable")
    crowd, docs, size, who, lo, hi = _crowds(*[x[order] for x in both])
    apart = lo != hi
    again = np.repeat(times > 1, times) & ~many
    s, doc, root, n, place = (x[again] for x in (s, doc, root, n, place))
    found = [np.empty((2, 0), np.int64)]
    for step in range(1, len(s)):
        i = np.flatnonzero(s[step:] == s[:-step])
        if not len(i):
            break
        j = i + step
        sized = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        left = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
        stays = sized & (doc[i] != doc[j]) & (root[i] != root[j]) & (left >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
        x, y = doc[i[stays]], doc[j[stays]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    a, b = unique_pairs(*np.concatenate(found, axis=1))
    none = np.zeros(len(a), np.int64)
    return [np.concatenate([x, y[apart]]) for x, y in zip((a, b, none, none, none), (crowd, np.full(len(crowd), -1), docs, size, who), strict=True)]


def _among_crowds(rooted: DataFrame, crowds: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that span what is similar within each crowded shingle's documents.

    A shingle's documents are dealt to blocks of a bounded size, and every two blocks meet in one task.
    """

    def compare(rows: pa.Table) -> pa.Table:
        ids, roots = rows.column("doc_id").to_numpy(), rows.column("root").to_numpy()
        links = spanning(ids, roots, [np.asarray(x.values) for x in rows.column("shingles")], similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    placed = rooted.select("doc_id", "root", F.explode("first").alias("s"))
    dealt = placed.join(F.broadcast(crowds) if crowds.count() <= BROADCAST_IDS else crowds, "s")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    own = checkpointed(dealt.select("s", "doc_id", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("own")), FEWER)
    ids = checkpointed(own.select(F.col("doc_id").alias("__id")).distinct(), FEWER)
    sets = only_ids(sketched.select("doc_id", "shingles"), ids, keep=True)
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = meets.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "root")
    return sided.join(sets, "doc_id").groupBy("s", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def spanning(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``ids`` with similar enough sets that connect all which such pairs between roots connect.

    Sets are taken by size. Each looks its prefix up, in the order of how many of these sets have a
    shingle, and is compared with those found that are in other groups by then.
    """
    sizes = np.array([len(x) for x in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = place[np.lexsort((place, times[place], owner))]
    end = np.cumsum(sizes)
    start = end - sizes
    alone = np.bincount(owner, times[place] == 1, len(sets)).astype(int)
    group = roots.copy()
    out: list[tuple[int, int]] = []
    holds: dict[int, list[int]] = {}
    mark = np.zeros(len(values), bool)
    for x in np.argsort(sizes, kind="stable").tolist():
        size = int(sizes[x])
        keys = place[start[x] + alone[x] : start[x] + room(size, similarity)].tolist() if size else [-1]
        lists = [holds.setdefault(k, []) for k in keys]
        near = np.array(list(set().union(*lists)), np.int64)
        near = np.sort(near[(sizes[near] >= similarity * size - 1e-9) & (group[near] != group[x])])
        if len(near):
            mark[place[start[x] : end[x]]] = True
            for begin in range(0, len(near), 512):
                some = near[begin : begin + 512]
                first = np.cumsum(sizes[some]) - sizes[some]
                flat = np.repeat(start[some] - first, sizes[some]) + np.arange(sizes[some].sum())
                both = np.add.reduceat(mark[place[flat]], first, dtype=np.int64) if size else np.zeros(len(some), int)
                for y in some[both >= similarity * (size + sizes[some] - both)].tolist():
                    if group[x] != group[y]:
                        group[group == group[y]] = group[x]
                        out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            mark[place[start[x] : end[x]]] = False
        for at in lists:
            at.append(x)
    return out


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, tables: int = TABLES, small: int = SMALL) -> DataFrame:
    """(node, root) for each document that has a near copy; root is the least id of its group."""
    return linked_groups(written(sketches(docs, words, tables, similarity=similarity), "sketches"), similarity, small)


def keep_representatives(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those that have a near copy of smaller id in their group."""
    found = groups(docs, words, similarity)
    return only_ids(docs, checkpointed(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("__id"))), keep=False)
