"""Exact, near and repeated-string removal against brute force."""

import hashlib
import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import components as components_module
from lattica.llm import exact_dedup, near_dedup, simhash, suffix_dedup
from lattica.llm.components import components
from lattica.llm.suffix_array import permuted_prefixes, suffix_arrays

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "k", "f") for i, t in rows], "doc_id long, text string, keep_id int, kept string, fp string")


# -- exact ------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [None, lambda c: F.lit("same")])
def test_exact_against_brute_force(spark, digest):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "A", "Äb", "äb", "", None, "b" * 60_000, "B" * 60_000])) for i in range(200)]
    norm = {i: (t or "").translate(LOWER) for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(5), salts=3, digest=digest).collect()
    assert {tuple(r) for r in got} == {(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert len(got) == 200


def test_exact_edges(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "y2")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert len(got) == 5 and {r.group_size for r in got if r.keep_id == 1} == {3}
    kept = [tuple(r)[:2] for r in exact_dedup.keep_one(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "x"), (None, "y"), (2, "y2")], key=str)
    assert exact_dedup.keep_one(table(spark, [])).count() == 0
    assert exact_dedup.keep_one(table(spark, rows)).columns == table(spark, rows).columns


def test_each_row_gets_its_own_decision(spark):
    rows = [(5, "x"), (9, "x"), (5, "only here"), (None, None), (None, ""), (7, "q"), (7, "Q"), (3, "q")]
    kept = [tuple(r)[:2] for r in exact_dedup.keep_one(table(spark, rows)).collect()]
    assert {i for i, _ in kept} == {9, 5, 7, None} and len(kept) == 4 and (5, "only here") in kept


def test_hot_texts_are_salted(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"t{i % 30}") for i in range(300)]
    alone, crowd = exact_dedup._decided(table(spark, rows).repartition(6), 4, None, rows_a_salt=7)
    assert alone.count() == 0 and crowd.count() == 300
    assert {(r.norm, r.keep_id, r.group_size) for r in crowd.collect()} == {("hot", 299, 200), *((f"t{k}", 270 + k, 10) for k in range(0, 30, 3))}


# -- SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_covering_code():
    found, begin, weight = simhash.patterns(3)
    assert len(found) == 2048 and (np.diff(begin) == 1).all()
    rng = np.random.default_rng(1)
    for value in rng.integers(-(1 << 63), (1 << 63) - 1, size=40):
        owner, anchor, home = simhash.anchors(np.array([value]))
        assert home.sum() == 1 and len(set(anchor.tolist())) == len(anchor)
        for bits in [(), (0,), (63,), (22, 23), (5, 9), (30, 31), (1, 60)]:
            near = value
            for b in bits:
                near = np.int64(np.uint64(near) ^ np.uint64(1 << b))
            assert anchor[home][0] in set(simhash.anchors(np.array([near]))[1].tolist())


@pytest.mark.parametrize("hot", [128, 1])
def test_near_fingerprints(spark, hot):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    values = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for s in seeds for _ in range(25)}
    signed = [simhash.signed(v % (1 << 64)) for v in values]
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot)
    got = {r.node: r.root for r in components(links).collect()}
    unsigned = {v % (1 << 64) for v in signed}
    want = plain_components(sorted(unsigned))
    classes = {}
    for v in unsigned:
        classes.setdefault(want[v], set()).add(simhash.signed(v))
    mine = {}
    for v in signed:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_no_side_of_a_simhash_join_is_broadcast(spark, monkeypatch):
    ran = []

    def seen(df, *more, cut):
        out = cut(df, *more)
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for module in (simhash, components_module):
        monkeypatch.setattr(module, "checkpointed", partial(seen, cut=module.checkpointed))
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(i, text + f" {i % 7}") for i in range(40)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for hot in (1000, 0):
            out = simhash.simhash_components(table(spark, rows), hot=hot)
            assert out.count() == 40
            ran.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum("SortMergeJoin" in plan for plan in ran) > 8 and not any("BroadcastHashJoin" in plan for plan in ran)


def test_simhash_query(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "é", "delta\x1cx", "z"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(200, None), (201, " \t\n"), (202, "word " * 30_000)]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = plain_components(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {tuple(r) for r in simhash.simhash_components(table(spark, rows)).collect()}
    assert got == {(i, f"{p:016x}", least[root[p]]) for i, p in prints.items()}
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    root = {v: v for e in edges for v in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if v in linked}


# -- near copies ------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").translate(LOWER).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(len(rows) + k, " ".join(edited(rng, base, rng.randint(0, 3)))) for k in range(6)]
    rows += [(len(rows) + k, " ".join(f"u{rng.randrange(5000)}" for _ in range(150))) for k in range(40)]
    rows += [(900, None), (901, ""), (None, "some text")]
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for small in (8, 2):
        got = {r.node: r.root for r in near_dedup.groups(table(spark, rows), small=small).collect()}
        assert {i: got.get(i, i) for i in sets} == root
    kept = near_dedup.keep_representatives(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in root.items() if i == r} | {None}
    assert kept.columns == table(spark, rows).columns
    assert near_dedup.keep_representatives(table(spark, [])).count() == 0


def test_star_of_near_copies(spark):
    """Copies that are near the original only, which has the largest id: all are one group."""
    rng = random.Random(12)
    base, places = [f"w{k}" for k in range(200)], set()
    while len(places) < 300:
        places.add(tuple(sorted(rng.sample(range(4, 196, 5), 4))))
    rows = [(i, " ".join(f"c{i}x{k}" if k in at else w for k, w in enumerate(base))) for i, at in enumerate(sorted(places))]
    rows.append((1000, " ".join(base)))
    sets = [shingle_set(t) for _, t in rows]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert all(near(x, sets[-1]) for x in sets) and not any(near(x, y) for k, x in enumerate(sets[:-1]) for y in sets[:k])
    assert {(r.node, r.root) for r in near_dedup.groups(table(spark, rows)).collect()} == {(i, 0) for i, _ in rows}


@pytest.mark.parametrize(("small", "in_pack"), [(64, 16), (4, 2), (1, 1)])
def test_packed_prefixes_meet(small, in_pack):
    """Packs of any cut give the pairs that may be similar; what is too frequent is a crowd with its figures."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.choice([i, i // 2])), int(n), rng.choice(40, int(n) // 3 + 1, replace=False).tolist()) for i, n in enumerate(rng.integers(20, 60, 60))]
    columns = [[] for _ in near_dedup.PREFIX_KINDS]
    in_one = {}
    for at in range(0, 60, 25):
        some = rows[at : at + 25]
        table = pa.table({"doc_id": [r[0] for r in some], "root": [r[1] for r in some], "n": [r[2] for r in some], "first": pa.array([r[3] for r in some], pa.list_(pa.int64()))})
        for s in range(40):
            in_one[s] = max(in_one.get(s, 0), sum(s in r[3] for r in some))
        parts = [c for _, cs in near_dedup.packed_prefixes(table, in_pack) for c in cs]
        for held, c, kind in zip(columns, parts, near_dedup.PREFIX_KINDS, strict=True):
            held.append(np.frombuffer(c.astype(kind).tobytes(), kind))
    a, b, docs, size, _ = near_dedup.met_prefixes([np.concatenate(c) for c in columns], small, 0.8)
    owners = {s: [r for r in rows if s in r[3]] for s in range(40)}
    crowded = {s for s, own in owners.items() if len(own) > small or in_one[s] > in_pack}
    across = {s for s, own in owners.items() if len({r[1] for r in own}) > 1}
    pairs = set()
    for s in across - crowded:
        for x in owners[s]:
            for y in owners[s]:
                i, j = x[3].index(s), y[3].index(s)
                most = min(x[2] - i, y[2] - j) + min(i, j)
                if x[0] < y[0] and x[1] != y[1] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]) and most >= 0.8 / 1.8 * (x[2] + y[2]) - 1e-6:
                    pairs.add((x[0], y[0]))
    assert set(zip(a[docs == 0].tolist(), b[docs == 0].tolist(), strict=True)) == pairs and (docs == 0).sum() == len(pairs)
    assert dict(zip(a[docs > 0].tolist(), zip(docs[docs > 0].tolist(), size[docs > 0].tolist(), strict=True), strict=True)) == {s: (len(owners[s]), sum(r[2] for r in owners[s])) for s in crowded & across}
    none = near_dedup.met_prefixes([np.empty(0, k) for k in near_dedup.PREFIX_KINDS], small, 0.8)
    assert [len(x) for x in none] == [0] * 5


def test_pairs_behind_a_frequent_passage(spark):
    """Documents that share most of their words, each with one true near copy."""
    rng = random.Random(21)
    passage, rows = [f"p{k}" for k in range(400)], []
    for g in range(200):
        own = [f"d{g}x{k}" for k in range(120)]
        rows.append((2 * g, " ".join(passage + own)))
        rows.append((2 * g + 1, " ".join(passage + [f"e{g}x{k}" if k < 53 else w for k, w in enumerate(own)])))
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert all(near(sets[i], sets[i + 1]) for i in range(0, 400, 2)) and not near(sets[0], sets[2])
    assert {(r.node, r.root) for r in near_dedup.groups(table(spark, rows)).collect()} == {(i, i - i % 2) for i in range(400)}


def test_common_shingles_are_counted_over_all_documents(spark):
    """40 passages, each in 12 of 60,000 documents: a sample of a fixed size misses most of them."""
    words = F.concat_ws(" ", F.concat(F.lit("u"), "doc_id"), *[F.lit(f"w{k}") for k in range(3)])
    passage = F.concat_ws(" ", *[F.concat(F.lit(f"p{k}x"), F.col("doc_id") % 40) for k in range(6)])
    docs = spark.range(60_000).withColumnRenamed("id", "doc_id")
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 480, passage).when(F.col("doc_id") < 59_990, words).otherwise(F.lit("in ten documents only, ten")))
    shingles, n = near_dedup.common_shingles(docs.unionByName(spark.sql("select cast(null as long) doc_id, 'in ten documents only, ten' text")))
    want = {h: 12 for j in range(40) for h in near_dedup.short_hashes(simhash.shingle_hashes(" ".join(f"p{k}x{j}" for k in range(6)), 5)).tolist()}
    want |= {h: 10 for h in near_dedup.short_hashes(simhash.shingle_hashes("in ten documents only, ten", 5)).tolist()}
    assert shingles.tolist() == sorted(want) and dict(zip(shingles.tolist(), n.tolist(), strict=True)) == want
    assert [len(x) for x in near_dedup.common_shingles(table(spark, [(None, "a"), (1, None), (2, "b")]))] == [0, 0]


def test_all_documents_order_the_prefixes():
    """Shingles that are common by their upper halves come last, whatever their place among hashes."""
    own = np.arange(1, 11, dtype=np.uint64) << np.uint64(32)
    common = np.array([1, 2, 7], np.uint32), np.array([30, 20, 9])
    assert (near_dedup.prefix(own, common, 0.2) >> np.uint64(32)).tolist() == [3, 4, 5, 6, 8, 9, 10, 7, 2]


# -- repeated strings -------------------------------------------------------------------------


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        top = int(rng.integers(1, 5))
        texts = [rng.integers(1, 1 + top, size=rng.integers(0, 30)) for _ in range(rng.integers(1, 7))]
        flat = np.concatenate([np.r_[x, 0] for x in texts]).astype(np.int64)
        size = np.array([len(x) + 1 for x in texts])
        first = np.cumsum(size) - size
        sa = suffix_arrays(flat, first, size, top + 1)
        shared = permuted_prefixes(flat, sa, first)
        for b, x in enumerate(texts):
            x = [*x.tolist(), 0]
            want = sorted(range(len(x)), key=lambda i: x[i:])
            assert (sa[first[b] : first[b] + size[b]] - first[b]).tolist() == want
            for p, q in zip(want, want[1:], strict=False):
                n = 0
                while x[p + n] == x[q + n]:
                    n += 1
                assert shared[first[b] + q] == n


def plain_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at] += 1
                gone[at + 100] -= 1
            else:
                seen.add(data[at : at + 100])
        marks = np.cumsum(gone)[: len(data)] > 0
        kept = np.frombuffer(data, np.uint8)[~marks].tobytes()
        out.setdefault(i, []).append((len(data), int(marks.sum()), int((np.diff(np.r_[0, marks.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("repeated_ids", [False, True])
def test_repeats(spark, repeated_ids, monkeypatch):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcd ") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 50) :] if rng.random() < 0.8 else "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    rows += [(1000, "a" * 5000), (1001, "ab" * 3000), (1002, ""), (1003, "a" * 99), (1004, "é" * 300), (1005, None)]
    if repeated_ids:
        rows += [(5, pieces[0] + "tail"), (None, pieces[1] + pieces[2])]
    got = {}
    for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in got.items()} == plain_removal(rows)


def test_long_texts_are_cut_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, size=5000).astype(np.uint8)
    whole = suffix_dedup.segments(data)
    assert whole["windows"].sum() == 4901
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = suffix_dedup.segments(data)
    assert parts["windows"].sum() == 4901
    assert set(whole["anchor"].tolist()) <= set(parts["anchor"].tolist())


def test_crowded_groups_meet_across_shards():
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts, rows = [], np.zeros(80, suffix_dedup.SEGMENT)
    for i in range(80):
        texts.append((rng.choice("xy") * 5 + rng.choice("pq") + core + rng.choice("uv") * 20).encode())
        rows[i] = (1, i, i, 0, len(texts[-1]) - 99)
    found = suffix_dedup.repeated_windows(rows, texts)
    marks = {(int(r["doc"]), int(r["start"]) + k) for r in found for k in range(int(r["windows"]))}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                want.add((i, at))
            seen.add(t[at : at + 100])
    assert marks == want


def test_windows_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    test_repeats(spark, False, None)
    # One task finds the passage's ends crowded, the other doesn't.
    monkeypatch.setattr(suffix_dedup, "CROWD", 30)
    kinds, plain = [], suffix_dedup.written

    def seen(df, name):
        out = plain(df, name)
        kinds.extend(r.kind for r in out.select("kind").distinct().collect())
        return out

    monkeypatch.setattr(suffix_dedup, "written", seen)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(1, 4))) + passage + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 4)))) for i in range(170)]
    rng.shuffle(rows)
    parts = spark.createDataFrame([(i, t, int(n >= 150)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, part int")
    both = parts.repartitionById(2, F.col("part"))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(both).collect()}
    assert {suffix_dedup.CROWDED, suffix_dedup.WINDOW} <= set(kinds)
    assert {i: [v] for i, v in got.items()} == plain_removal(rows)


def test_no_repeats(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
