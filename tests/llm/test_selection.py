"""Decontamination, classification, mixing and the pipeline."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from lattica.llm import decontaminate, mixing, quality, registry
from lattica.llm.decontaminate import rolling, tile

TABLES = "documents benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = con.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_whole_results(spark, small, name):
    n = registry.QUERIES[name](spark, small).count()
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert n == docs if name not in ("op2_chat_format", "op6_decontaminate", "op8_mix_sources") else n > 0


# -- tiling -----------------------------------------------------------------------------------


def plain_tiling(item, doc, least):
    free_item, free_doc, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_item[i + k] and free_doc[j + k]:
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return tiles
        k, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, k))
        free_item[i : i + k] = free_doc[j : j + k] = [False] * k


@pytest.mark.parametrize("pairs", [2 << 20, 1])
def test_tiling(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.choice([2, 3, 5])
        item = np.array([rng.randrange(letters) for _ in range(rng.randint(1, 14))], np.uint64)
        doc = np.array([rng.randrange(letters) for _ in range(rng.randint(0, 25))], np.uint64)
        assert sorted(tile(item, doc, 3)) == sorted(plain_tiling(item.tolist(), doc.tolist(), 3))


def test_rolling_hashes():
    x = np.arange(20, dtype=np.uint64)
    for size in range(1, 12):
        twice = rolling(np.r_[x, x], size)
        assert len(twice) == 41 - size and (twice[: 21 - size] == twice[20 : 41 - size]).all()
        assert len(set(rolling(x, size).tolist())) == 21 - size


def test_leaks(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(5)] + [(8, None), (7, "two words"), (9, "only three words"), (9, "only three words")]
    filler = lambda: " ".join(words(40))
    parts = items[1][1].split()
    docs = [
        (0, f"{filler()} {items[0][1].upper()} {filler()}"),
        (1, " ".join([filler(), *parts[15:], filler(), *parts[:15]])),  # in another order
        (2, f"{filler()} {' '.join(items[2][1].split()[:12])}"),  # less than the share
        (3, filler()), (4, None), (5, "two words: only Three, WORDS!"), (None, items[3][1]), (6, "same " * 20_000),
    ]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_BYTES, 100):
        found = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.contaminated(frame, bench, broadcast_bytes=most).collect())
        assert found == [(-1, 0), (-1, 3), (1, 1), (5, 7), (5, 9), (5, 9)] or found == [(-1, 3), (-1, 0), (1, 1), (5, 7), (5, 9), (5, 9)]
    kept = decontaminate.without_leaks(frame, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6] and kept.columns == frame.columns
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def plain_coverage(item, doc):
    tiles = plain_tiling(item, doc, min(3, len(item)))
    return sum(n for _, _, n in tiles) / len(item)


def test_reordered_pieces(spark):
    """Pieces of three and four words in any order, against all pairs of documents and items."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 24, 40]))]) for i in range(14)]
    docs = []
    for i in range(60):
        _, item = items[i % len(items)]
        size = rng.choice([3, 4])
        pieces = [item[k : k + size] for k in range(0, len(item), size)]
        rng.shuffle(pieces)
        out = []
        for piece in pieces[: rng.randint(len(pieces) // 2, len(pieces))]:
            out += piece + [word() for _ in range(rng.randint(0, 3))]
        docs.append((i % 50, out))  # some ids repeat
    docs.append((None, [w for _, t in items for w in t]))
    want = sorted((d or -1, i) for d, x in docs for i, t in items if plain_coverage(t, x) >= 0.7)
    frame = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    for most in (decontaminate.BROADCAST_BYTES, 1):
        assert sorted((r.doc_id or -1, r.item_id) for r in decontaminate.contaminated(frame, bench, broadcast_bytes=most).collect()) == want
    # Few hits at a time give the same candidates.
    index = decontaminate.Index([(i, " ".join(t)) for i, t in items])
    tokens = [decontaminate.token_hashes(" ".join(x), {}) for _, x in docs]
    whole = index.candidates(tokens)
    decontaminate.HITS, before = 1, decontaminate.HITS
    try:
        assert index.candidates(tokens) == whole
    finally:
        decontaminate.HITS = before


def test_planted_passages(spark, small):
    """Documents that hold every word of an item in one piece, found by plain search."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    flat = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if flat(i.text) in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op6_decontaminate"](spark, small).collect()}
    assert want and want <= got


# -- classification ---------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learn, test = labels.where("doc_id % 4 != 0"), labels.where("doc_id % 4 = 0")
    scored = quality.classify(docs, learn)
    assert scored.count() == docs.count()
    joined = scored.join(test, "doc_id").collect()
    right = sum((r.quality_score >= 0.5) == (r.quality == 1) for r in joined)
    assert right / len(joined) > 0.93


def test_exchange_is_no_worse(spark):
    """Held-out rows, with and without exchange; labelled rows of the test are unlabelled rows of the training."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learn, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    right = {}
    for rounds in (0, quality.ROUNDS):
        rows, model = quality.co_trained(docs, learn, rounds)
        got = quality.score(rows, model).join(test, "doc_id").collect()
        assert min(w for m in model.mix.values() for w in m[:2]) >= 0
        toxic, clean = [r for r in got if r.toxic], [r for r in got if r.quality and not r.toxic]
        right[rounds] = sum(not r.keep for r in toxic) / len(toxic), sum(r.keep for r in clean) / len(clean)
    assert right[quality.ROUNDS][0] >= right[0][0] - 0.01 and right[quality.ROUNDS][1] >= right[0][1] - 0.002
    assert right[quality.ROUNDS][0] > 0.85 and right[quality.ROUNDS][1] > 0.99


def test_sums_of_sure_rows(spark):
    """Distributed sums against plain loops, over more parts than are added up at once."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows, model = quality.co_trained(docs, labels, 0)
    got = quality.sure_sums(rows.repartition(quality.FAN + 3), model, 0.9)
    data = rows.collect()
    for (trait, learner), (there, n) in got.items():
        teacher = "page" if learner == "text" else "text"
        factor, offset = model.scale[trait, teacher]
        want, many = np.zeros_like(there), np.zeros(2)
        for r in data:
            view = model.views[trait, teacher]
            p = 1 / (1 + math.exp(-(factor * (view.weights[list(r[teacher])].sum() + view.bias) + offset)))
            if p > 0.9 or p < 0.1:
                want[int(p > 0.9), list(r[learner])] += 1
                many[int(p > 0.9)] += 1
        assert np.abs(want - there).max() <= 1 and np.abs(many - n).max() <= 1


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (None, "a b", "s", "x"), (1, "c " * 40_000, "s", "x")], "doc_id long, text string, source string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 3 and all(r.keep and r.quality_score is None for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == 3


# -- mixing -----------------------------------------------------------------------------------


def test_rates_and_distribution(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, "t") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0, "absent": 5.0})
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"}
    for n in counts.values():
        assert abs(n - 3000) < 5 * math.sqrt(3000)
    times = out.where("source = 'small'").groupBy("doc_id").count().collect()
    mean = counts["small"] / 1000
    variance = sum((r["count"] - mean) ** 2 for r in times) / 1000 + (1000 - len(times)) * mean**2 / 1000
    assert 0.8 < variance / mean < 1.2
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixing.mix(docs.repartition(7), {"big": 1.0, "small": 1.0, "absent": 5.0}).collect()}


def test_many_sources_and_high_rates(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 20}", "t", 3) for i in range(400)], "doc_id long, source string, text string, copy int")
    want = {(r.doc_id, r.mix_copy) for r in mixing.mix(docs, epochs=30.0).collect()}
    assert abs(len(want) - 12_000) < 5 * math.sqrt(12_000)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert {(r.doc_id, r.mix_copy) for r in mixing.mix(docs, epochs=30.0).collect()} == want
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_edges(spark):
    rows = [(None, None, f"t{i}", "a", 1, 2, 3, "k", "m") for i in range(300)] + [(1, "s", None, "a", 1, 2, 3, "k", "m")] * 3 + [(2, "zero", "x" * 300_000, "b", 1, 2, 3, "k", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, __source string, __parts int, __times int, __copy int, shuffle_key string, mix_shuffle_key string")
    out = mixing.mix(docs, {None: 1.0, "s": 1.0, "zero": 0.0}, epochs=2.0)
    assert out.columns == [*docs.columns, "copy", "_mix_shuffle_key"]
    got = out.collect()
    assert {r.source for r in got} <= {None, "s"}
    assert len({r._mix_shuffle_key for r in got if r.doc_id is None}) > 150  # no single key for rows without id
    same = [r.copy for r in got if r.doc_id == 1]
    assert sorted(same) == sorted([k for k in range(1, max(same) + 1)] * 3)
    assert mixing.mix(docs, {"s": -1.0}).count() == 0


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frame, before = docs, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, small)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= before
        assert out.join(frame, "doc_id", "left_anti").count() == 0
        frame, before = out, n
    final = pipeline.run(spark, small)
    assert set(docs.columns) < set(final.columns)
    assert final.join(frame, "doc_id", "left_anti").count() == 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def plain_pipeline(docs, items, kept_ids):
    """(doc_id, copy) of the whole pipeline by plain loops, given what the classifier keeps."""
    import hashlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = {d.doc_id: d for d in docs if d.doc_id in kept_ids}
    last = {}
    for i, d in sorted(rows.items()):
        last[(d.text or "").translate(lower)] = i
    rows = {i: rows[i] for i in last.values()}
    sets = {}
    for i, d in rows.items():
        words = (d.text or "").translate(lower).split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    rows = {i: d for i, d in rows.items() if root[i] == i}

    def leaks(text):
        doc = re.findall(r"\w+", text.lower())
        seen = set(zip(doc, doc[1:], doc[2:], strict=False))
        for item in items:
            words = re.findall(r"\w+", item.text.lower())
            # A tiling covers no word that is in no common piece of three words.
            if len({k + j for k in range(len(words) - 2) if tuple(words[k : k + 3]) in seen for j in range(3)}) >= 0.7 * len(words):
                number = {w: n for n, w in enumerate({*words, *doc})}
                tiles = tile(np.array([number[w] for w in words], np.uint64), np.array([number[w] for w in doc], np.uint64))
                if sum(n for _, _, n in tiles) >= 0.7 * len(words):
                    return True
        return False

    rows = {i: d for i, d in rows.items() if not leaks(d.text or "")}
    size = {}
    for d in rows.values():
        size[d.source] = size.get(d.source, 0) + 1
    whole = sum(n**0.5 for n in size.values())
    out = set()
    for i, d in rows.items():
        rate = len(rows) * size[d.source] ** 0.5 / whole / size[d.source]
        parts, times = max(1, math.ceil(rate / 8)), 0
        for j in range(parts):
            u = int(hashlib.md5(f"17:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            times += k
        out |= {(i, n) for n in range(1, times + 1)}
    return out


def test_pipeline_against_brute_force(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in pipeline.quality(spark, docs, small).collect()}
    want = plain_pipeline(docs.collect(), spark.read.parquet(f"{small}/benchmark.parquet").collect(), kept)
    assert {(r.doc_id, r.copy) for r in pipeline.run(spark, small).collect()} == want
