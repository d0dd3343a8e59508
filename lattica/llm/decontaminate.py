"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds: pieces of LEAST_TILE words, as short as the
least tile. The places of an item that shared seeds cover bound what any tiling can cover, so pairs below
COVERAGE by that bound are left without a loss. Of the others the longest common passages are marked,
longest first and without overlaps, by Karp-Rabin hashes whose window shrinks; a document that the marked
passages of an item cover to COVERAGE holds it, in whatever order its parts stand.

The seeds of a benchmark of up to BROADCAST_BYTES are broadcast, and documents are scanned once. Those of
a larger one meet the documents' seeds in a shuffle, and again documents are scanned once for seeds and
once for the pairs found. Nothing about documents is gathered.

Cases: null text is empty; items of fewer words than a tile are held where they occur as a whole; items
without words match nothing; repeated items and repeated documents are found each; texts of any length are
read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SLICE, _arrow_schema, documents, id_and_text, only_rows, row_key
from lattica.session import checkpointed, ship_package

#: Least words of a tile, which are a seed's words too, and share of an item that must be covered.
LEAST_TILE, COVERAGE = 3, 0.7
#: Bytes of benchmark text up to which its seeds are broadcast.
BROADCAST_BYTES = 8 << 20
#: Places of items that seeds of some documents may hit before their shares are counted.
HITS = 1 << 20
#: Pairs of places of an item and of a document that may be compared at a time.
PAIRS = 2 << 20
#: Remembered words of a task.
REMEMBERED = 150_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the lower-case words."""
    words = _WORD.findall(text.lower())
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Powers(dict):
    def __missing__(self, size: int) -> np.uint64:
        value = np.uint64(pow(int(_BASE), size, 1 << 64))
        self[size] = value
        return value


def rolling(tokens: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes: Σ token[i + j] · base^(size - 1 - j)."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    out, width = tokens, 1
    for bit in bin(size)[3:]:
        n = len(tokens) - 2 * width + 1
        out, width = out[:n] * _POWERS[width] + out[width : width + n], 2 * width
        if bit == "1":
            n = len(tokens) - width
            out, width = out[:n] * _BASE + tokens[width : width + n], width + 1
    return out


_POWERS = _Powers()


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the greedy tiling: longest first, then leftmost."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    size = 1 << max(len(item).bit_length() - 1, 0)
    while True:
        size = max(size, least)
        heap = [(-n, i, j) for i, j, n in _common_runs(item, doc, free_item, free_doc, size)]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            open_ = free_item[i : i - n] & free_doc[j : j - n]
            if open_.all():
                tiles.append((i, j, -n))
                free_item[i : i - n] = free_doc[j : j - n] = False
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, open_, False].astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= size:
                    heapq.heappush(heap, (s - e, i + s, j + s))
        if size <= least:
            return tiles
        size //= 2


def _common_runs(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Maximal equal runs of at least ``size`` unmarked tokens.

    A long document is taken in blocks that overlap by the item's length, as no run is longer.
    """
    block = max(len(item), PAIRS // max(len(item), 1))
    for begin in range(0, len(doc), block):
        stop = begin + block + len(item)
        for i, j, n in _runs_in(item, doc[begin:stop], free_item, free_doc[begin:stop], size):
            j += begin
            # A run that goes back beyond the block, or starts behind it, belongs to a neighbour.
            cut = begin and j == begin and i and item[i - 1] == doc[j - 1] and free_item[i - 1] and free_doc[j - 1]
            if not cut and j < begin + block:
                yield i, j, n


def _runs_in(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    x, y = rolling(item, size), rolling(doc, size)
    if not len(x) or not len(y):
        return
    gap = lambda free: np.concatenate([[0], np.cumsum(~free)])
    gx, gy = gap(free_item), gap(free_doc)
    px = np.flatnonzero(gx[size:] == gx[:-size])
    py = np.flatnonzero((gy[size:] == gy[:-size]) & np.isin(y, x[px]))
    if not len(px) or not len(py):
        return
    order = py[np.argsort(y[py], kind="stable")]
    low, high = np.searchsorted(y[order], x[px], "left"), np.searchsorted(y[order], x[px], "right")
    n = high - low
    i = np.repeat(px, n)
    j = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    # Consecutive places on a diagonal make one run.
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
        a, b, length = int(i[s]), int(j[s]), e - s + size - 1
        if np.array_equal(item[a : a + length], doc[b : b + length]):
            yield a, b, length


class Index:
    """Benchmark items with their seeds in sorted order; places count through all items."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = COVERAGE):
        known: dict[str, int] = {}
        self.items = [(i, t) for i, t in ((i, token_hashes(t or "", known)) for i, t in items) if len(t)]
        self.coverage = coverage
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(LEAST_TILE, n) for n in self.size.tolist()}:
            chosen = [at for at, n in enumerate(self.size.tolist()) if min(LEAST_TILE, n) == width]
            hashes = np.concatenate([rolling(self.items[at][1], width) for at in chosen])
            places = np.concatenate([self.first[at] + np.arange(self.size[at] - width + 1) for at in chosen])
            order = np.argsort(hashes, kind="stable")
            different, begin = np.unique(hashes[order], return_index=True)
            self.seeds[width] = different, np.r_[begin, len(hashes)], places[order]

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(number of the document, number of the item) where shared seeds cover enough of the item."""
        out = []
        for width, (different, begin, places) in self.seeds.items():
            hit_doc, hit_seed = [], []
            for d, tokens in enumerate(docs):
                mine = rolling(tokens, width)
                at = np.searchsorted(different, mine)
                at[at == len(different)] = 0
                seeds = np.unique(at[different[at] == mine])
                hit_doc.append(np.full(len(seeds), d))
                hit_seed.append(seeds)
            doc, seed = np.concatenate(hit_doc), np.concatenate(hit_seed)
            count = begin[seed + 1] - begin[seed]
            # Some documents at a time, whole ones: a document hits each place at most once.
            ends, total, low = np.searchsorted(doc, np.arange(len(docs)), "right"), np.cumsum(count), 0
            while low < len(doc):
                reach = np.searchsorted(total, (total[low - 1] if low else 0) + HITS, "right")
                high = max(ends[ends <= reach].max(initial=0), ends[doc[low]])
                out += self._covered(doc[low:high], seed[low:high], count[low:high], begin, places, width)
                low = high
        return sorted(out)

    def _covered(self, doc: np.ndarray, seed: np.ndarray, count: np.ndarray, begin: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int]]:
        at = np.repeat(begin[seed] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        whole = int(self.size.sum())
        start = np.repeat(doc, count) * whole + places[at]
        covered = np.unique((start[:, None] + np.arange(width)).ravel())
        item = np.searchsorted(self.first, covered % whole, "right") - 1
        pair, n = np.unique(covered // whole * len(self.items) + item, return_counts=True)
        pair = pair[n >= self.coverage * self.size[pair % len(self.items)] - 1e-9]
        return list(zip((pair // len(self.items)).tolist(), (pair % len(self.items)).tolist(), strict=True))


def held(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """(share of the item that tiles cover, tiles, longest tile)."""
    tiles = tile(item, doc, min(LEAST_TILE, len(item)))
    sizes = [n for _, _, n in tiles]
    return sum(sizes) / len(item), len(sizes), max(sizes, default=0)


def benchmark_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_FOUND = "doc_id long, row_key long, item_id long, coverage double, n_tiles long, longest long"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As contaminated, with the row's key (see common.row_key)."""
    items = benchmark_rows(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key(docs).alias("row_key"))
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > broadcast_bytes:
        return _leaks_by_shuffle(rows, items, coverage)
    arrow = _arrow_schema(docs.sparkSession, _FOUND)
    ship_package(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], coverage))  # bounded above

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                if len(known) > REMEMBERED:
                    known.clear()
                part = batch.slice(at, SLICE)
                ids, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
                tokens = [token_hashes(t, known) for t in part.column(1).to_pylist()]
                found = []
                for d, i in index.value.candidates(tokens):
                    item_id, item = index.value.items[i]
                    covered, n, longest = held(item, tokens[d])
                    if covered >= coverage:
                        found.append((ids[d], keys[d], item_id, covered, n, longest))
                if found:
                    yield _batch(found, arrow)

    return rows.mapInArrow(scan, _FOUND)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _seeds(rows: DataFrame, key: str, places: bool) -> DataFrame:
    """(key, size, width, seed, places) for each different seed of each text: of an item, or of a document's all widths."""
    schema = f"{key} long, size long, width int, seed long, places array<long>"
    arrow = _arrow_schema(rows.sparkSession, schema)
    ship_package(rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) > REMEMBERED:
                    known.clear()
                tokens = token_hashes(text, known)
                out = []
                for width in (min(LEAST_TILE, len(tokens)),) if places else range(1, LEAST_TILE + 1):
                    seeds = rolling(tokens, width) if width else tokens
                    if not places:
                        out += [(k, len(tokens), width, s, []) for s in np.unique(seeds).view(np.int64).tolist()]
                        continue
                    order = np.argsort(seeds, kind="stable")
                    edge = np.flatnonzero(np.r_[True, np.diff(seeds[order]) != 0, True]) if len(seeds) else np.zeros(1, int)
                    out += [(k, len(tokens), width, int(seeds[order[a]].view(np.int64)), order[a:b].tolist()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                if out:
                    yield _batch(out, arrow)

    return rows.mapInArrow(cut, schema)


def _leaks_by_shuffle(rows: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """Seeds of documents and items meet by hash; candidates then meet their texts. Equal texts are one key."""
    numbered = checkpointed(items.groupBy("text").agg(F.collect_list("item_id").alias("ids")).select(F.xxhash64("text").alias("item"), "text", "ids"))
    item_seeds = checkpointed(_seeds(numbered.select("item", "text"), "item", True))
    widths = [r.width for r in item_seeds.select("width").distinct().collect()]
    doc_seeds = _seeds(rows.select("row_key", "text").dropDuplicates(["row_key"]), "row_key", False).where(F.col("width").isin(widths)).select("row_key", "width", "seed")
    met = doc_seeds.join(item_seeds, ["width", "seed"]).groupBy("row_key", "item", "size", "width").agg(F.flatten(F.collect_list("places")).alias("at"))
    reached = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    pairs = checkpointed(met.where(reached >= F.lit(coverage) * F.col("size") - 1e-9).select("row_key", "item"))
    both = rows.join(pairs, "row_key").join(numbered.select("item", F.col("text").alias("item_text"), "ids"), "item")
    schema = _FOUND.replace("item_id long", "ids array<long>")
    arrow = _arrow_schema(rows.sparkSession, schema)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                known: dict[str, int] = {}
                found = []
                for r in batch.slice(at, SLICE).to_pylist():
                    covered, n, longest = held(token_hashes(r["item_text"], known), token_hashes(r["text"], known))
                    if covered >= coverage:
                        found.append((r["doc_id"], r["row_key"], r["ids"], covered, n, longest))
                if found:
                    yield _batch(found, arrow)

    tested = both.select("doc_id", "row_key", "text", "item_text", "ids").mapInArrow(test, schema)
    return tested.select("doc_id", "row_key", F.explode("ids").alias("item_id"), "coverage", "n_tiles", "longest")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest for each pair that reaches ``coverage``."""
    return leaks(docs, benchmark, coverage, broadcast_bytes).drop("row_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Items of fewer words than a tile take no document away: a single word would take most.
    """
    long = benchmark.where(F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"(?U)\w+")) >= LEAST_TILE)
    found = leaks(docs, long, coverage).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    return only_rows(docs, checkpointed(found), keep=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
