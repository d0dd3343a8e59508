"""Removal of repeated byte strings through suffix arrays of shards that share an anchor.

A string of LENGTH bytes has an anchor: of its GRAM-byte pieces the one with the least hash, the
leftmost of equals. Equal strings have equal anchors, so neighbouring windows with one anchor are kept
together as a segment, segments are dealt by their anchor's hash, and strings that are equal meet.

1. Map tasks cut texts into segments, combine equal ones of their own, and deal the earliest of each,
   packed as arrays. Reducers combine equal segments: all but the earliest are repeats as a whole.
2. Only where different segments share an anchor can there be further repeats. Their texts are put
   into shards, and the suffix array of each is induced (see suffix_array). Windows whose
   suffixes are neighbours with a common prefix of LENGTH bytes or more are equal; all but the
   earliest are repeats. Groups of over SHARD segments take several shards, and the windows that are
   earliest in their shard meet once more by digests.
3. Each document gets its repeats, removes their union and digests the rest.

An anchor that CROWD or more different segments of one map task share, as at the ends of a passage that
very many documents hold, would put ever more segments into one bucket. Such a task sends their
windows one by one, dealt by the windows' digests, and marks the anchor; what other tasks sent for it,
less than CROWD segments each, follows window by window in step 2.

Packed arrays travel in rows of a few hundred kB, so a task holds a bucket of bounded size, and the
number of buckets follows the number of bytes. Digests of segments and windows have 128 bits, anchor
included; equality by digest is as good as by content at any size in sight.

Cases: null text is empty; "earlier" is a smaller doc_id, or an earlier start in one document; a null
doc_id comes first; rows that share an id are documents of their own, in the order of their texts;
texts of any length are cut in blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SLICE, _arrow_schema, documents, id_and_text
from lattica.llm.suffix_array import permuted_prefixes, suffix_arrays
from lattica.session import free_shuffles, ship_package, written

LENGTH, GRAM = 100, 32
#: Windows from which an anchor is chosen.
REACH = LENGTH - GRAM + 1
#: Segments that a map task combines at once, and segments of one shard.
FLUSH, SHARD = 700_000, 24
#: Different segments with one anchor in a map task from which their windows are dealt singly.
CROWD = 256
#: Bytes of text a bucket of segments or of documents stands for, about, and letters of shards induced together.
BUCKET_BYTES, DOC_BYTES, TOGETHER = 12 << 20, 4 << 20, 1 << 20
#: Bytes of a text that are cut at a time.
BLOCK = 1 << 19

SEGMENT = np.dtype([("anchor", "u8"), ("digest", "u8"), ("doc", "i8"), ("start", "i8"), ("windows", "i4")])
REPEAT = np.dtype([("doc", "i8"), ("start", "i8"), ("windows", "i4")])


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random 64-bit values of bytes for anchors and digests; powers of an odd base and of its inverse."""
    rng = np.random.default_rng(20)
    values = rng.integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(2, 256), dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    n = BLOCK + LENGTH + 1
    powers = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))]
    return values[0], values[1], powers[0], powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which digests of any substring of ``data`` follow."""
    _, values, _, inverse = _tables()
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * inverse[: len(data)])])


def _digests(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    powers = _tables()[2]
    return _mixed((sums[end] - sums[start]) * powers[start] + (end - start).astype(np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte piece, by doubling."""
    h, width, factor = _tables()[0][data], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    return _mixed(h)


def segments(data: np.ndarray) -> np.ndarray:
    """The segments of one text: anchor, digest, start and number of windows (doc is left 0)."""
    out = []
    windows = len(data) - LENGTH + 1
    for begin in range(0, max(windows, 0), BLOCK):
        part = data[begin : min(begin + BLOCK, windows) + LENGTH - 1]
        h = gram_hashes(part)
        n = len(part) - LENGTH + 1
        # The place in the low bits makes the leftmost of equal hashes the least.
        best = h & ~np.uint64((1 << 20) - 1) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= REACH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = np.minimum(best[:n], best[REACH - width : REACH - width + n])
        place = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[start, n])
        rows = np.zeros(len(start), SEGMENT)
        rows["anchor"], rows["start"], rows["windows"] = h[place[start]], start + begin, count
        rows["digest"] = _digests(_sums(part), start, start + count + LENGTH - 1)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, SEGMENT)


def earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of each class of equal segments by anchor and digest, the others)."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["digest"], rows["anchor"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1])
    return rows[first], rows[~first]


def as_repeats(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), REPEAT)
    for c in REPEAT.names:
        out[c] = rows[c]
    return out


def repeated_windows(rows: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Repeats among different segments of the same anchors (sorted by anchor), as runs of windows."""
    found = []
    bounds = np.flatnonzero(np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1], True]) if len(rows) else np.zeros(1, int)
    shards, split = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > SHARD:
            split.append((a, b))
        shards += [(i, min(i + SHARD, b)) for i in range(a, b, SHARD)]
    weight = lambda s: sum(len(texts[i]) + 1 for i in range(*s))
    shards = sorted(((weight(s), s) for s in shards if s[1] - s[0] > 1), reverse=True)
    later = [np.zeros(n, bool) for n in rows["windows"].tolist()]
    at = 0
    while at < len(shards):
        total, end = 0, at
        while end < len(shards) and (end == at or total + shards[end][0] <= TOGETHER):
            total += shards[end][0]
            end += 1
        _mark_shards([s for _, s in shards[at:end]], rows, texts, later)
        at = end
    for a, b in split:
        _mark_across(range(a, b), rows, texts, later)
    for i, marks in enumerate(later):
        if marks.any():
            edge = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
            runs = np.zeros(len(edge) // 2, REPEAT)
            runs["doc"], runs["start"], runs["windows"] = rows["doc"][i], rows["start"][i] + edge[::2], edge[1::2] - edge[::2]
            found.append(runs)
    return np.concatenate(found) if found else np.zeros(0, REPEAT)


def _mark_shards(shards: list[tuple[int, int]], rows: np.ndarray, texts: list[bytes], later: list[np.ndarray]) -> None:
    """Each shard is a lane: its segments with end marks of their own, then the lane's end."""
    pieces, size, owner, begin = [], [], [], []
    at = 0
    for a, b in shards:
        lane = 0
        for k, i in enumerate(range(a, b)):
            letters = np.frombuffer(texts[i], np.uint8).astype(np.int64) + SHARD + 1
            pieces += [letters, np.array([k + 1])]
            owner.append(i)
            begin.append(at + lane)
            lane += len(letters) + 1
        pieces.append(np.zeros(1, np.int64))
        size.append(lane + 1)
        at += lane + 1
    text = np.concatenate(pieces)
    lane_size = np.array(size)
    lane_first = np.cumsum(lane_size) - lane_size
    sa = suffix_arrays(text, lane_first, lane_size, 256 + SHARD + 1)
    prefix = permuted_prefixes(text, sa, lane_first)
    # What each place is: a window of a segment, or none.
    owner, begin = np.array(owner), np.array(begin)
    count = rows["windows"][owner].astype(np.int64)
    which = np.repeat(np.arange(len(owner)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    window = np.full(len(text), -1, np.int64)
    window[begin[which] + inside] = np.arange(len(which))
    same = prefix[sa] >= LENGTH
    keep = window[sa] >= 0
    group = np.cumsum(~same)[keep]
    member = window[sa[keep]]
    seg = owner[which[member]]
    start = rows["start"][seg] + inside[member]
    order = np.lexsort((start, rows["doc"][seg], group))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = group[order][1:] == group[order][:-1]
    hit = member[order[repeat]]
    flags = np.zeros(len(which), bool)
    flags[hit] = True
    at = np.cumsum(count) - count
    for k in np.unique(which[hit]).tolist():
        later[owner[k]] |= flags[at[k] : at[k] + count[k]]


def _mark_across(members: range, rows: np.ndarray, texts: list[bytes], later: list[np.ndarray]) -> None:
    """Windows that are the earliest of their shard meet those of the group's other shards."""
    digests, segs, places = [], [], []
    for i in members:
        left = np.flatnonzero(~later[i])
        digests.append(_digests(_sums(np.frombuffer(texts[i], np.uint8)), left, left + LENGTH))
        segs.append(np.full(len(left), i))
        places.append(left)
    digest, seg, place = map(np.concatenate, (digests, segs, places))
    order = np.lexsort((rows["start"][seg] + place, rows["doc"][seg], digest))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = digest[order][1:] == digest[order][:-1]
    for i, p in zip(seg[order[repeat]].tolist(), place[order[repeat]].tolist(), strict=True):
        later[i][p] = True


# -- Spark ------------------------------------------------------------------------------------

PACKED = "bucket int, kind int, data binary, texts binary"
#: Kinds of rows: segments, repeats, segments of crowded anchors, and single windows of these.
REP, GONE, CROWDED, WINDOW = 0, 1, 2, 3


def _packed(rows: list[tuple[int, int, bytes, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _by_bucket(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes, bytes]]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rows) else np.zeros(1, int)
    return [(int(bucket[a]), kind, _columns(rows[a:b]), b"") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def single_windows(rows: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Each window of the segments as a segment of its own, with the window's digest."""
    out = []
    for row, text in zip(rows, texts, strict=True):
        at = np.arange(row["windows"])
        part = np.zeros(len(at), SEGMENT)
        part["anchor"], part["doc"], part["start"], part["windows"] = row["anchor"], row["doc"], row["start"] + at, 1
        part["digest"] = _digests(_sums(np.frombuffer(text, np.uint8)), at, at + LENGTH)
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, SEGMENT)


def _columns(rows: np.ndarray) -> bytes:
    """Column by column: numbers of one kind beside each other compress."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _rows(data: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(data) // dtype.itemsize
    out, at = np.zeros(n, dtype), 0
    for c in dtype.names:
        width = dtype[c].itemsize * n
        out[c] = np.frombuffer(data, dtype[c], n, at)
        at += width
    return out


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def repeats(docs: DataFrame, total_bytes: int) -> tuple[DataFrame, int]:
    """Packed repeats by document bucket, and the number of these buckets. ``docs``: doc_id unique, text."""
    spark = docs.sparkSession
    schema = _arrow_schema(spark, PACKED)
    ship_package(spark)
    buckets = max(24, -(-total_bytes // BUCKET_BYTES))
    doc_buckets = max(24, -(-total_bytes // DOC_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        whole: dict[int, bytes] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            first, others = earliest(np.concatenate(held))
            begin = np.flatnonzero(np.r_[True, first["anchor"][1:] != first["anchor"][:-1]])
            count = np.diff(np.r_[begin, len(first)])
            crowded = np.repeat(count >= CROWD, count)
            gone = [as_repeats(others)]
            out = []
            if crowded.any():
                rows = first[crowded]
                alone, more = earliest(single_windows(rows, [whole[d][s : s + w + LENGTH - 1] for d, s, w in zip(rows["doc"].tolist(), rows["start"].tolist(), rows["windows"].tolist(), strict=True)]))
                gone.append(as_repeats(more))
                out += _by_bucket(alone, (alone["digest"] % np.uint64(buckets)).astype(np.int64), WINDOW)
                marks = first[begin[count >= CROWD]].copy()
                marks["windows"] = 0
                first = np.concatenate([first[~crowded], marks])
            out += _by_bucket(first, (first["anchor"] % np.uint64(buckets)).astype(np.int64), REP)
            if len(gone := np.concatenate(gone)):
                out += [(b % buckets, GONE, d, t) for b, _, d, t in _by_bucket(gone, doc_bucket(gone["doc"], buckets), GONE)]
            return _packed(out, schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    rows = segments(np.frombuffer(data, np.uint8))
                    if len(rows):
                        rows["doc"], whole[doc_id] = doc_id, data
                        held.append(rows)
                        size += len(rows)
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    whole.clear()
                    size = 0
        if held:
            yield flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        single: dict[int, list[np.ndarray]] = {}
        gone: list[np.ndarray] = []
        for batch in batches:
            for bucket, kind, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if kind == GONE:
                    gone.append(_rows(data, REPEAT))
                else:
                    (held if kind == REP else single).setdefault(bucket, []).append(_rows(data, SEGMENT))
        for bucket in list(single):
            first, others = earliest(np.concatenate(single.pop(bucket)))
            gone.append(as_repeats(others))
            yield _packed([(bucket, WINDOW, _columns(first), b"")], schema)
        for bucket in list(held):
            rows = np.concatenate(held.pop(bucket))
            marked = np.unique(rows["anchor"][rows["windows"] == 0])
            first, others = earliest(rows[rows["windows"] > 0])
            gone.append(as_repeats(others))
            crowded = np.isin(first["anchor"], marked) if len(marked) else np.zeros(len(first), bool)
            shared = np.zeros(len(first), bool)
            shared[1:] = first["anchor"][1:] == first["anchor"][:-1]
            shared[:-1] |= shared[1:]
            for kind, rows in ((REP, first[shared & ~crowded]), (CROWDED, first[crowded])):
                if len(rows):
                    yield _packed(_by_bucket(rows, doc_bucket(rows["doc"], doc_buckets), kind), schema)
        if gone and len(rows := np.concatenate(gone)):
            yield _packed(_by_bucket(rows, doc_bucket(rows["doc"], doc_buckets), GONE), schema)

    dealt = docs.mapInArrow(cut, PACKED).repartitionById(buckets, F.col("bucket"))
    met = written(dealt.mapInArrow(combine, PACKED), "segments")
    del dealt
    free_shuffles(spark)

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of the segments, from documents of the same bucket, dealt by anchor again."""
        out = []
        wanted = {k: [_rows(d, SEGMENT) for d, x in zip(right.column("data").to_pylist(), right.column("kind").to_pylist(), strict=True) if x == k] for k in (REP, CROWDED)}
        for kind, parts in wanted.items():
            if not parts or not left.num_rows:
                continue
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            place = {d: i for i, d in enumerate(left.column("doc_id").to_pylist())}
            texts, last, data = [], None, b""
            for doc, start, windows in zip(rows["doc"].tolist(), rows["start"].tolist(), rows["windows"].tolist(), strict=True):
                if doc != last:
                    data, last = left.column("text")[place[doc]].as_py().encode("utf-8", "surrogatepass"), doc
                texts.append(data[start : start + windows + LENGTH - 1])
            if kind == CROWDED:
                alone = single_windows(rows, texts)
                out += _by_bucket(alone, (alone["digest"] % np.uint64(buckets)).astype(np.int64), WINDOW)
                continue
            to = (rows["anchor"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                some = order[a:b]
                out.append((int(to[some[0]]), REP, _columns(rows[some]), b"".join(texts[i] for i in some.tolist())))
        return pa.Table.from_batches([_packed(out, schema)] if out else [], schema=schema)

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        single: list[np.ndarray] = []
        for batch in batches:
            for bucket, kind, data, texts in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if kind == WINDOW:
                    single.append(_rows(data, SEGMENT))
                else:
                    held.setdefault(bucket, []).append((_rows(data, SEGMENT), texts))
        if single:
            found = as_repeats(earliest(np.concatenate(single))[1])
            if len(found):
                yield _packed(_by_bucket(found, doc_bucket(found["doc"], doc_buckets), GONE), schema)
        for bucket in list(held):
            parts = held.pop(bucket)
            rows = np.concatenate([r for r, _ in parts])
            size = rows["windows"].astype(np.int64) + LENGTH - 1
            whole = b"".join(t for _, t in parts)
            at = np.cumsum(size) - size
            order = np.lexsort((rows["start"], rows["doc"], rows["anchor"]))
            texts = [whole[at[i] : at[i] + size[i]] for i in order.tolist()]
            found = repeated_windows(rows[order], texts)
            if len(found):
                yield _packed(_by_bucket(found, doc_bucket(found["doc"], doc_buckets), GONE), schema)

    placed = with_bucket(docs, doc_buckets)
    texts = placed.groupBy("bucket").cogroup(met.where(F.col("kind").isin(REP, CROWDED)).groupBy("bucket")).applyInArrow(fetch, PACKED)
    texts = texts.unionByName(met.where(F.col("kind") == WINDOW))
    induced = written(texts.repartitionById(buckets, F.col("bucket")).mapInArrow(induce, PACKED), "repeats")
    del placed, texts
    free_shuffles(spark)
    return met.where(F.col("kind") == GONE).unionByName(induced), doc_buckets


def with_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and the bucket that doc_bucket gives for the id."""
    schema = "doc_id long, text string, bucket int"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = doc_bucket(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bucket.astype(np.int32))], schema=arrow)

    return docs.mapInArrow(add, schema)


def without_repeats(data: bytes, starts: np.ndarray, windows: np.ndarray) -> tuple[int, int, list[bytes]]:
    """(removed bytes, maximal removed runs, what is left) for repeats in one text."""
    order = np.argsort(starts, kind="stable")
    start, end = starts[order], np.maximum.accumulate((starts + windows + LENGTH - 1)[order])
    opens = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    closes = np.r_[opens[1:] - 1, len(start) - 1]
    kept, at, removed = [], 0, 0
    for s, e in zip(start[opens].tolist(), end[closes].tolist(), strict=True):
        kept.append(data[at:s])
        removed += e - s
        at = e
    return removed, len(opens), [*kept, data[at:]]


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; ``with_text`` adds what is left."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    sizes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.count("doc_id")).first()
    repeated = sizes[1] != sizes[2] or not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()
    names: DataFrame | None = None
    if repeated:  # ranks in place of ids, in the order of ids and texts
        ranked = written(rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").select(F.col("doc_id").alias("__id"), F.monotonically_increasing_id().alias("doc_id"), "text"), "ranked")
        names, rows = ranked.select("__id", "doc_id"), ranked.select("doc_id", "text")
    found, buckets = repeats(rows, sizes[0])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    arrow = _arrow_schema(spark, schema)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = np.concatenate([np.zeros(0, REPEAT), *[_rows(d.as_py(), REPEAT) for d in right.column("data")]])
        gone = gone[np.argsort(gone["doc"], kind="stable")]
        ids = left.column("doc_id").to_numpy()
        low, high = np.searchsorted(gone["doc"], ids, "left"), np.searchsorted(gone["doc"], ids, "right")
        out = []
        for i, (doc_id, a, b) in enumerate(zip(ids.tolist(), low.tolist(), high.tolist(), strict=True)):
            data = left.column("text")[i].as_py().encode("utf-8", "surrogatepass")
            removed, spans, kept = without_repeats(data, gone["start"][a:b], gone["windows"][a:b]) if b > a else (0, 0, [data])
            digest = hashlib.sha256()
            for piece in kept:
                digest.update(piece)
            out.append((doc_id, len(data), removed, spans, digest.hexdigest(), *([b"".join(kept)] if with_text else [])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow) if out else pa.Table.from_batches([], schema=arrow)

    result = with_bucket(rows, buckets).groupBy("bucket").cogroup(found.select("bucket", "data").groupBy("bucket")).applyInArrow(remove, schema)
    if names is None:
        return result
    return result.join(names, "doc_id").select(F.col("__id").alias("doc_id"), *[c for c in result.columns if c != "doc_id"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
