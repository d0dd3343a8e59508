"""Entries of many documents that meet at keys, in packed arrays.

A row an entry costs a shuffle several times what the entry's numbers take. Here tasks pack the entries of
many rows into arrays, one row a bucket of keys. What a task can settle among its own rows it settles
before it sends, so that a key sends little however many documents have it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import _arrow_schema
from lattica.session import ship_package

#: Entries that a task packs before it sends them, and that a bucket takes, about.
PACK, BUCKET = 1 << 18, 1 << 17

#: The key of each entry, by which its bucket is chosen, and columns of its numbers.
Part = tuple[np.ndarray, list[np.ndarray]]


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a column of lists without nulls."""
    lengths, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for chunk in column.chunks:
        at = chunk.offsets.to_numpy().astype(np.int64)
        lengths.append(np.diff(at))
        values.append(chunk.values.to_numpy()[at[0] : at[-1]])
    return np.concatenate(lengths), np.concatenate(values)


def heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted columns differs from the one before."""
    out = np.zeros(len(sorted_columns[0]), bool)
    out[:1] = True
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def unique_pairs(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = heads(a, b)
    return [a[new], b[new]]


def give_back() -> None:
    """Return free memory to the system: workers outlive their tasks, and an executor's count together."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim is not None:
        trim(0)


def meet(
    rows: DataFrame,
    lists: str,
    entries: int,
    kinds: list[str],
    pack: Callable[[pa.Table], list[Part]],
    decide: Callable[[list[np.ndarray]], list[np.ndarray]],
    schema: str,
    read: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """What ``decide`` says of the entries of each bucket.

    ``lists`` is the column that holds a row's keys, ``entries`` how many there are, about; ``kinds`` are
    the types of the columns of all of ``pack``'s parts, in a row. ``read`` makes batches with that column of
    a batch of ``rows`` that lacks it. Each bucket is decided in one task.
    """
    buckets = np.uint64(max(1, -(-entries // BUCKET)))
    packed = "bucket long, " + ", ".join(f"c{i} binary" for i in range(len(kinds)))
    between, arrow = _arrow_schema(rows.sparkSession, packed), _arrow_schema(rows.sparkSession, schema)
    ship_package(rows.sparkSession)

    def send(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        parts = []
        for key, columns in pack(pa.Table.from_batches(held)):
            bucket = key.view(np.uint64) % buckets
            order = np.argsort(bucket, kind="stable")
            parts.append((bucket[order], [c[order] for c in columns]))
        used = np.unique(np.concatenate([bucket for bucket, _ in parts]))
        out = [pa.array(used.astype(np.int64))]
        for bucket, columns in parts:
            cuts = list(zip(np.searchsorted(bucket, used, "left").tolist(), np.searchsorted(bucket, used, "right").tolist(), strict=True))
            out += [pa.array([c[i:j].tobytes() for i, j in cuts], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays(out, schema=between)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in [batch] if read is None else read(batch):
                held.append(part)
                size += len(part.column(part.schema.get_field_index(lists)).flatten())
                if size >= PACK:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)
        held.clear()
        give_back()

    def bucket(group: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(group.column(f"c{i}").to_pylist()), kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(decide(columns), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(tasks, packed).groupBy("bucket").applyInArrow(bucket, schema)
