"""What several operators of this subpackage need: bounded labelled samples and digests of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.scratch import batches_of, pin

# Words are runs of anything but these six ASCII characters.
SPACES = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"

# Ids up to this many bytes may be sent to every executor.
BROADCAST_BYTES = 16 << 20


def chosen_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (empty for null); other columns cannot clash."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_rows(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, those whose ``doc_id`` hashes lowest: the same for every run."""
    return pin(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n), "sample")


def with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of a sample of :func:`sample_rows`, which is bounded by its parameter."""
    return docs.join(F.broadcast(sample), "doc_id")


def within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows fit ``limit`` bytes.

    Beyond it nothing is marked, and the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[bytes, list[int]]:
    """One buffer with the bytes of all texts, and the places where they start and end."""
    column = column.fill_null("").cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    import numpy as np

    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def per_process(key: tuple, make):
    """``make()`` once for each Python worker, however many tasks it runs; for read-only models."""
    import sys
    import types

    kept = sys.modules.setdefault("_evenkeel_per_process", types.ModuleType("_evenkeel_per_process"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def give_back() -> None:
    """Return freed memory to the system: a worker process waits idle between its tasks."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def grouped(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to about ``limit`` each, one at least."""
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + ([(start, len(sizes))] if start < len(sizes) else [])


def grouped_by_size(texts: list[str], chars: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``chars`` characters each, one text at least."""
    return grouped([len(t) for t in texts], chars)
