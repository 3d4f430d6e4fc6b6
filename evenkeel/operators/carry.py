"""Exact load vectors for order-dependent rules over chains cut into bounded chunks.

Choosing the less loaded worker depends on every earlier choice of the same source, so a
source is one long chain. It is cut into chunks, and only ``k`` loads pass between them; work
is never gathered beyond a chunk, whatever share of the rows one source holds.

:func:`carry_loads` replays every chunk at once from a guess, and mends the result:

1. How often each pair of candidates occurs in a chunk says about where loads will stand after it.
   These counts are folded once along each source, from the true end of its first chunk, which
   gives every chunk a start also where a few keys hold much of the rows and loads drift apart.
2. Each chunk is replayed from its guess. Its choices are kept, and with each the gap between its two
   candidates, which tells whether the choice would hold from another start.
3. Workers that are chosen over each other are level, and forget how they started; but the rows that
   a level group gets in all are carried on for good. So a chunk is moved to where the one before it
   ended, with the sum of every group corrected to what all chunks before added. Where gaps leave room
   for the move nothing changes; else rows are replayed until the rest has room.
4. Prefix sums of what chunks added give the true starts, and a chunk whose gaps have room for the
   difference is exact. If one is not, the chunks from there on are walked in order, a source as one
   stream. A chunk that was replayed twice by then is mended by visiting only rows whose choice flips; if
   those are many, as after a jump of the stream, the rest of it is replayed.

Keys that hold any share of the rows need no walk while that share lasts: their chunks are replayed
twice at most, all at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.scratch import BROADCAST_BYTES, batches_of, pin

# A choice is packed as (position in chunk) << 32 | (first * k + second).
_CODE_BITS = 32
_CODE = (1 << _CODE_BITS) - 1
# Cells of pair counts that a guess works through per chunk, over all its steps.
_GUESS_CELLS = 1 << 18
# Rows after a flip that are looked at first, and rows replayed first; doubled each time.
_LOOK, _REPLAY = 64, 1024
# Rows of chunk tables that are held at once: in a row group of a written table, and in a batch that goes to Python.
_ROWS_AT_ONCE = 16
# Visiting a row whose choice flips takes as long as replaying some tens; beyond one flip in so many rows the rest is replayed.
_FLIP_SHARE = 64


def pack_choice(offset: Column, code: Column) -> Column:
    """One number per row: its place in the chunk and its two candidate workers, ``first*k + second``."""
    return F.shiftleft(offset.cast("bigint"), _CODE_BITS) + code


def two_choice_kernel(codes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Gap of each code ``first*k + second`` when its turn comes: the less loaded worker is chosen, on a tie the second."""
    first, second = np.divmod(codes, k)
    loads = start.tolist()
    gaps = []
    keep = gaps.append
    for a, b in zip(first.tolist(), second.tolist()):
        gap = loads[a] - loads[b]
        keep(gap)
        loads[a if gap < 0 else b] += 1
    return np.asarray(gaps, dtype=np.int64)


def chosen_of(codes: np.ndarray, gaps: np.ndarray, k: int) -> np.ndarray:
    first, second = np.divmod(codes, k)
    return np.where(gaps < 0, first, second).astype(np.int32)


def room_of(codes: np.ndarray, gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How far loads may shift before a choice flips: cells ``chosen*k + other``, and the least slack of each."""
    first, second = np.divmod(codes.astype(np.int64), k)
    cell = np.where(gaps < 0, first * k + second, second * k + first)
    slack = np.where(gaps < 0, -gaps - 1, gaps)
    apart = first != second
    cells, at = np.unique(cell[apart], return_inverse=True)
    least = np.full(len(cells), np.iinfo(np.int64).max)
    np.minimum.at(least, at, slack[apart])
    return cells, least


def has_room(cells: np.ndarray, slack: np.ndarray, shift: np.ndarray, k: int) -> bool:
    """Whether no choice changes when the start loads shift."""
    chosen, other = np.divmod(cells, k)
    return bool((slack + shift[other] - shift[chosen] >= 0).all())


def flips_of(codes: np.ndarray, gaps: np.ndarray, shift: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The gaps moved by ``shift``, and the rows whose choice that changes."""
    first, second = np.divmod(codes, k)
    new = gaps + shift[first] - shift[second]
    return new, np.flatnonzero((new < 0) != (gaps < 0))


def shifted(codes: np.ndarray, gaps: np.ndarray, start: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """The gaps from ``to`` instead of ``start``, visiting only rows whose choice flips; and whether those were too many."""
    gaps, shift = gaps.copy(), to - start
    at, look, left = 0, _LOOK, len(gaps) // _FLIP_SHARE
    while at < len(gaps) and shift.any() and left >= 0:
        part = slice(at, at + look)
        new, flips = flips_of(codes[part], gaps[part], shift, k)
        if not len(flips):
            gaps[part] = new
            at, look = at + look, look * 2
            continue
        row = at + int(flips[0])
        gaps[at : row + 1] = new[: flips[0] + 1]
        pair = divmod(int(codes[row]), k)
        gains, loses = pair if gaps[row] < 0 else pair[::-1]
        shift[gains] += 1
        shift[loses] -= 1
        at, look, left = row + 1, _LOOK, left - 1
    if left < 0:
        loads = to + np.bincount(chosen_of(codes[:at], gaps[:at], k), minlength=k)
        gaps[at:] = two_choice_kernel(codes[at:], loads, k)
    return gaps, left < 0


def replayed(codes: np.ndarray, gaps: np.ndarray, start: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """The gaps from ``to`` instead of ``start``, replaying rows until no later choice flips."""
    loads, shift, at, look, out = to, to - start, 0, _REPLAY, []
    while True:
        new, flips = flips_of(codes[at:], gaps[at:], shift, k)
        if not len(flips):
            return np.concatenate([*out, new])
        part = slice(at, at + look)
        out.append(two_choice_kernel(codes[part], loads, k))
        gained = np.bincount(chosen_of(codes[part], out[-1], k), minlength=k)
        shift = shift + gained - np.bincount(chosen_of(codes[part], gaps[part], k), minlength=k)
        loads, at, look = loads + gained, at + look, look * 2


def level_groups(codes: np.ndarray, gaps: np.ndarray, k: int) -> np.ndarray:
    """Group of each worker, as its lowest member: of two that were chosen over each other in the last half."""
    cells, _ = room_of(codes[len(codes) // 2 :], gaps[len(codes) // 2 :], k)
    chosen, other = np.divmod(cells, k)
    both = np.isin(other * k + chosen, cells)
    group, a, b = np.arange(k), chosen[both], other[both]
    while (group[a] != group[b]).any():
        low = np.minimum(group[a], group[b])
        np.minimum.at(group, a, low)
        np.minimum.at(group, b, low)
        group = group[group]
    return group


def with_group_sums(loads: np.ndarray, sums_of: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``loads`` with the total of each group as in ``sums_of``, the difference spread over its members."""
    out = loads.copy()
    missing = np.bincount(group, sums_of - loads, len(group)).astype(np.int64)
    for g in np.flatnonzero(missing):
        members = np.flatnonzero(group == g)
        each, more = divmod(int(missing[g]), len(members))
        out[members] += each
        out[members[:more]] += 1
    return out


def foreseen(loads: np.ndarray, cells: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """About where loads stand after a chunk, from how often each pair of candidates occurs in it.

    The counts flow in at even rates, a part of all pairs at each step to the less loaded worker. Parts are
    whole numbers, so groups of workers that are far apart get exactly their rows.
    """
    first, second = np.divmod(cells, k)
    steps = int(np.clip(_GUESS_CELLS // max(len(cells), 1), 8, 256))
    loads, given = loads.copy(), np.zeros_like(counts)
    # Cells do not all round at the same step.
    lead = (cells * 7919) % steps
    for step in range(1, steps + 1):
        until = np.minimum((counts * step + lead) // steps, counts) if step < steps else counts
        loads += np.bincount(np.where(loads[first] < loads[second], first, second), until - given, k).astype(np.int64)
        given = until
    return loads


# ---------------------------------------------------------------- tables

_LONGS = T.ArrayType(T.LongType())
# Columns with a number for each row of a chunk, as bytes: arrays would be read thousands at once, with levels for each number.
_PACKED = ("place", "code", "gap")


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all; the first byte tells how many that are."""
    low, high = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, 0)
    size = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    return bytes([size]) + numbers.astype(f"<i{size}").tobytes()


def unpacked(data: bytes | memoryview) -> np.ndarray:
    size = data[0]
    return np.frombuffer(data, f"<i{size}", (len(data) - 1) // size, 1).astype(np.int64)


def _fields(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema["source"], df.schema["chunk"], *(T.StructField(n, t) for n, t in more)])


def _arrays(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray | None]:
    """Numbers in columns of one row, null as None."""
    cells = ((name, batch.column(name)[row]) for name in names)
    return [
        None if not cell.is_valid
        else unpacked(memoryview(cell.as_buffer())) if name in _PACKED
        else cell.values.to_numpy(zero_copy_only=False)
        for name, cell in cells
    ]


def _cells(names: list[str], values: list) -> list[pa.Array]:
    """Columns of one row from numpy arrays, None as null."""
    kind = lambda v: pa.list_(pa.int64() if v is None else pa.from_numpy_dtype(v.dtype))
    return [
        pa.array([None if v is None else packed(v)], pa.binary()) if name in _PACKED else pa.array([v], kind(v))
        for name, v in zip(names, values)
    ]


def _one(batch: pa.RecordBatch, row: int, names: list[str], values: list) -> pa.RecordBatch:
    """A row with the source and chunk of ``row``."""
    columns = [batch.column(c).slice(row, 1) for c in ("source", "chunk")]
    return pa.RecordBatch.from_arrays([*columns, *_cells(names, values)], names=["source", "chunk", *names])


def _written(df: DataFrame, label: str) -> DataFrame:
    """A table with chunks written in small row groups, which are what a reader holds at once."""
    return pin(df, label, codec="zstd", group_rows=_ROWS_AT_ONCE)


def _small(df: DataFrame, numbers: int) -> DataFrame:
    """A written table of ``numbers`` numbers a row for a join with chunks, which must not be sorted: sent or hashed."""
    return F.broadcast(df) if df.count() * numbers * 8 <= BROADCAST_BYTES else df.hint("shuffle_hash")


def _by_row(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch, int], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield work(batch, row)

    return df.mapInArrow(run, schema)


def _in_order(df: DataFrame, schema: T.StructType, step: Callable) -> DataFrame:
    """Walk the chunks of each source in order: ``step(state, batch, row) -> (state, row or None)``.

    A source streams through one task, which holds a batch (64 MB unless configured) and the state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state = None, None
        for batch in batches:
            for row, this in enumerate(batch.column("source").to_pylist()):
                if (this,) != source:
                    source, state = (this,), None
                state, out = step(state, batch, row)
                if out is not None:
                    yield out

    return df.repartition("source").sortWithinPartitions("source", "chunk").mapInArrow(run, schema)


def _with_first(df: DataFrame, k: int, initial: DataFrame | None) -> DataFrame:
    """Adds ``_first``, the loads each source starts from."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), k)
    if initial is None:
        return df.withColumn("_first", zeros)
    given = initial.select("source", F.col("loads").alias("_first"))
    return df.join(given, "source", "left").withColumn("_first", F.coalesce("_first", zeros))


_PARTS = (("place", T.BinaryType()), ("code", T.BinaryType()))


def _in_places(ops: np.ndarray) -> list[np.ndarray | None]:
    """Places and codes of a chunk's choices in order; no places where they are 0, 1, 2, ..."""
    ops = np.sort(ops)
    place, code = ops >> _CODE_BITS, ops & _CODE
    return [None if len(place) == 0 or place[-1] == len(place) - 1 else place, code]


def _ordered(chunks: DataFrame) -> DataFrame:
    """``(source, chunk, place, code)`` of chunks that have their choices as arrays."""

    def work(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        return _one(batch, row, ["place", "code"], _in_places(*_arrays(batch, row, "ops")))

    given = chunks.where("source IS NOT NULL AND chunk IS NOT NULL").select("source", "chunk", "ops")
    return _by_row(given, _fields(chunks, *_PARTS), work)


def gathered(rows: DataFrame) -> DataFrame:
    """``(source, chunk, place, code)`` from one row ``(source, chunk, op)`` for each choice, none of them null.

    All rows of a chunk must be in one partition, in any order. A task holds eight bytes for each row of its
    partition, and a row for each chunk leaves it alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[np.ndarray]] = {}
        kind = None
        for batch in batches:
            kind = batch.column("source").type
            sources = batch.column("source").dictionary_encode()
            names = sources.dictionary.to_pylist()
            numbers, group = np.unique(batch.column("chunk").to_numpy(), return_inverse=True)
            group = group * len(names) + sources.indices.to_numpy()
            ops = batch.column("op").to_numpy()[np.argsort(group, kind="stable")]
            groups, counts = np.unique(group, return_counts=True)
            for g, part in zip(groups.tolist(), np.split(ops, np.cumsum(counts)[:-1])):
                found.setdefault((names[g % len(names)], int(numbers[g // len(names)])), []).append(part)
        while found:
            (source, chunk), parts = found.popitem()
            columns = [pa.array([source], kind), pa.array([chunk], pa.int64()), *_cells(["place", "code"], _in_places(np.concatenate(parts)))]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "chunk", "place", "code"])

    return rows.select("source", "chunk", "op").mapInArrow(run, _fields(rows, *_PARTS))


def _guessed(chunks: DataFrame, k: int, initial: DataFrame | None) -> DataFrame:
    """``(source, chunk, start)``: pair counts of all chunks, folded once along each source.

    The first chunk of a source goes along whole, and the fold starts where it truly ends.
    """

    def count(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        (codes,) = _arrays(batch, row, "code")
        first = batch.column("chunk")[row].as_py() == 0
        cells, counts = np.unique(codes, return_counts=True)
        return _one(batch, row, ["cells", "counts", "code"], [cells, counts, codes if first else None])

    def step(loads, batch: pa.RecordBatch, row: int):
        cells, counts, codes, first = _arrays(batch, row, "cells", "counts", "code", "_first")
        loads = first if loads is None else loads
        out = _one(batch, row, ["start"], [loads])
        if codes is None:
            return foreseen(loads, cells, counts, k), out
        return loads + np.bincount(chosen_of(codes, two_choice_kernel(codes, loads, k), k), minlength=k), out

    fields = _fields(chunks, ("cells", _LONGS), ("counts", _LONGS), ("code", T.BinaryType()))
    counted = _by_row(chunks.select("source", "chunk", "code"), fields, count)
    return _in_order(_with_first(counted, k, initial), _fields(chunks, ("start", _LONGS)), step)


_RUN = (
    ("start", _LONGS),
    *_PARTS,
    ("gap", T.BinaryType()),
    ("added", _LONGS),
    ("cells", _LONGS),
    ("slack", _LONGS),
    ("level", _LONGS),
    ("replays", _LONGS),
)
_NAMES = [name for name, _ in _RUN]


def _row_of(batch, row, start, place, code, gap, replays, k) -> pa.RecordBatch:
    added = np.bincount(chosen_of(code, gap, k), minlength=k).astype(np.int64)
    return _one(batch, row, _NAMES, [start, place, code, gap, added, *room_of(code, gap, k), level_groups(code, gap, k), np.array([replays])])


def _replayed(started: DataFrame, k: int) -> DataFrame:
    """Each chunk from its ``start``."""

    def work(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        start, place, code = _arrays(batch, row, "start", "place", "code")
        return _row_of(batch, row, start, place, code, two_choice_kernel(code, start, k), 1, k)

    return _by_row(started.select("source", "chunk", "start", "place", "code"), _fields(started, *_RUN), work)


def _as_found(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
    return batch.slice(row, 1).select(["source", "chunk", *_NAMES])


def _targets(runs: DataFrame, k: int, initial: DataFrame | None) -> DataFrame:
    """``(source, chunk, to)``: where the chunk before ended, with the sums of its level groups made right."""

    def step(state, batch: pa.RecordBatch, row: int):
        start, added, level, first = _arrays(batch, row, "start", "added", "level", "_first")
        sums, to = (first, first) if state is None else state
        sums = sums + added
        return (sums, with_group_sums(start + added, sums, level)), _one(batch, row, ["to"], [to])

    summary = runs.select("source", "chunk", "start", "added", "level")
    return _in_order(_with_first(summary, k, initial), _fields(runs, ("to", _LONGS)), step)


def _moved(runs: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Each chunk moved to its target, replayed as far as that changes choices."""

    def work(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        to, start, place, code, gap, cells, slack, replays = _arrays(batch, row, "to", "start", "place", "code", "gap", "cells", "slack", "replays")
        if has_room(cells, slack, to - start, k):
            return _as_found(batch, row)
        return _row_of(batch, row, to, place, code, replayed(code, gap, start, to, k), int(replays[0]) + 1, k)

    return _by_row(runs.join(_small(targets, k + 2), ["source", "chunk"]), _fields(runs, *_RUN), work)


def _exact_until(runs: DataFrame, k: int, initial: DataFrame | None) -> DataFrame:
    """``(source, chunk, exact)`` of chunks that are right as they are, and of the first that is not.

    ``exact`` is the true start; it has one number more, 1 if the chunk has room for it. Later chunks are left out.
    """

    def step(state, batch: pa.RecordBatch, row: int):
        start, added, cells, slack, first = _arrays(batch, row, "start", "added", "cells", "slack", "_first")
        exact, fine = (first, True) if state is None else state
        if not fine:
            return state, None
        fine = has_room(cells, slack, exact - start, k)
        return (exact + added, fine), _one(batch, row, ["exact"], [np.r_[exact, int(fine)]])

    summary = runs.select("source", "chunk", "start", "added", "cells", "slack")
    return _in_order(_with_first(summary, k, initial), _fields(runs, ("exact", _LONGS)), step)


def _walked(runs: DataFrame, k: int) -> DataFrame:
    """Chunks from a source's first wrong one on, which has ``exact``, each moved to its true start."""

    def step(loads, batch: pa.RecordBatch, row: int):
        names = ("exact", "start", "place", "code", "gap", "added", "cells", "slack", "replays")
        exact, start, place, code, gap, added, cells, slack, replays = _arrays(batch, row, *names)
        loads = exact[:k] if loads is None else loads
        if has_room(cells, slack, loads - start, k):
            return loads + added, _as_found(batch, row)
        if replays[0] < 2:
            gap, again = replayed(code, gap, start, loads, k), True
        else:
            gap, again = shifted(code, gap, start, loads, k)
        out = _row_of(batch, row, loads, place, code, gap, int(replays[0]) + again, k)
        return loads + np.bincount(chosen_of(code, gap, k), minlength=k), out

    return _in_order(runs, _fields(runs, *_RUN), step)


def _answers(runs: DataFrame, k: int) -> DataFrame:
    """``(source, chunk, chosen, added, replays)``; ``chosen`` goes by place, -1 where a number is missing.

    A worker's number takes one byte if that is enough.
    """
    small = k <= np.iinfo(np.int8).max + 1
    kind = T.ArrayType(T.ByteType() if small else T.IntegerType())
    schema = _fields(runs, ("chosen", kind), ("added", _LONGS), ("replays", _LONGS))

    def work(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        place, code, gap, added, replays = _arrays(batch, row, "place", "code", "gap", "added", "replays")
        found = chosen_of(code, gap, k)
        if place is not None:
            chosen = np.full(int(place[-1]) + 1, -1, np.int32)
            chosen[place] = found
            found = chosen
        found = found.astype(np.int8) if small else found
        return _one(batch, row, ["chosen", "added", "replays"], [found, added, replays])

    return _by_row(runs.select("source", "chunk", "place", "code", "gap", "added", "replays"), schema, work)


def carry_loads(chunks: DataFrame, k: int, chunk_count: int, initial: DataFrame | None = None) -> DataFrame:
    """Make the two-choice decisions of every source as if each source were one sequence.

    ``chunks`` has one row ``(source, chunk, ops)`` per chunk, with packed choices in any order, or is a table of
    :func:`gathered`; ``initial`` may give ``(source, loads)`` to start from. Returns ``(source, chunk, chosen, added,
    replays)``, the last as an array of one number: how often the chunk was replayed.

    Where chains are one chunk long the plan stays lazy. Longer ones take the same few jobs
    whatever their length. Readers, and Python workers, hold a few chunks at once, however many a task has.
    """
    if "ops" in chunks.columns:
        chunks = _ordered(chunks)
    if chunk_count <= 1:
        return _answers(_replayed(_with_first(chunks, k, initial).withColumnRenamed("_first", "start"), k), k)

    chunks = _written(chunks, "chunks")
    on = ["source", "chunk"]
    with batches_of(chunks.sparkSession, _ROWS_AT_ONCE):
        starts = pin(_guessed(chunks, k, initial), "starts")
        runs = _written(_replayed(chunks.join(_small(starts, k + 2), on), k), "runs")
        runs = _written(_moved(runs, pin(_targets(runs, k, initial), "targets"), k), "moved")
        exact = pin(_exact_until(runs, k, initial), "exact")
        fine = exact.where(F.element_at("exact", -1) == 1)
        wrong = exact.where(F.element_at("exact", -1) == 0)
        if not wrong.isEmpty():
            fine = _small(fine.select(*on), 2)
            late = runs.join(fine, on, "left_anti").join(_small(wrong, k + 3), on, "left")
            runs = runs.join(fine, on, "left_semi").unionByName(_written(_walked(late, k), "walked"))
        return _written(_answers(runs, k), "answers")
