"""Frequent keys, bucket histograms and their merge; distinct keys.

All but the order-dependent ``space_saving`` mode are native aggregates with a map-side
part, so a key that holds a third of all rows is reduced before it is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.scratch import pin

SKETCH_GROUP = ("source", "period")
# Largest precision the HyperLogLog aggregate accepts.
HLL_PRECISION = 21
# Rows that are counted at once for a summary.
SUMMARY_ROWS = 1 << 17


def capacity(epsilon: float) -> int:
    """Number of counters for precision ``epsilon``."""
    return math.ceil(1.0 / epsilon)


def key_counts(df: DataFrame, by: Sequence[str] = SKETCH_GROUP, key: str = "key") -> DataFrame:
    return df.groupBy(*by, key).agg(F.count("*").alias("cnt"))


def heavy_hitter_filter(
    counts: DataFrame, theta: float, by: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Keys whose count reaches ``ceil(theta * n)``, ``n`` being the rows of their group.

    Pass ``n`` where it is known (complete count windows); else it is summed from the counts.
    """
    if n is not None:
        return counts.where(F.col("cnt") >= math.ceil(theta * n))
    if not by:
        total = counts.agg(F.sum("cnt")).scalar()
        return counts.where(F.col("cnt") >= F.ceil(F.lit(theta) * total))
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("_n"))
    reached = F.col("cnt") >= F.ceil(F.lit(theta) * F.col("_n"))
    return counts.join(totals, list(by)).where(reached).select(*counts.columns)


def heavy_hitters(
    df: DataFrame,
    theta: float,
    eps: float | None = None,
    by: Sequence[str] = SKETCH_GROUP,
    mode: str = "exact",
    n: int | None = None,
    key: str = "key",
) -> DataFrame:
    """Frequent keys per group as ``(*by, key, cnt)``; ``cnt`` is the guaranteed count.

    ``exact`` counts every key; ``sketch`` keeps ``ceil(1/eps)`` items in Spark's mergeable
    frequent-items sketch; ``space_saving`` replays the rows of each group in ``seq`` order.
    ``eps`` is half of ``theta`` unless given.
    """
    eps = theta / 2 if eps is None else eps
    if mode == "exact":
        return heavy_hitter_filter(key_counts(df, by, key), theta, by, n)
    if mode == "sketch":
        counts = estimate_top(sketch_state(df, eps, by, key), eps, by, key)
        sizes = df.groupBy(*by).agg(F.count("*").alias("_n")) if by else df.agg(F.count("*").alias("_n"))
    elif mode == "space_saving":
        counts = space_saving(df, eps, by, key).select(*by, key, (F.col("count") - F.col("err")).alias("cnt"))
        sizes = df.groupBy(*by).agg(F.count("*").alias("_n")) if by else df.agg(F.count("*").alias("_n"))
    else:
        raise ValueError("mode is 'exact', 'sketch' or 'space_saving'")
    if n is not None:
        return counts.where(F.col("cnt") >= math.ceil(theta * n))
    if not by:
        return counts.where(F.col("cnt") >= F.ceil(F.lit(theta) * sizes.scalar()))
    reached = F.col("cnt") >= F.ceil(F.lit(theta) * F.col("_n"))
    return counts.join(sizes, list(by)).where(reached).select(*by, key, "cnt")


def sketch_state(df: DataFrame, eps: float, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Frequent-items sketch of each group, mergeable with :func:`combine_states`."""
    return df.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate({key}, {capacity(eps)})").alias("state"))


def combine_states(states: DataFrame, eps: float, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.expr(f"approx_top_k_combine(state, {capacity(eps)})").alias("state"))


def estimate_top(states: DataFrame, eps: float, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """The tracked items of each sketch with their estimated counts."""
    top = F.expr(f"approx_top_k_estimate(state, {capacity(eps)})")
    return states.select(*by, F.explode(top).alias("_t")).select(
        *by, F.col("_t.item").alias(key), F.col("_t.count").alias("cnt")
    )


class SpaceSaving:
    """Counters of at most ``counters`` keys; the smallest (count, key) makes room."""

    def __init__(self, counters: int):
        self.counters = counters
        self.kept: dict = {}
        # One entry per kept key; counts in it may lag behind. NULL sorts before all others.
        self.queue: list[tuple] = []

    def add(self, key) -> None:
        entry = self.kept.get(key)
        if entry is not None:
            entry[0] += 1
            return
        below = 0
        if len(self.kept) >= self.counters:
            below = self.floor()
            del self.kept[heapq.heappop(self.queue)[2]]
        self.kept[key] = [below + 1, below]
        heapq.heappush(self.queue, (below + 1, (key is not None, key if key is not None else 0), key))

    def floor(self) -> int:
        """The least count."""
        queue, kept = self.queue, self.kept
        while kept[queue[0][2]][0] != queue[0][0]:
            _, order, stale = queue[0]
            heapq.heapreplace(queue, (kept[stale][0], order, stale))
        return queue[0][0]

    def rows(self, group: tuple, empty: Sequence[pa.Array], names: Sequence[str]) -> pa.RecordBatch:
        """The counters of a group."""
        rows = [(*group, k, *e) for k, e in self.kept.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, e.type) for c, e in zip(zip(*rows), empty)], names=list(names))


def space_saving(df: DataFrame, eps: float, by: Sequence[str] = SKETCH_GROUP, key: str = "key") -> DataFrame:
    """Space-Saving counters ``(count, err)`` per group, rows taken in ``seq`` order.

    A group streams through one task in that order, which holds its counters and a batch. Where the
    order does not matter, and a group is large, :func:`merged_space_saving` counts its parts side by side.
    """
    by = list(by)
    counters = capacity(eps)
    schema = T.StructType([*(df.schema[c] for c in by), df.schema[key], T.StructField("count", T.LongType()), T.StructField("err", T.LongType())])
    placed = df.select(*by, "seq", key).repartition(*by) if by else df.select("seq", key).repartition(1)
    empty = [pa.array([], f.type) for f in to_arrow_schema(schema)]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, SpaceSaving(counters)
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            keys, at = batch.column(key).to_pylist(), 0
            while at < len(groups):
                end = at
                while end < len(groups) and groups[end] == groups[at]:
                    end += 1
                if groups[at] != group:
                    if group is not None:
                        yield kept.rows(group, empty, schema.names)
                    group, kept = groups[at], SpaceSaving(counters)
                for k in keys[at:end]:
                    kept.add(k)
                at = end
        if group is not None:
            yield kept.rows(group, empty, schema.names)

    return placed.sortWithinPartitions(*by, "seq").mapInArrow(replay, schema)


def _summed_up(kept: pa.Table | None, batches: list[pa.RecordBatch], by: list[str], key: str, counters: int) -> pa.Table:
    """A summary ``(*by, key, count, err, _floor)``, and rows merged into it: they are counted, which is a summary without floor.

    Counts add up, and a key that only the rows have may have been there as often as the floor says. Of each
    group the ``counters`` largest stay; the least of them is the new floor, ``n / counters`` at most.
    """
    names, long = [*by, key], pa.int64()
    new = pa.Table.from_batches(batches).group_by(names).aggregate([([], "count_all")])
    parts = [pa.table([*(new.column(c) for c in names), new.column("count_all"), *[pa.array(np.zeros(len(new), np.int64))] * 3], names=[*names, "count", "err", "_floor", "_known"])]
    if kept is not None:
        parts.append(kept.append_column("_known", pa.array(np.ones(len(kept), np.int64))))
    sums = [("count", "sum"), ("err", "sum"), ("_floor", "max"), ("_known", "max")]
    found = pa.concat_tables(parts).group_by(names).aggregate(sums)
    # Of equal counts the lower key stays.
    found = found.take(pc.sort_indices(found, sort_keys=[(key, "ascending")]))
    count, err, floor, known = (found.column(f"{c}_{how}").to_numpy().astype(np.int64) for c, how in sums)
    group = np.zeros(len(found), np.int64)
    for c in by:
        codes = found.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)
    below = np.zeros(int(group.max()) + 1, np.int64)
    np.maximum.at(below, group, floor)
    missed = np.where(known == 1, 0, below[group])
    count, err = count + missed, err + missed
    order = np.lexsort((-count, group))
    first = np.searchsorted(group[order], np.arange(len(below)))
    rank = np.arange(len(order)) - first[group[order]]
    full = order[rank == counters - 1]
    floor = np.zeros(len(below), np.int64)
    floor[group[full]] = count[full]
    stay = order[rank < counters]
    columns = [count[stay], err[stay], floor[group[stay]]]
    return pa.table([*(found.column(c).take(pa.array(stay)) for c in names), *(pa.array(c, long) for c in columns)], names=[*names, "count", "err", "_floor"])


def space_saving_parts(df: DataFrame, eps: float, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """A summary of each partition and group: ``(*by, key, count, err, _floor, _part)``.

    ``_floor`` is the least count of a full summary: no key that it lacks occurs more often there. The rows marked
    ``_part`` give each summary's floor once.
    """
    by, counters = list(by), capacity(eps)
    more = [T.StructField(c, T.LongType()) for c in ("count", "err", "_floor")]
    schema = T.StructType([*(df.schema[c] for c in by), df.schema[key], *more, T.StructField("_part", T.BooleanType())])
    empty = [pa.array([], f.type) for f in to_arrow_schema(schema)]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= SUMMARY_ROWS:
                kept, waiting, rows = _summed_up(kept, waiting, by, key, counters), [], 0
        if rows:
            kept = _summed_up(kept, waiting, by, key, counters)
        if kept is None:
            return
        floors = kept.group_by([*by, "_floor"]).aggregate([])
        none = {key: pa.nulls(len(floors), kept.schema.field(key).type), "count": pa.array([0] * len(floors)), "err": pa.array([0] * len(floors))}
        for part, marked in ((kept, False), (floors, True)):
            columns = [none[c] if marked and c in none else part.column(c) for c in schema.names[:-1]]
            columns.append(pa.array([marked] * len(part), pa.bool_()))
            yield from pa.table([c.cast(e.type) for c, e in zip(columns, empty)], names=schema.names).combine_chunks().to_batches()

    return df.select(*by, key).mapInArrow(summarise, schema)


def merged_space_saving(df: DataFrame, eps: float, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Space-Saving counters ``(*by, key, count, err)`` from summaries of all partitions (Agarwal et al. 2012).

    Counts and errors of a key are added up; a summary that lacks it adds its floor to both. Of the sums the
    ``ceil(1/eps)`` largest stay. With ``n`` rows in a group the true number of a key lies between
    ``count - err`` and ``count``, ``err`` is ``eps * n`` at most, and every key with more rows than that is there.
    What is shuffled is ``1/eps`` rows for each partition and group, however many rows or keys there are. The summaries
    are written, so that the rows are read once.
    """
    by = list(by)
    parts = pin(space_saving_parts(df, eps, by, key), "summaries")
    floors = F.sum("_floor").alias("_floors")
    sums = parts.where("NOT _part").groupBy(*by, key).agg(*(F.sum(c).alias(c) for c in ("count", "err", "_floor")))
    if by:
        joined = sums.join(parts.where("_part").groupBy(*by).agg(floors), by)
    else:
        joined = sums.withColumn("_floors", parts.where("_part").agg(floors).scalar())
    missing = F.col("_floors") - F.col("_floor")
    merged = joined.select(*by, key, (F.col("count") + missing).alias("count"), (F.col("err") + missing).alias("err"))
    if not by:
        return merged.orderBy(F.desc("count"), key).limit(capacity(eps))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), key))
    return merged.withColumn("_rank", rank).where(F.col("_rank") <= capacity(eps)).drop("_rank")


def bucket_hist(
    df: DataFrame, buckets: int, bucket_of: Callable[[str], Column], by: Sequence[str] = SKETCH_GROUP, key: str = "key"
) -> DataFrame:
    """Rows per hash bucket and group, empty buckets included: ``(*by, bucket, cnt)``."""
    counts = df.groupBy(*by, bucket_of(key).alias("bucket")).agg(F.count("*").alias("cnt"))
    return fill_zero(counts, "bucket", buckets, by)


def fill_zero(counts: DataFrame, slot: str, slots: int, by: Sequence[str] = (), value: str = "cnt") -> DataFrame:
    """Give every group a row for each slot 0..slots-1, by one more aggregation.

    The slots of a group are folded into a map of at most ``slots`` entries and unfolded with
    the missing ones; without groups a generated table of slots is joined instead.
    """
    if not by:
        grid = counts.sparkSession.range(slots).select(F.col("id").cast("int").alias(slot))
        return grid.join(counts, slot, "left").select(slot, F.coalesce(value, F.lit(0)).alias(value))
    found = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(slot, value))).alias("_m"))
    return found.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias(slot)).select(
        *by, slot, F.coalesce(F.try_element_at("_m", F.col(slot)), F.lit(0)).alias(value)
    )


def sparse_buckets(
    hist: DataFrame, heavy: DataFrame, bucket_of: Callable[[str], Column], by: Sequence[str] = SKETCH_GROUP, key: str = "key"
) -> DataFrame:
    """Bucket counts without the guaranteed counts of the heavy keys hashing there.

    A union with negated heavy counts and one aggregation: no join, one shuffle.
    """
    taken = heavy.select(*by, bucket_of(key).alias("bucket"), (-F.col("cnt")).alias("cnt"))
    return hist.select(*by, "bucket", "cnt").unionByName(taken).groupBy(*by, "bucket").agg(F.sum("cnt").alias("cnt"))


def merge_heavy(heavy: DataFrame, by: Sequence[str] = ("period",), key: str = "key") -> DataFrame:
    """Heavy counts summed over sources; the threshold is not applied again."""
    return heavy.groupBy(*by, key).agg(F.sum("cnt").alias("cnt"))


def merge_buckets(buckets: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    return buckets.groupBy(*by, "bucket").agg(F.sum("cnt").alias("cnt"))


def merge_sketches(heavy: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge_heavy(heavy), merge_buckets(buckets)


def items_from_counts(
    counts: DataFrame, is_heavy: Column, bucket_of: Callable[[str], Column], by: Sequence[str] = (), key: str = "key"
) -> DataFrame:
    """Heavy keys and sparse buckets as one item list, in a single aggregation of key counts.

    A heavy key keeps itself as group, every other one falls into the group of its bucket:
    ``(*by, kind, key, bucket, cnt)``. Buckets without rows are left out.
    """
    return (
        counts.select(
            *by,
            F.when(is_heavy, "heavy").otherwise("bucket").alias("kind"),
            F.when(is_heavy, F.col(key)).alias("key"),
            F.when(~is_heavy, bucket_of(key)).alias("bucket"),
            "cnt",
        )
        .groupBy(*by, "kind", "key", "bucket")
        .agg(F.sum("cnt").alias("cnt"))
    )


def items_from_rows(
    df: DataFrame,
    theta: float,
    n: Column | None,
    bucket_of: Callable[[str], Column],
    key: str = "key",
    placed: bool = False,
) -> DataFrame:
    """Merged heavy keys and sparse buckets of periods in one pass over the rows.

    Same result as sketching each source and merging. Rows are shuffled once, by period:
    every later grouping contains ``period`` and needs no further exchange. A period holds
    ``s*m`` rows at most whatever the keys are, so partitions stay even under any key skew.

    ``n`` is the number of rows of a source in a period; without it they are counted. With ``placed`` the
    rows are dealt out by period already. All their columns are then read here, which makes this
    the same exchange as that of a later join, and Spark runs it once.
    """
    if placed:
        # The greatest hash of a row always exists, which Catalyst cannot know.
        read = F.max(F.xxhash64(*df.columns))
        counts = df.groupBy("period", "source", key).agg(F.count("*").alias("cnt"), read.alias("_read"))
        counts = counts.where(F.col("_read").isNotNull()).drop("_read")
    else:
        counts = key_counts(df.select("period", "source", key).repartition("period"), ("period", "source"), key)
    if n is None:
        n = F.sum("cnt").over(Window.partitionBy("period", "source"))
        counts = counts.withColumn("_n", n)
        n = F.col("_n")
    is_heavy = F.col("cnt") >= F.ceil(F.lit(theta) * n)
    return items_from_counts(counts, is_heavy, bucket_of, ("period",), key)


def split_items(items: DataFrame, by: Sequence[str] = ("period",)) -> tuple[DataFrame, DataFrame]:
    """Heavy keys ``(*by, key, cnt)`` and sparse buckets ``(*by, bucket, cnt)`` of an item list."""
    heavy = items.where(F.col("kind") == "heavy").select(*by, "key", "cnt")
    return heavy, items.where(F.col("kind") == "bucket").select(*by, "bucket", "cnt")


def check_conservation(heavy: DataFrame, sparse: DataFrame, m: int, by: Sequence[str] = SKETCH_GROUP) -> DataFrame:
    """Mass of each sketch: sparse buckets plus heavy counts must give ``m``."""
    return (
        sparse.select(*by, "cnt").unionByName(heavy.select(*by, "cnt"))
        .groupBy(*by).agg(F.sum("cnt").alias("mass"))
        .withColumn("conserved", F.col("mass") == m)
    )


def distinct_keys(df: DataFrame, mode: str = "exact", by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Number of distinct keys: exact, from a mergeable HyperLogLog sketch, or the quick estimate."""
    if mode == "exact":
        number = F.count_distinct(key)
    elif mode == "hll":
        number = F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(HLL_PRECISION)))
    elif mode == "quick":
        number = F.approx_count_distinct(key)
    else:
        raise ValueError("mode is 'exact', 'hll' or 'quick'")
    return df.groupBy(*by).agg(number.alias("distinct_keys"))


def hll_state(df: DataFrame, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Distinct-key sketch per group, to be merged with :func:`hll_merge`."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(HLL_PRECISION)).alias("state"))


def hll_merge(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("distinct_keys"))
