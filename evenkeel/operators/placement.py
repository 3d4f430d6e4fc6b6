"""Routing-table builders: greedy placement of frequent keys on the least loaded worker."""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.metrics import running_sum
from evenkeel.operators.sketches import fill_zero


def greedy(amounts: Sequence[int], loads: list[int]) -> list[int]:
    """Workers of a sequence of items, each put on the least loaded one (lowest on ties). Changes ``loads``."""
    queue = [(load, w) for w, load in enumerate(loads)]
    heapq.heapify(queue)
    chosen = []
    for amount in amounts:
        load, worker = queue[0]
        loads[worker] = load + amount
        heapq.heapreplace(queue, (load + amount, worker))
        chosen.append(worker)
    return chosen


def least_loaded(loads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worker with the least load per group, lowest index on ties."""
    return loads.groupBy(*by).agg(F.min_by("worker", F.struct("load", "worker")).alias("worker"))


def top_heavy(merged: DataFrame, n: int | None = None) -> DataFrame:
    """Merged heavy keys by count, largest first; with ``n`` a distributed top-n."""
    ordered = merged.orderBy(F.desc("cnt"), *[c for c in merged.columns if c != "cnt"])
    return ordered if n is None else ordered.limit(n)


def placement_items(heavy: DataFrame, sparse: DataFrame, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Heavy keys and sparse buckets as one item list, told apart by ``kind``."""
    key_type = heavy.schema[key].dataType
    return heavy.select(
        *by, F.lit("heavy").alias("kind"), F.col(key).alias("key"), F.lit(None).cast("int").alias("bucket"), "cnt"
    ).unionByName(
        sparse.select(
            *by, F.lit("bucket").alias("kind"), F.lit(None).cast(key_type).alias("key"), "bucket", "cnt"
        )
    )


def _present(df: DataFrame, column: str) -> Column:
    """``column`` with a typed default for NULL, so that pandas keeps whole numbers whole."""
    kind = df.schema[column].dataType
    return F.coalesce(column, F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))


def place_lpt(items: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Longest processing time first: items by count, each to the least loaded worker.

    Ties: buckets before heavy keys, buckets by falling number, keys rising; of equally loaded
    workers the lowest; a NULL key is the last. Adds ``worker``. A group streams through one
    task in that order, which holds ``k`` loads and a batch.
    """
    by = list(by)
    schema = T.StructType([*items.schema.fields, T.StructField("worker", T.IntegerType())])
    order = [F.col("cnt").desc(), F.col("kind").asc(), F.col("bucket").desc(), F.col("key").asc_nulls_last()]
    placed = items.repartition(*by) if by else items.repartition(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, loads = None, [0] * k
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            amounts, workers, at = batch.column("cnt").to_pylist(), [], 0
            while at < len(groups):
                end = at
                while end < len(groups) and groups[end] == groups[at]:
                    end += 1
                if groups[at] != group:
                    group, loads = groups[at], [0] * k
                workers += greedy(amounts[at:end], loads)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(workers, pa.int32())], names=[*batch.schema.names, "worker"])

    return placed.sortWithinPartitions(*by, *order).mapInArrow(place, schema)


def split_maps(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two small maps of a placement: ``(key, worker)`` and ``(bucket, worker)``."""
    heavy = placed.where(F.col("kind") == "heavy").select("key", "worker")
    buckets = placed.where(F.col("kind") == "bucket").select("bucket", "worker")
    return heavy, buckets


def _folded(k: int, initial: Sequence[int], timed: bool):
    """Fold periods in order: of each the sparse buckets, then the heavy keys as they are listed."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = list(initial)
        for batch in batches:
            light, heavy = batch.column("light"), batch.column("heavy")
            items = heavy.flatten()
            fixed, added = (light.flatten().field(c).to_pylist() for c in ("bucket", "cnt"))
            amounts, sizes = items.field("cnt").to_pylist(), heavy.value_lengths().to_pylist()
            workers, micros, a, b = [], [], 0, 0
            for n_light, n_heavy in zip(light.value_lengths().to_pylist(), sizes):
                start = time.perf_counter_ns()
                for worker, amount in zip(fixed[a : a + n_light], added[a : a + n_light]):
                    loads[worker] += amount
                workers += greedy(amounts[b : b + n_heavy], loads) if n_heavy else []
                a, b = a + n_light, b + n_heavy
                micros.append((time.perf_counter_ns() - start) // 1000)
            if timed:
                yield pa.RecordBatch.from_arrays([batch.column("period"), pa.array(sizes, pa.int64()), pa.array(micros, pa.int64())], names=["period", "routing_size", "build_us"])
                continue
            period = batch.column("period").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            key = items.field("key")
            key = pc.if_else(items.field("null_key"), pa.scalar(None, key.type), key)
            yield pa.RecordBatch.from_arrays([period, key, pa.array(workers, pa.int32()), items.field("cnt")], names=["period", "key", "worker", "cnt"])

    return fold


def place_online(
    items: DataFrame, k: int, order: str = "key", initial: Sequence[int] | None = None, timed: bool = False
) -> DataFrame:
    """Place merged heavy keys of successive periods; loads carry over and never decay.

    ``items`` is a list as of :func:`placement_items`, by period. Per period the sparse buckets
    are added to the loads, then each heavy key (in key order, or by count with
    ``order='load'``) goes to the least loaded worker, which gains its count. Returns
    ``(period, key, worker, cnt)``. ``initial`` gives the ``k`` loads to start from.

    Each choice depends on all loads before it, down to the last row, and two folds from different
    loads do not meet again (items have weights, unlike the rows of two-choice), so periods cannot
    be placed side by side. But the fold sees sketches, not rows: a period is one row with at most
    ``k`` buckets and its heavy keys. These rows stream through one task in order, which holds the
    loads and a batch, in one job whatever their number.

    With ``timed`` the result is what building the tables took: ``(period, routing_size, build_us)``.
    """
    if order not in ("key", "load"):
        raise ValueError("order is 'key' or 'load'")
    is_heavy = F.col("kind") == "heavy"
    rank = -F.col("cnt") if order == "load" else F.lit(0).cast("bigint")
    heavy = F.struct(rank.alias("rank"), F.col("key").isNull().alias("null_key"), _present(items, "key").alias("key"), "cnt")
    rows = items.groupBy("period").agg(
        F.array_sort(F.collect_list(F.when(is_heavy, heavy))).alias("heavy"),
        F.collect_list(F.when(~is_heavy, F.struct("bucket", "cnt"))).alias("light"),
    )
    schema = T.StructType([items.schema["period"], items.schema["key"], T.StructField("worker", T.IntegerType()), T.StructField("cnt", T.LongType())])
    if timed:
        schema = "period long, routing_size long, build_us long"
    start = [0] * k if initial is None else [int(x) for x in initial]
    return rows.repartition(1).sortWithinPartitions("period").mapInArrow(_folded(k, start, timed), schema)


def placement_loads(routing: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Load of each worker after each period, from placed counts and sparse buckets."""
    added = (
        routing.select("period", "worker", "cnt")
        .unionByName(sparse.select("period", F.col("bucket").alias("worker"), "cnt"))
        .groupBy("period", "worker").agg(F.sum("cnt").alias("cnt"))
    )
    filled = fill_zero(added, "worker", k, ["period"])
    return running_sum(filled, ["worker"], "period", "cnt", "load").select("period", "worker", "load")
