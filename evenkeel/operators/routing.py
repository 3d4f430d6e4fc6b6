"""Routing rows by table, comparing tables, moving keyed state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.metrics import worker_load
from evenkeel.scratch import broadcast_within

__all__ = [
    "keyed_state",
    "merge_partials",
    "migration",
    "relocate",
    "route_by_period",
    "route_dkg",
    "route_online",
    "routing_added",
    "routing_dropped",
    "routing_kept",
    "worker_load",
]


def route_online(
    df: DataFrame,
    routing: DataFrame,
    hash_of: Callable[[str], Column],
    routing_rows: float | None = None,
    by: Sequence[str] = ("period",),
    key: str = "key",
) -> DataFrame:
    """Worker from the routing table, by hash where the key is not in it.

    ``routing_rows`` is a bound on the table's rows; within the broadcast limit no row of the
    stream moves. Beyond it both sides shuffle on period and key, and such a group never
    exceeds one period; rows that are dealt out by period need no shuffle with :func:`route_by_period`.
    A NULL key matches the table's NULL key.
    """
    table = routing.select(*[F.col(c).alias(f"_{c}") for c in (*by, key)], F.col("worker").alias("_worker"))
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(key).eqNullSafe(F.col(f"_{key}"))]
    routed = df.join(broadcast_within(table, routing_rows), same, "left")
    return routed.select(*df.columns, F.coalesce("_worker", hash_of(key)).alias("worker"))


def route_by_period(
    df: DataFrame, routing: DataFrame, hash_of: Callable[[str], Column], keys_per_period: int, key: str = "key"
) -> DataFrame:
    """:func:`route_online` for rows that are dealt out by period already, and a table of any size.

    The table is folded to one row for each period: slots by hash, each a map of the few keys that
    fall into it. It joins on the period alone, so the rows stay where they are, and a lookup reads one slot.
    A placement leaves one task, whose single partition would serve every grouping, so the table is dealt out before it is folded.
    """
    routing = routing.repartition("period")
    slots = max(1, min(256, keys_per_period // 2))
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    entry = F.when(F.col(key).isNotNull(), F.struct(key, "worker"))
    found = routing.groupBy("period", slot.alias("_slot")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_map"), F.max(F.when(F.col(key).isNull(), F.col("worker"))).alias("_null")
    )
    at = lambda i: F.try_element_at("_maps", i)
    folded = (
        found.groupBy("period")
        .agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_map"))).alias("_maps"), F.max("_null").alias("_null"))
        .select(F.col("period").alias("_period"), F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), at).alias("_slots"), "_null")
    )
    routed = df.join(folded.hint("shuffle_hash"), F.col("period") == F.col("_period"), "left")
    placed = F.when(F.col(key).isNull(), F.col("_null")).otherwise(F.try_element_at(F.get("_slots", slot), F.col(key)))
    return routed.select(*df.columns, F.coalesce(placed, hash_of(key)).alias("worker"))


def route_dkg(
    df: DataFrame,
    heavy_map: DataFrame,
    bucket_map: DataFrame,
    bucket_of: Callable[[str], Column],
    heavy_rows: float | None = None,
    bucket_rows: int | None = None,
    key: str = "key",
) -> DataFrame:
    """Worker of the key itself if it was placed, else of its hash bucket."""
    heavy = broadcast_within(heavy_map.select(F.col(key).alias("_key"), F.col("worker").alias("_h")), heavy_rows)
    buckets = broadcast_within(bucket_map.select(F.col("bucket").alias("_b"), F.col("worker").alias("_w")), bucket_rows)
    return (
        df.withColumn("_b", bucket_of(key))
        .join(buckets, "_b", "left")
        .join(heavy, F.col(key).eqNullSafe(F.col("_key")), "left")
        .select(*df.columns, F.coalesce("_h", "_w").alias("worker"))
    )


def migration(routing: DataFrame, last_period: int | Column | None = None, key: str = "key") -> DataFrame:
    """Successive routing tables compared: ``(period, key, before, after, moved)``.

    Keys only in the old table have no ``after``, keys only in the new one no ``before``.
    All periods at once, by joining each period with the one before it.
    """
    if last_period is None:
        last_period = routing.agg(F.max("period")).scalar()
    elif isinstance(last_period, int):
        last_period = F.lit(last_period)
    old = routing.select((F.col("period") + 1).alias("period"), key, F.col("worker").alias("before")).where(
        F.col("period") <= last_period
    )
    new = routing.select("period", key, F.col("worker").alias("after"))
    return compare_tables(old, new, ["period", key])


def compare_tables(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer comparison of ``(..., before)`` and ``(..., after)``."""
    moved = ~F.col("before").eqNullSafe(F.col("after"))
    return old.join(new, list(on), "full").select(*on, "before", "after", moved.alias("moved"))


def _previous(routing: DataFrame, key: str) -> DataFrame:
    return routing.select((F.col("period") + 1).alias("period"), key, F.col("worker").alias("before"))


def routing_kept(routing: DataFrame, key: str = "key") -> DataFrame:
    """Keys in a table and the one before it, with whether they moved."""
    new = routing.select("period", key, F.col("worker").alias("after"))
    kept = _previous(routing, key).join(new, ["period", key])
    return kept.withColumn("moved", F.col("before") != F.col("after"))


def routing_dropped(routing: DataFrame, last_period: Column | None = None, key: str = "key") -> DataFrame:
    """Keys of a table that the next one lacks, under the next one's period."""
    if last_period is None:
        last_period = routing.agg(F.max("period")).scalar()
    old = _previous(routing, key).where(F.col("period") <= last_period)
    return old.join(routing.select("period", key), ["period", key], "left_anti")


def routing_added(routing: DataFrame, key: str = "key") -> DataFrame:
    """Keys of a table that the one before it lacks."""
    new = routing.select("period", key, F.col("worker").alias("after"))
    return new.join(_previous(routing, key).select("period", key), ["period", key], "left_anti")


def keyed_state(routed: DataFrame, key: str = "key") -> DataFrame:
    """Rows of each key on each worker: the state kept there."""
    return routed.groupBy("worker", key).agg(F.count("*").alias("cnt"))


def merge_partials(state: DataFrame, key: str = "key") -> DataFrame:
    """Total per key, over all workers that hold a part of it."""
    return state.groupBy(key).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("workers"))


def relocate(
    state: DataFrame,
    plan: DataFrame,
    hash_of: Callable[[str], Column],
    plan_rows: float | None = None,
    key: str = "key",
) -> DataFrame:
    """Move keyed state to its new owner: ``after`` of the plan, by hash where there is none.

    Keys outside the plan belong to their hash worker as well, wherever parts of them were
    kept. Parts that meet on a worker are added up.
    """
    targets = broadcast_within(plan.select(key, F.col("after").alias("_after")), plan_rows)
    return (
        state.join(targets, key, "left")
        .select(F.coalesce("_after", hash_of(key)).alias("worker"), key, "cnt")
        .groupBy("worker", key).agg(F.sum("cnt").alias("cnt"))
    )
