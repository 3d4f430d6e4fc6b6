"""Balance metrics over worker loads, in total and per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.shape import whole_div
from evenkeel.operators.sketches import fill_zero

# Steps summed in one window partition; longer series are summed block by block.
BLOCK_STEPS = 100_000


def worker_load(routed: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per worker, workers without rows included: ``(*by, worker, load)``.

    The query fails on a worker that is NULL or not in 0..k-1: no row is left out silently.
    """
    counts = routed.groupBy(*by, "worker").agg(F.count("*").alias("load"))
    wrong = F.raise_error(F.concat(F.lit(f"worker not in 0..{k - 1}: "), F.coalesce(F.col("worker").cast("string"), F.lit("NULL"))))
    known = F.when(F.col("worker").between(0, k - 1), F.col("worker")).otherwise(wrong)
    return fill_zero(counts.withColumn("worker", known), "worker", k, by, "load")


def average_load(total: Column, k: int) -> Column:
    """Average rounded down to a whole number."""
    return whole_div(total, k)


def imbalance(top: Column, average: Column) -> Column:
    """Excess of the highest load over the average, in percent; NULL where the average is 0."""
    return (F.try_divide(top.cast("double"), average.cast("double")) - 1) * 100


def load_summary(loads: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Total, highest and average load per group."""
    return loads.groupBy(*by).agg(F.sum("load").alias("total"), F.max("load").alias("max_load")).withColumn(
        "avg_load", average_load(F.col("total"), k)
    )


def load_imbalance(loads: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return load_summary(loads, k, by).select(*by, imbalance(F.col("max_load"), F.col("avg_load")).alias("imbalance"))


def balance(loads: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Summary, imbalance and deviation around the whole-number average.

    A group is the ``k`` loads of one comparison, so its loads are gathered in one array.
    """
    average = F.col("avg_load")
    squares = F.aggregate(
        F.transform("_loads", lambda x: F.pow((x - average).cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return (
        loads.groupBy(*by)
        .agg(
            F.sum("load").alias("total"),
            F.max("load").alias("max_load"),
            F.array_sort(F.collect_list("load")).alias("_loads"),
        )
        .withColumn("avg_load", average_load(F.col("total"), k))
        .select(
            *by,
            "total",
            "max_load",
            "avg_load",
            imbalance(F.col("max_load"), average).alias("imbalance"),
            F.sqrt(squares / k).alias("sigma"),
        )
    )


def load_stddev(loads: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return balance(loads, k, by).select(*by, "sigma")


def running_sum(
    df: DataFrame, by: Sequence[str], step: str, value: str, name: str, block: int = BLOCK_STEPS
) -> DataFrame:
    """Inclusive running sum of ``value`` over ``step`` per group.

    Blocks of steps are summed first and their prefix sums added, so that no window partition
    holds more than ``block`` steps however long the series gets.
    """
    blocked = df.withColumn("_block", whole_div(step, block))
    inside = Window.partitionBy(*by, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    return (
        blocked.withColumn("_within", F.sum(value).over(inside))
        .join(offsets, [*by, "_block"])
        .withColumn(name, F.col("_within") + F.col("_before"))
        .select(*df.columns, name)
    )


def period_worker_load(routed: DataFrame, k: int) -> DataFrame:
    """Rows of each worker in each period and so far: ``(period, worker, load, total)``."""
    per_period = worker_load(routed, k, ["period"])
    return running_sum(per_period, ["worker"], "period", "load", "total")


def period_imbalance(routed: DataFrame, k: int) -> DataFrame:
    """Imbalance and deviation of the loads accumulated up to each period."""
    totals = period_worker_load(routed, k).select("period", F.col("total").alias("load"))
    return balance(totals, k, ["period"]).select("period", "imbalance", "sigma")


def compile_stats(
    periods: DataFrame, routing: DataFrame, migration: DataFrame, built: DataFrame | None = None
) -> DataFrame:
    """Size of routing and migration table per period; ``periods`` lists all of them.

    ``built``, ``(period, build_us)``, adds how long building each routing table took.
    """
    counted = (
        periods.select("period", F.lit(0).alias("r"), F.lit(0).alias("m"))
        .unionByName(routing.select("period", F.lit(1).alias("r"), F.lit(0).alias("m")))
        .unionByName(migration.select("period", F.lit(0).alias("r"), F.lit(1).alias("m")))
    )
    sizes = counted.groupBy("period").agg(F.sum("r").alias("routing_size"), F.sum("m").alias("migration_size"))
    return sizes if built is None else sizes.join(built.select("period", "build_us"), "period", "left")


def source_counts(df: DataFrame) -> DataFrame:
    """Rows emitted per source."""
    return df.groupBy("source").agg(F.count("*").alias("cnt"))


def period_spans(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Microseconds between the first and the last row of each source's period."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy("source", "period").agg((F.max(at) - F.min(at)).alias("delay_us"))


def source_delay(delays: DataFrame) -> DataFrame:
    """Mean delay per source, then over sources, both rounded down: ``(sources, delay_us)``."""
    per_source = delays.groupBy("source").agg(F.expr("sum(delay_us) div count(*)").alias("mean_us"))
    return per_source.agg(F.count("*").alias("sources"), F.expr("sum(mean_us) div count(*)").alias("delay_us"))
