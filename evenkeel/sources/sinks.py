"""Period statistics as CSV, and physical delivery of rows to their workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_stats(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Write period statistics as headerless CSV, in period order.

    With a ``batch_id`` only that batch's folder is replaced, so a repeated micro-batch leaves
    one copy of its records.
    """
    target = path if batch_id is None else f"{path}/batch={batch_id}"
    df.repartitionByRange("period").sortWithinPartitions("period").write.mode("overwrite").csv(target)


def deliver(df: DataFrame, k: int, worker_col: str = "worker", splits: int = 1, spread: Column | None = None) -> DataFrame:
    """Place each row in the partition of its worker.

    Partition number divided by ``splits`` is the worker. A worker's rows fill one partition
    unless ``splits`` divides them further, by ``spread`` (by ``seq`` if not given).
    """
    if splits == 1:
        return df.repartitionById(k, F.col(worker_col))
    part = F.pmod(F.col("seq") if spread is None else spread, F.lit(splits))
    return df.repartitionById(k * splits, (F.col(worker_col) * splits + part).cast("int"))


def write_by_worker(df: DataFrame, path: str, worker_col: str = "worker") -> None:
    """One folder per worker, written in place without a shuffle."""
    df.write.mode("overwrite").partitionBy(worker_col).parquet(path)
