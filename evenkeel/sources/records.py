"""Key records (many keys per line) and access logs (one line per request)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.shape import running_offset

_LINE_ORDER = ("_file", "_at", "_line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with what fixes their order: file, split, line within the split."""
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_line"),
        )
        .where(F.length("value") > 0)
    )


def split_keys(value: Column, sep: str = ",", key_type: str = "bigint") -> Column:
    """The keys of one record as an array; a key that is no number fails the job."""
    items = F.split(value, f"\\Q{sep}\\E")
    return F.transform(items, lambda x: F.trim(x).cast(key_type))


def read_key_records(spark: SparkSession, path: str, sep: str = ",", key_type: str = "bigint") -> DataFrame:
    """One row per key as ``(rec, pos, seq, key)``: record, place in it, place in the stream."""
    keys = _lines(spark, path).withColumn("_keys", split_keys(F.col("value"), sep, key_type)).drop("value")
    numbered = running_offset(keys, list(_LINE_ORDER), {"_first": F.size("_keys")}, name="rec")
    return numbered.select("rec", "_first", F.posexplode("_keys").alias("pos", "key")).select(
        "rec", "pos", (F.col("_first") + F.col("pos")).alias("seq"), "key"
    )


def stream_key_records(spark: SparkSession, path: str, sep: str = ",", key_type: str = "bigint") -> DataFrame:
    """Streaming form: ``(key)`` per item; arrival gives no order, so there is no ``seq``."""
    lines = spark.readStream.text(path).where(F.length("value") > 0)
    return lines.select(F.explode(split_keys(F.col("value"), sep, key_type)).alias("key"))


def log_field(value: Column, field: int) -> Column:
    """Field of a space-separated line, NULL if the line is too short."""
    return F.get(F.split(value, " "), F.lit(field))


def access_log_lines(spark: SparkSession, path: str, field: int = 2) -> DataFrame:
    """Every non-empty log line with its ``key``, NULL for short lines."""
    return _lines(spark, path).withColumn("key", log_field(F.col("value"), field))


def read_access_log(
    spark: SparkSession, path: str, field: int = 2, ordered: bool = True, partitions: int | None = None
) -> DataFrame:
    """Keys of an access log (plain or gzip text) as ``(seq, key)``; short lines are left out.

    ``ordered=False`` skips the numbering, which costs a range shuffle, for uses that need no
    order. A gzip file is read by one task: give one file per task, or ``partitions`` to spread
    the rows afterwards.
    """
    rows = access_log_lines(spark, path, field).where(F.col("key").isNotNull())
    if ordered:
        return running_offset(rows.select("key", *_LINE_ORDER), list(_LINE_ORDER)).select("seq", "key")
    return rows.select("key").repartition(partitions) if partitions else rows.select("key")


def short_lines(spark: SparkSession, path: str, field: int = 2) -> DataFrame:
    """How many lines were read and how many had too few fields."""
    return access_log_lines(spark, path, field).agg(
        F.count("*").alias("lines"), F.count_if(F.col("key").isNull()).alias("short_lines")
    )
