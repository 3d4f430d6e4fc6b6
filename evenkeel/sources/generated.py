"""Zipf-distributed keys as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.zipf import zipf_key

# The default number of keys and exponent.
DEFAULT_KEYS = 1_000_000
DEFAULT_EXPONENT = 2.0


def with_zipf_key(df: DataFrame, n: int = DEFAULT_KEYS, z: float = DEFAULT_EXPONENT, seed: int = 1000) -> DataFrame:
    """Give each row a key 1..n with P(x) proportional to 1/x^z, fixed by ``seq`` and ``seed``."""
    return df.withColumn("key", zipf_key(F.col("seq"), n, z, seed))


def zipf(
    spark: SparkSession, rows: int, n: int = DEFAULT_KEYS, z: float = DEFAULT_EXPONENT, seed: int = 1000
) -> DataFrame:
    return with_zipf_key(spark.range(rows).withColumnRenamed("id", "seq"), n, z, seed)


def zipf_stream(
    spark: SparkSession, rows_per_second: int, n: int = DEFAULT_KEYS, z: float = DEFAULT_EXPONENT, seed: int = 1000
) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return with_zipf_key(rate.select(F.col("value").alias("seq")), n, z, seed)
