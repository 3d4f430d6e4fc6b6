"""Intermediate tables in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A derived table with more bytes than this is not broadcast by hint.
BROADCAST_BYTES = 16 << 20
# Types whose values have a fixed size; it is at most eight bytes.
_FIXED = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor must reach.

    A session with executors of its own (any cluster, ``local-cluster`` too) has to name it. In
    local mode, where driver and executors are one process, an unset one is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="evenkeel-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/evenkeel-{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str, *partition_by: str, codec: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result is read several times or must not change on recomputation (range
    boundaries, row numbering). A written table survives lost executors, keeps column
    pruning, and gives Catalyst exact sizes, so small ones are broadcast without a hint. ``codec`` is the
    compression, the session's unless given; ``zstd`` halves tables that have a row for each row of a stream.
    ``group_rows`` bounds the rows of a row group, all of which a reader may hold, for rows that are large.
    """
    path = new_folder(df.sparkSession, label)
    options = {"compression": codec, "parquet.block.row.count.limit": group_rows}
    df.write.options(**{name: value for name, value in options.items() if value is not None}).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends ``rows`` rows to a Python worker at once, unless the session names a size itself."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    unset = setting not in spark.conf.getAll
    if unset:
        spark.conf.set(setting, rows)
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(setting)


def table_bytes(df: DataFrame) -> int:
    """Bytes of all values of a table, counted: eight for a number, their length for texts."""
    size = F.lit(0)
    for field in df.schema.fields:
        fixed = isinstance(field.dataType, _FIXED)
        size = size + (F.lit(8) if fixed else F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0)))
    return int(df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0])


def broadcast_within(df: DataFrame, rows: float | None) -> DataFrame:
    """Mark the small side of a join by its bytes; ``rows`` is a proven bound on its rows.

    Numbers have a fixed size, so the bound is enough. Texts may have any, so a table with text is
    written and its bytes are counted. Within the limit it is broadcast. Beyond it both sides shuffle
    and it is the side hashed in memory, a partition at a time, so the large side is at least not
    sorted. Without a bound the choice is Catalyst's.
    """
    if rows is None:
        return df
    fits = rows * 8 * len(df.columns) <= BROADCAST_BYTES
    if fits and not all(isinstance(f.dataType, _FIXED) for f in df.schema.fields):
        df = pin(df, "lookup")
        fits = table_bytes(df) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df.hint("shuffle_hash")
