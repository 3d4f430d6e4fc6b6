"""Shape of a keyed stream: key, source, period, prefix, dense numbering.

Order is carried by ``seq``, never by arrival: every assignment below is arithmetic on it,
so it needs no shuffle and filters on it reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.scratch import pin

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
_ROW_BITS = 33


def whole_div(number: Column | str, by: int) -> Column:
    """Whole-number division, exact for any BIGINT (no detour over DOUBLE)."""
    return F.call_function("div", F.col(number) if isinstance(number, str) else number, F.lit(by))


def with_key(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Key extraction: any Column expression over the record."""
    return df.withColumn(name, key)


def with_source(df: DataFrame, s: int) -> DataFrame:
    """Round robin: row ``seq`` is handled by source ``seq mod s``."""
    return df.withColumn("source", F.pmod("seq", F.lit(s)).cast("int"))


def with_period(df: DataFrame, s: int, m: int) -> DataFrame:
    """Count window of round-robin sources: ``m`` rows per source, numbered from 1."""
    return df.withColumn("period", whole_div("seq", s * m) + 1)


def with_period_by_position(df: DataFrame, m: int) -> DataFrame:
    """Count window where ``pos`` is the row's number within its source."""
    return df.withColumn("period", whole_div("pos", m) + 1)


def prefix(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, by number (deterministic, pushed down to the scan)."""
    return df.where(F.col("seq") < n)


def split_learning(df: DataFrame, learn: int, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and the rows after them, without the next ``skip``."""
    return prefix(df, learn), df.where(F.col("seq") >= learn + skip)


def last_seq(df: DataFrame) -> int:
    """Highest row number, -1 if empty; reads one column of the input."""
    top = df.agg(F.max("seq")).first()[0]
    return -1 if top is None else int(top)


def complete_periods(df: DataFrame, s: int, m: int) -> DataFrame:
    """Periods in which each of the ``s`` sources has ``m`` rows, counted from the rows."""
    return (
        df.groupBy("period", "source").agg(F.count("*").alias("cnt"))
        .where(F.col("cnt") == m)
        .groupBy("period").agg(F.count("*").alias("sources"))
        .where(F.col("sources") == s)
        .select("period")
    )


def complete_only(
    df: DataFrame, s: int, m: int, tail: str = "flush", dense: bool = True, rows: int | None = None
) -> DataFrame:
    """All rows, or with ``tail='drop'`` those of complete periods.

    With a dense ``seq`` only the last period can be incomplete, so the number of rows (looked
    up unless given) decides: a filter on ``seq`` that reaches the scan. Otherwise periods are
    counted and kept by semi join.
    """
    if tail == "flush":
        return df
    if tail != "drop":
        raise ValueError("tail is 'drop' or 'flush'")
    if dense:
        total = df.agg(F.max("seq") + 1).scalar() if rows is None else F.lit(rows)
        return df.where(F.col("seq") < total - F.pmod(total, F.lit(s * m)))
    return df.join(complete_periods(df, s, m), "period", "left_semi")


def running_offset(
    df: DataFrame, order: Sequence[str], weights: dict[str, Column] | None = None, name: str = "seq"
) -> DataFrame:
    """Exclusive prefix sums in the global order of ``order`` (must be unique), without a global window.

    Rows are range partitioned and sorted, and the result is written, which fixes the range
    boundaries. Each partition then needs one number: the total before it. Column ``name``
    numbers the rows; each name in ``weights`` becomes the prefix sum of its expression.
    """
    weights = weights or {}
    sized = df
    for total, weight in weights.items():
        sized = sized.withColumn(f"_w_{total}", weight.cast("bigint"))
    placed = pin(
        sized.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", _ROW_BITS)),
        "order",
    )
    sums = [F.sum(f"_w_{total}").alias(f"_t_{total}") for total in weights]
    totals = placed.groupBy("_part").agg(F.count("*").alias("_t"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select(
        "_part",
        *[
            F.coalesce(F.sum(total).over(before), F.lit(0)).alias(f"_b{total}")
            for total in ["_t", *[f"_t_{w}" for w in weights]]
        ],
    )
    out = placed.join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_b_t") + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    )
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    for total in weights:
        within = F.coalesce(F.sum(f"_w_{total}").over(inside), F.lit(0))
        out = out.withColumn(total, F.col(f"_b_t_{total}") + within)
    return out.select(*df.columns, name, *weights)


def dense_seq(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number rows 0..N-1 in the order of ``order``, whose values must be unique."""
    return running_offset(df, order)


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Number rows 0.. within each group; a group of any size is spread over range partitions."""
    numbered = running_offset(df, [*by, *order], name="_n")
    firsts = numbered.groupBy(*by).agg(F.min("_n").alias("_first"))
    placed = numbered.join(firsts, list(by)).withColumn(name, F.col("_n") - F.col("_first"))
    return placed.select(*df.columns, name)


def words(text: str | Column) -> Column:
    """The whitespace-separated words of a text, as an array."""
    return F.array_remove(F.split(text, r"\s+"), "")


def word_stream(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per word as ``(seq, key, doc_id, pos)``, numbered densely over the whole table.

    Only (document, number of words) is ordered, from a written table, so that the range
    sampling does not split the texts again; the words follow by adding their position. Documents are
    ordered by their id, so an id that is missing or repeated fails.
    """
    sizes = pin(docs.select(doc_id, F.size(words(text)).alias("_words")), "sizes")
    found = sizes.agg(F.count("*"), F.count_distinct(doc_id)).first()
    if found[0] != found[1]:
        raise ValueError(f"{found[0]} documents have {found[1]} different ids in {doc_id}")
    offsets = running_offset(sizes, [doc_id], {"_at": F.col("_words")}).select(doc_id, "_at")
    # The outer form keeps the planner from adding a filter that splits every text once more.
    return (
        docs.select(doc_id, text)
        .join(offsets, doc_id)
        .select(doc_id, "_at", F.posexplode_outer(words(text)).alias("pos", "key"))
        .where(F.col("key").isNotNull())
        .select((F.col("_at") + F.col("pos")).alias("seq"), "key", doc_id, "pos")
    )
