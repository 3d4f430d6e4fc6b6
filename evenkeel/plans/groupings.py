"""Four grouping strategies and user-supplied ones: ``assign(df)`` adds ``worker``.

``df`` needs ``key`` and, for all but static hashing, a dense ``seq``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.hashing import KeyHash, key_hash, murmur_candidates, murmur_hash
from evenkeel.operators import placement, routing, shape, sketches
from evenkeel.operators.carry import carry_loads, gathered, pack_choice
from evenkeel.operators.metrics import balance, worker_load
from evenkeel.scratch import BROADCAST_BYTES, pin

# Rows of one source that one task replays in order.
CHUNK_ROWS = 1 << 17
# Rows, about, of all chunks that one task puts together; a worker holds eight bytes for each.
GATHER_ROWS = 1 << 20


@runtime_checkable
class Grouping(Protocol):
    """What a strategy offers; users may supply their own."""

    name: str
    k: int

    def assign(self, df: DataFrame) -> DataFrame:
        """The rows to route, with their ``worker``."""
        ...


@dataclass(frozen=True)
class HashGrouping:
    """Static hashing; ``murmur=True`` uses seeded Murmur3 instead of the 2-universal family."""

    k: int
    murmur: bool = False
    name: str = "hash"

    def assign(self, df: DataFrame) -> DataFrame:
        worker = murmur_hash(F.col("key"), self.k) if self.murmur else key_hash(df, self.k)("key")
        return df.withColumn("worker", worker)


@dataclass(frozen=True)
class TwoChoiceGrouping:
    """The less loaded of two hashed workers, by loads local to the source.

    Rows go round robin to ``s`` sources, or keep the ``source`` and ``pos`` they have if ``s``
    is None. Only (source, position, candidates) enters the ordered part, packed in one array
    per chunk; the chosen workers come back by a join on the chunk.
    """

    k: int
    s: int | None = 1
    chunk_rows: int = CHUNK_ROWS
    murmur: bool = False
    name: str = "two_choice"

    def candidates(self, df: DataFrame) -> tuple[Column, Column]:
        """The two workers of each key, by the 2-universal family or seeded Murmur3."""
        if self.murmur:
            pair = murmur_candidates(F.col("key"), self.k)
            return pair[0], pair[1]
        return key_hash(df, self.k)("key"), key_hash(df, self.k, member=1)("key")

    def assign(self, df: DataFrame, initial: DataFrame | None = None, first_pos: int = 0) -> DataFrame:
        chosen = self._run(df, initial, first_pos)
        source, chunk, offset = self._places(first_pos)
        # A byte or four per row on the right: hashed per partition, and the rows need no sort. What is
        # made of a row's number is made on both sides of the exchange and does not travel.
        answers = chosen.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.col("chosen").alias("_chosen"))
        routed = df.join(answers.hint("shuffle_hash"), (source == F.col("_source")) & (chunk == F.col("_chunk")))
        given = [c for c in df.columns if c != "source"]
        return routed.select(*given, source.alias("source"), F.col("_chosen")[offset].cast("int").alias("worker"))

    def loads(self, df: DataFrame, initial: DataFrame | None = None, first_pos: int = 0) -> DataFrame:
        """Rows added to each worker by each source: ``(source, worker, load)``."""
        chosen = self._run(df, initial, first_pos)
        return (
            chosen.select("source", F.posexplode("added").alias("worker", "load"))
            .groupBy("source", "worker").agg(F.sum("load").alias("load"))
        )

    def _places(self, first_pos: int, seq: Column | None = None) -> tuple[Column, Column, Column]:
        """Source, chunk and place in the chunk of each row."""
        seq = F.col("seq") if seq is None else seq
        source = F.col("source") if self.s is None else F.pmod(seq, F.lit(self.s)).cast("int")
        pos = F.col("pos") if self.s is None else shape.whole_div(seq, self.s)
        place = pos - first_pos
        return source, shape.whole_div(place, self.chunk_rows), F.pmod(place, F.lit(self.chunk_rows)).cast("int")

    def _run(self, df: DataFrame, initial: DataFrame | None, first_pos: int) -> DataFrame:
        number = F.col("pos") if self.s is None else F.col("seq")
        last, rows = df.agg(F.coalesce(F.max(number), F.lit(-1)), F.count("*")).first()
        last_pos = int(last) if self.s is None else int(last) // self.s
        first, second = self.candidates(df)
        # One number moves for each row, its number and its candidates, from which all else is made. A row
        # without a number or a source has no place in a chunk, nor do rows meet it again.
        pairs = self.k * self.k
        code = first.cast("bigint") * self.k + second
        if self.s is None:
            moved = df.where("source IS NOT NULL AND pos IS NOT NULL").select("source", "pos", code.alias("_code"))
        else:
            if last_pos >= (1 << 63) // pairs // self.s - 1:
                raise ValueError(f"row numbers are too large for {self.k} workers")
            both = F.col("_both")
            moved = df.where("seq IS NOT NULL").select((F.col("seq") * pairs + code).alias("_both"))
            seq = shape.whole_div(both, pairs)
        source, chunk, offset = self._places(first_pos, None if self.s is None else seq)
        moved = moved.repartition(self._tasks(df.sparkSession, rows), source, chunk)
        code = F.col("_code") if self.s is None else F.pmod(both, F.lit(pairs))
        moved = moved.select(source.alias("source"), chunk.alias("chunk"), pack_choice(offset, code).alias("op"))
        count = (last_pos - first_pos) // self.chunk_rows + 1
        return carry_loads(gathered(moved), self.k, count, initial)

    def _tasks(self, spark: SparkSession, rows: int) -> int:
        """Tasks that put chunks together: more where there are more rows, so that none of them grows, but not many more than chunks."""
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return min(rows // self.chunk_rows + (self.s or 1) + 1, max(usual, math.ceil(rows / GATHER_ROWS)))


@dataclass(frozen=True)
class LearnedGrouping:
    """Learn the key distribution from the first rows, place once, route all rows by that.

    Heavy keys and ``ceil(k*factor)`` hash buckets are placed longest first, from the first ``learn``
    rows, or from all if there are fewer. ``learned='discard'`` does not route the rows it
    learned from, nor ``skip`` more; with no more rows than that it routes nothing.
    """

    k: int
    theta: float
    factor: float = 2.0
    learn: int = 80_000
    eps_factor: float = 2.0
    learned: str = "route"
    skip: int = 0
    mode: str = "exact"
    name: str = "dkg"

    def __post_init__(self) -> None:
        if self.learned not in ("route", "discard"):
            raise ValueError("learned is 'route' or 'discard'")

    @property
    def buckets(self) -> int:
        return math.ceil(self.k * self.factor)

    def bucket_hash(self, df: DataFrame) -> KeyHash:
        return key_hash(df, self.buckets)

    def learning(self, df: DataFrame) -> DataFrame:
        """The rows to learn from."""
        return shape.prefix(df, self.learn)

    def to_route(self, df: DataFrame) -> DataFrame:
        return df if self.learned == "route" else shape.split_learning(df, self.learn, self.skip)[1]

    def items(self, learned: DataFrame) -> DataFrame:
        """Heavy keys and all sparse buckets, empty ones too, of the learned rows."""
        if self.mode == "exact":
            return self.items_of_counts(sketches.key_counts(learned, ()))
        bucket_of = self.bucket_hash(learned)
        eps = self.theta / self.eps_factor
        heavy = sketches.heavy_hitters(learned, self.theta, eps, (), self.mode)
        hist = sketches.bucket_hist(learned, self.buckets, bucket_of, ())
        return self._with_all_buckets(placement.placement_items(heavy, sketches.sparse_buckets(hist, heavy, bucket_of, ())))

    def items_of_counts(self, counts: DataFrame) -> DataFrame:
        """The same from the counted rows of each key."""
        reached = F.col("cnt") >= F.ceil(F.lit(self.theta) * counts.agg(F.sum("cnt")).scalar())
        return self._with_all_buckets(sketches.items_from_counts(counts, reached, self.bucket_hash(counts)))

    def _with_all_buckets(self, found: DataFrame) -> DataFrame:
        every = found.sparkSession.range(self.buckets).select(
            F.lit("bucket").alias("kind"),
            F.lit(None).cast(found.schema["key"].dataType).alias("key"),
            F.col("id").cast("int").alias("bucket"),
            F.lit(0).cast("bigint").alias("cnt"),
        )
        return found.unionByName(every).groupBy("kind", "key", "bucket").agg(F.sum("cnt").alias("cnt"))

    def maps(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two small maps, from one placement that is written once."""
        return placement.split_maps(pin(placement.place_lpt(self.items(self.learning(df)), self.k), "maps"))

    def route(self, rows: DataFrame, heavy_map: DataFrame, bucket_map: DataFrame) -> DataFrame:
        # At most 1/theta keys can reach the threshold, so both maps have a known bound.
        return routing.route_dkg(
            rows, heavy_map, bucket_map, self.bucket_hash(rows), 1 / self.theta, self.buckets
        )

    def assign(self, df: DataFrame) -> DataFrame:
        return self.route(self.to_route(df), *self.maps(df))


@dataclass(frozen=True)
class OnlineGrouping:
    """Re-learn every period: sketch per source, merge, place, route the same rows.

    Each of ``s`` round-robin sources has ``m`` rows per period. The result has ``source``,
    ``period`` and ``worker``. The rows of an incomplete last period are routed by what they
    show; ``tail='drop'`` leaves them out.
    """

    k: int
    s: int
    m: int
    theta: float
    eps: float | None = None
    order: str = "key"
    tail: str = "flush"
    mode: str = "exact"
    name: str = "online"

    @property
    def heavy_per_period(self) -> int:
        return math.ceil(self.s / self.theta)

    def _dense(self, df: DataFrame) -> tuple[int, Column]:
        """Number of periods, and of the rows of a source in its period, by the number of rows."""
        rows = shape.last_seq(df) + 1
        size = self.s * self.m
        last = rows // size + 1
        # Sources take turns, so the first ones have one row more in an incomplete period.
        short = F.ceil((F.lit(rows % size) - F.col("source")) / self.s)
        n = F.when(F.col("period") == last, short).otherwise(self.m) if rows % size else F.lit(self.m)
        return (last if rows % size and self.tail == "flush" else last - 1), n

    def stage(self, df: DataFrame, periods: int | None = None) -> DataFrame:
        """Rows with source and period; pass the number of periods if it is known."""
        staged = shape.with_period(shape.with_source(df, self.s), self.s, self.m)
        rows = None if periods is None else periods * self.s * self.m
        return shape.complete_only(staged, self.s, self.m, self.tail, rows=rows)

    def periods(self, df: DataFrame) -> int:
        return self._dense(df)[0]

    def items(self, staged: DataFrame, n: Column | None = None, placed: bool = False) -> DataFrame:
        """Merged heavy keys and sparse buckets per period, as one item list.

        ``n`` is the number of rows of a source in a period, counted if not given.
        """
        bucket_of = key_hash(staged, self.k)
        if self.mode == "exact":
            return sketches.items_from_rows(staged, self.theta, n, bucket_of, placed=placed)
        heavy = sketches.heavy_hitters(staged, self.theta, self.eps, mode=self.mode)
        hist = sketches.bucket_hist(staged, self.k, bucket_of)
        merged = sketches.merge_sketches(heavy, sketches.sparse_buckets(hist, heavy, bucket_of))
        return placement.placement_items(*merged, by=["period"])

    def place(self, items: DataFrame, initial: Sequence[int] | None = None, timed: bool = False) -> DataFrame:
        return placement.place_online(items, self.k, self.order, initial, timed)

    def routing(self, df: DataFrame) -> DataFrame:
        """The routing tables of all periods: ``(period, key, worker, cnt)``."""
        periods, n = self._dense(df)
        return self.place(self.items(self.stage(df, periods), n))

    def route(self, staged: DataFrame, table: DataFrame, periods: int) -> DataFrame:
        rows = periods * self.heavy_per_period
        return routing.route_online(staged, table, key_hash(staged, self.k), rows)

    def assign(self, df: DataFrame) -> DataFrame:
        periods, n = self._dense(df)
        staged = self.stage(df, periods)
        # Three columns of eight bytes, texts being longer.
        if periods * self.heavy_per_period * 24 <= BROADCAST_BYTES:
            return self.route(staged, self.place(self.items(staged, n)), periods)
        return self.assign_in_place(staged, n)

    def assign_in_place(self, staged: DataFrame, n: Column | None = None) -> DataFrame:
        """Learn from and route rows that are dealt out by period once, for tables too large to send."""
        placed = staged.repartition("period")
        table = self.place(self.items(placed, n, placed=True))
        return routing.route_by_period(placed, table, key_hash(placed, self.k), self.heavy_per_period)


@dataclass(frozen=True)
class ColumnGrouping:
    """A user's rule given as a Column expression of the key."""

    k: int
    rule: Callable[[Column], Column]
    name: str = "custom"

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("worker", self.rule(F.col("key")).cast("int"))


@dataclass(frozen=True)
class PandasGrouping:
    """A user's order-dependent rule as a pandas function over one count window.

    ``rule`` gets the rows of a (source, period) in ``seq`` order and returns their workers;
    a group has at most ``m`` rows.
    """

    k: int
    s: int
    m: int
    rule: Callable[[pd.DataFrame], Iterable[int]] = field(repr=False)
    name: str = "custom_ordered"

    def assign(self, df: DataFrame) -> DataFrame:
        staged = shape.with_period(shape.with_source(df, self.s), self.s, self.m)
        schema = T.StructType([*staged.schema.fields, T.StructField("worker", T.IntegerType())])
        rule = self.rule

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq")
            return pdf.assign(worker=list(rule(pdf)))

        return staged.groupBy("source", "period").applyInPandas(choose, schema)


def compare(df: DataFrame, groupings: Sequence[Grouping]) -> DataFrame:
    """Balance of each strategy on the same input, one row per strategy."""
    parts = [
        balance(worker_load(g.assign(df), g.k), g.k).withColumn("strategy", F.lit(g.name)) for g in groupings
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("strategy", "total", "max_load", "avg_load", "imbalance", "sigma")
