"""The grouping strategies on live streams.

Each runner consumes a streaming DataFrame of ``(seq, key)`` and more columns if there are any.
``run(stream)`` processes what is available and stops; run again, on the same folder, it goes on with what
has come since. ``start(stream, trigger)`` keeps going. Output goes through Spark's file sink and what
waits is in Spark's state store, so each row is given once whatever fails. ``drained()`` adds what
still waits when the input has ended. Results equal the batch strategies on the same rows.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.hashing import key_hash
from evenkeel.operators import placement, routing, shape
from evenkeel.operators.metrics import balance, period_worker_load, worker_load
from evenkeel.plans.groupings import Grouping, HashGrouping, LearnedGrouping, OnlineGrouping, TwoChoiceGrouping
from evenkeel.streaming.state import (
    Carried,
    PlacedPeriods,
    SketchedPeriods,
    TwoChoiceRows,
    Windows,
    has_finished_a_batch,
    in_state,
    rocksdb,
    unfolded,
)
from evenkeel.streaming.watch import Watch, batch_delays, watched


def table_at(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What a file sink has written so far, nothing if it has not begun."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


@dataclass
class _Runner:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _see(self, stream: DataFrame) -> None:
        self.spark, self.schema = stream.sparkSession, stream.schema

    def _query(self, out: DataFrame, table: str, by: tuple[str, ...] = (), watch: dict | None = None, **trigger) -> Watch:
        """Write a stream to a folder of files, watched."""
        follower = watched(self.spark, self.path(f"delays-{table}"), **(watch or {}))
        with rocksdb(self.spark):
            writer = out.writeStream.format("parquet").partitionBy(*by).option("path", self.path(table))
            writer = writer.option("checkpointLocation", self.path(f"checkpoint-{table}"))
            follower.follow(writer.trigger(**(trigger or {"availableNow": True})).start())
        return follower

    def start(self, stream: DataFrame, **trigger) -> list[Watch]:
        """Start the queries; ``trigger`` is passed on, ``availableNow=True`` unless given."""
        raise NotImplementedError

    def run(self, stream: DataFrame) -> "_Runner":
        for watch in self.start(stream):
            watch.finish()
        return self

    def delays(self, table: str | None = None) -> DataFrame:
        """How long each batch took that wrote a table (``routing``: building the tables): ``(source, period, delay_us)``."""
        return batch_delays(self.spark, self.path(f"delays-{table or self._main}"))


def stream_hash(stream: DataFrame, grouping: HashGrouping, root: str) -> DataFrame:
    """Stateless grouping of a stream into a file sink; returns the written rows."""
    routed = grouping.assign(stream)
    query = (
        routed.writeStream.format("parquet")
        .option("path", f"{root}/routed")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(routed.schema).parquet(f"{root}/routed")


@dataclass
class CountWindows(_Runner):
    """Emits the rows of a count window of a source when all ``m`` have arrived."""

    s: int
    m: int
    _main = "windows"

    def start(self, stream: DataFrame, **trigger) -> list[Watch]:
        self._see(stream)
        carried = Carried(stream.schema)
        staged = shape.with_period(shape.with_source(stream, self.s), self.s, self.m)
        full = (
            carried.packed(staged, F.col("source"), F.col("period"))
            .groupBy("source", "period")
            .transformWithStateInPandas(
                statefulProcessor=Windows(self.m, carried, ["source", "period"]),
                outputStructType=f"source int, period bigint, {carried.flat}",
                outputMode="Append",
                timeMode="None",
            )
        )
        return [self._query(full.select(*carried.restored(), "source", "period"), "windows", **trigger)]

    def _schema(self) -> T.StructType:
        return T.StructType([*Carried.in_order(self.schema), T.StructField("source", T.IntegerType()), T.StructField("period", T.LongType())])

    def result(self) -> DataFrame:
        """Rows of complete windows."""
        return table_at(self.spark, self.path("windows"), self._schema())

    def drained(self) -> DataFrame:
        """After the input has ended: every row, those of incomplete windows too."""
        carried, waiting = Carried(self.schema), in_state(self.spark, self.path("checkpoint-windows"), "rows")
        if waiting is None:
            return self.result()
        rest = unfolded(waiting, "list_element", [F.col("key.source"), F.col("key.period")], ["seq", *carried.names])
        return self.result().unionByName(rest.select(*carried.restored(), "source", "period"))


@dataclass
class OnlineStream(_Runner):
    """Learn each period, place, and route the same rows; loads and tables pass between batches.

    Two queries. The first gathers periods: when all rows of one have arrived it gives them, with one
    sketch row. The second takes the sketches in order of their periods and writes routing tables.
    Routed rows, migration plans and barrier statistics follow from these two tables.
    """

    grouping: OnlineGrouping
    _main = "periods"

    def start(self, stream: DataFrame, **trigger) -> list[Watch]:
        self._see(stream)
        g, carried = self.grouping, Carried(stream.schema)
        staged = shape.with_period(shape.with_source(stream, g.s), g.s, g.m)
        bucket = key_hash(stream, g.k)("key").alias("bucket")
        gather = SketchedPeriods(g.s, g.m, g.k, math.ceil(g.theta * g.m), g.order == "load", carried)
        block = shape.whole_div("period", SketchedPeriods.periods_together(g.s, g.m)).alias("_block")
        periods = (
            carried.packed(staged, block, F.col("period"), F.col("source"), bucket)
            .groupBy("_block")
            .transformWithStateInPandas(
                statefulProcessor=gather, outputStructType=SketchedPeriods.schema(carried), outputMode="Append", timeMode="None"
            )
        )
        # No row may get lost between the rows of a batch and its sketches.
        whole = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)
        mass = F.sum(F.when(F.col("kind") == "sketch", whole(F.col("light")) + whole(F.col("counts"))))
        periods = periods.observe("mass", F.count(F.when(F.col("kind") == "row", 1)).alias("rows"), mass.alias("mass"))
        check = {"metric": "mass", "expect_equal": ("rows", "mass")}
        first = self._query(periods, "periods", ("kind",), check, **trigger)
        while not self._begun() and first.query.isActive:
            time.sleep(0.1)
        if not self._begun():
            return [first]
        if not trigger:
            # What is available to the second query is what the first one has written.
            first.query.awaitTermination()
        sketches = self.spark.readStream.schema(self._periods_schema()).parquet(self.path("periods")).where("kind = 'sketch'")
        placed = (
            sketches.select(F.lit(0).alias("all"), "period", "light", "heavy", "counts")
            .groupBy("all")
            .transformWithStateInPandas(
                statefulProcessor=PlacedPeriods(g.k), outputStructType=PlacedPeriods.OUT, outputMode="Append", timeMode="None"
            )
        )
        key = F.col("key").cast(stream.schema["key"].dataType)
        return [first, self._query(placed.withColumn("key", key), "routing", **trigger)]

    def _begun(self) -> bool:
        return has_finished_a_batch(self.spark, self.path("checkpoint-periods"))

    def _periods_schema(self) -> T.StructType:
        return T._parse_datatype_string(SketchedPeriods.schema(Carried(self.schema)))

    def _gathered(self) -> DataFrame:
        """Rows of complete periods."""
        rows = table_at(self.spark, self.path("periods"), self._periods_schema()).where("kind = 'row'")
        return rows.select(*Carried(self.schema).restored(), "source", "period")

    def _tables(self) -> DataFrame:
        fields = [T.StructField("period", T.LongType()), self.schema["key"], T.StructField("worker", T.IntegerType()), T.StructField("cnt", T.LongType())]
        return table_at(self.spark, self.path("routing"), T.StructType(fields))

    def _done(self) -> DataFrame:
        return self._tables().where("cnt IS NULL").select("period")

    def routing(self) -> DataFrame:
        """Tables of the periods that were placed: ``(period, key, worker, cnt)``."""
        return self._tables().where("cnt IS NOT NULL")

    def _last(self) -> int:
        return int(self._done().agg(F.coalesce(F.max("period"), F.lit(0))).first()[0])

    def result(self) -> DataFrame:
        """Rows of complete periods, all earlier ones of which are complete."""
        last = self._last()
        due = self._gathered().where(F.col("period") <= last)
        return self.grouping.route(due, self.routing(), last)

    def barrier(self) -> DataFrame:
        """Per period and worker: rows in the period, rows so far."""
        return period_worker_load(self.result(), self.grouping.k)

    def migration(self) -> DataFrame:
        return routing.migration(self.routing().select("period", "key", "worker"), self._last())

    def drained(self) -> DataFrame:
        """After the input has ended: all routed rows, with ``tail='flush'`` the waiting ones too.

        Waiting rows form incomplete periods, or wait behind one; they are learned from and routed like the others.
        """
        g, carried = self.grouping, Carried(self.schema)
        waiting = in_state(self.spark, self.path("checkpoint-periods"), "rows")
        if g.tail != "flush" or waiting is None:
            return self.result()
        last = self._last()
        names = ["seq", *carried.names, "source"]
        rest = unfolded(waiting, "user_map_value", [F.col("user_map_key.period").alias("period")], names).select(*carried.restored(), "source", "period")
        rest = rest.unionByName(self._gathered().where(F.col("period") > last))
        at = in_state(self.spark, self.path("checkpoint-routing"), "at")
        loads = at.select("value.loads").first() if at is not None else None
        table = g.place(g.items(rest), list(loads[0]) if loads else None)
        top = int(rest.agg(F.coalesce(F.max("period"), F.lit(last))).first()[0])
        return self.result().unionByName(g.route(rest, table, top - last))


@dataclass
class TwoChoiceStream(_Runner):
    """Less loaded of two workers, each source's loads carried from batch to batch.

    Rows are replayed in ``seq`` order in windows of ``window`` rows per source; the rows of an
    unfinished window, or behind one, are routed when the input has ended.
    """

    grouping: TwoChoiceGrouping
    window: int = 1000
    _main = "routed"

    def _pos(self) -> Column:
        return shape.whole_div("seq", self.grouping.s)

    def start(self, stream: DataFrame, **trigger) -> list[Watch]:
        self._see(stream)
        g, carried = self.grouping, Carried(stream.schema)
        first, second = g.candidates(stream)
        code = (first * g.k + second).cast("int").alias("code")
        routed = (
            carried.packed(shape.with_source(stream, g.s), F.col("source"), self._pos().alias("pos"), code)
            .groupBy("source")
            .transformWithStateInPandas(
                statefulProcessor=TwoChoiceRows(g.k, self.window, carried),
                outputStructType=f"{carried.flat}, source int, worker int",
                outputMode="Append",
                timeMode="None",
            )
        )
        return [self._query(routed.select(*carried.restored(), "source", "worker"), "routed", **trigger)]

    def result(self) -> DataFrame:
        """Rows routed so far."""
        schema = T.StructType([*Carried.in_order(self.schema), T.StructField("source", T.IntegerType()), T.StructField("worker", T.IntegerType())])
        return table_at(self.spark, self.path("routed"), schema)

    def drained(self) -> DataFrame:
        """After the input has ended: every row routed."""
        g, carried, checkpoint = self.grouping, Carried(self.schema), self.path("checkpoint-routed")
        waiting, at = (in_state(self.spark, checkpoint, name) for name in ("waiting", "at"))
        if waiting is None:
            return self.result()
        rest = unfolded(waiting, "user_map_value", [F.col("key.source").alias("source")], ["seq", *carried.names])
        at = at.select(F.col("key.source").alias("source"), "value.done", "value.loads")
        pos = (self._pos() - F.col("done") * self.window).alias("pos")
        rest = rest.select(*carried.restored(), "source").join(F.broadcast(at.select("source", "done")), "source")
        rest = rest.select(*self.schema.names, "source", pos)
        out = replace(g, s=None).assign(rest, at.select("source", "loads"))
        return self.result().unionByName(out.select(*self.result().columns))


@dataclass
class LearnedStream(_Runner):
    """Learns from the first rows, then routes; rows wait at the source until the maps exist.

    The first query counts keys of the rows to learn from, in Spark's state. When all of them have
    come the maps are written, and the second query, which starts from the beginning of the input,
    routes by them.
    """

    grouping: LearnedGrouping
    _main = "routed"

    def start(self, stream: DataFrame, **trigger) -> list[Watch]:
        self._see(stream)
        self.stream = stream
        if self._maps() is None:
            self._learn(stream)
            if self._counted() >= self.grouping.learn:
                self._write_maps()
        return [self._route(stream, **trigger)] if self._maps() is not None else []

    def _learn(self, stream: DataFrame) -> None:
        counts = self.grouping.learning(stream).groupBy("key").agg(F.count("*").alias("cnt"))
        query = (
            counts.writeStream.outputMode("complete")
            .foreachBatch(lambda all_counts, _: all_counts.write.mode("overwrite").parquet(self.path("counts")))
            .option("checkpointLocation", self.path("checkpoint-counts"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _counts(self) -> DataFrame:
        return table_at(self.spark, self.path("counts"), T.StructType([self.schema["key"], T.StructField("cnt", T.LongType())]))

    def _counted(self) -> int:
        return int(self._counts().agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0])

    def _write_maps(self) -> None:
        placed = placement.place_lpt(self.grouping.items_of_counts(self._counts()), self.grouping.k)
        placed.write.mode("overwrite").parquet(self.path("maps"))

    def _maps(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path("maps"))
        except AnalysisException:
            return None

    def _route(self, stream: DataFrame, **trigger) -> Watch:
        g = self.grouping
        routed = g.route(g.to_route(stream), *placement.split_maps(self._maps()))
        return self._query(routed, "routed", **trigger)

    def result(self) -> DataFrame:
        """Rows routed so far."""
        return table_at(self.spark, self.path("routed"), T.StructType([*self.schema.fields, T.StructField("worker", T.IntegerType())]))

    def drained(self) -> DataFrame:
        """After the input has ended: all rows, learned from what there was if that was less than wanted."""
        if self._maps() is None and self._counted():
            self._write_maps()
            self._route(self.stream).finish()
        return self.result()


def stream_keyed_counts(stream: DataFrame, root: str) -> DataFrame:
    """Running count per key in Spark's keyed state; returns the latest count of each key.

    State follows the key, so moving a key to another worker only changes its ``worker``
    column and no state has to travel. Each batch writes the keys it changed, a repeated one in the same place.
    """
    counts = stream.groupBy("key").agg(F.count("*").alias("cnt"))
    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{root}/counts/batch={batch}"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    changes = table_at(stream.sparkSession, f"{root}/counts", counts.schema)
    return changes.groupBy("key").agg(F.max("cnt").alias("cnt"))


def final_balance(routed: DataFrame, grouping: Grouping) -> DataFrame:
    """Loads of a drained stream summed up: total, highest, average, imbalance, deviation."""
    return balance(worker_load(routed, grouping.k), grouping.k)


__all__ = [
    "CountWindows",
    "LearnedStream",
    "OnlineStream",
    "TwoChoiceStream",
    "batch_delays",
    "final_balance",
    "stream_hash",
    "stream_keyed_counts",
]
