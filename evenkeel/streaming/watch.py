"""Durations and observed metrics of micro-batches, as a listener gets them, batch for batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

DELAYS = "source int, period bigint, delay_us bigint"


class Watch(StreamingQueryListener):
    """Notes each batch of one query; durations are written some at a time, so any number can be kept.

    ``expect_equal`` names two columns of an observed metric; a batch in which they differ stops the query.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100, metric: str | None = None, expect_equal: tuple[str, str] = ("", "")):
        self.spark, self.path, self.every = spark, path, every
        self.metric, self.expect_equal = metric, expect_equal
        self.query: StreamingQuery | None = None
        self.early: list = []
        self.rows: list[tuple[int, int, int]] = []
        self.wrong: str | None = None
        self.ended = threading.Event()

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        self.query = query
        for event in self.early:
            self.onQueryProgress(event)
        self.early = []
        return query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.query is None:
            self.early.append(event)
            return
        if str(progress.runId) != str(self.query.runId):
            return
        self.rows.append((0, int(progress.batchId), int(progress.durationMs.get("triggerExecution", 0)) * 1000))
        seen = progress.observedMetrics.get(self.metric) if self.metric else None
        if seen is not None:
            a, b = (seen[c] or 0 for c in self.expect_equal)
            if a != b:
                self.wrong = f"batch {progress.batchId}: {self.expect_equal[0]} is {a}, {self.expect_equal[1]} is {b}"
                self.query.stop()
        if len(self.rows) >= self.every:
            self.write()

    def onQueryTerminated(self, event) -> None:
        if self.query is None or str(event.runId) == str(self.query.runId):
            self.ended.set()

    def write(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, DELAYS).coalesce(1).write.mode("append").parquet(self.path)

    def finish(self) -> None:
        """Wait for the query and its last event, write what is left, and fail if a metric was wrong."""
        self.query.awaitTermination()
        self.ended.wait(30)
        self.spark.streams.removeListener(self)
        self.write()
        if self.wrong:
            raise RuntimeError(self.wrong)


def watched(spark: SparkSession, path: str, **options) -> Watch:
    """A listener that is registered; give it its query with :meth:`Watch.follow`."""
    watch = Watch(spark, path, **options)
    spark.streams.addListener(watch)
    return watch


def batch_delays(spark: SparkSession, path: str) -> DataFrame:
    """Duration of every batch that was written: ``(source, period, delay_us)``, one source."""
    return spark.read.schema(DELAYS).parquet(path)
