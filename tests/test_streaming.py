"""Streams give what the batch forms give, with files out of order and batches repeated."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brute import online, skewed, two_choice
from evenkeel import HashGrouping, LearnedGrouping, OnlineGrouping, TwoChoiceGrouping
from evenkeel.operators import carry, metrics, routing
from evenkeel.streaming import groupings as streams
from evenkeel.streaming import state
from evenkeel.streaming.state import Carried, PlacedPeriods, SketchedPeriods, TwoChoiceRows
from evenkeel.streaming.watch import watched

K, S, M, THETA = 5, 3, 20, 0.1
KEYS = skewed(430)


@pytest.fixture(scope="module")
def files(spark):
    """Folders of the rows in an order unlike ``seq``; one with the first half, which lacks an early row, and a whole one."""
    from evenkeel.scratch import new_folder

    path = new_folder(spark, "arrivals")
    rows = spark.createDataFrame([(i, k, f"p{i}") for i, k in enumerate(KEYS)], "seq bigint, key bigint, payload string")
    late = F.col("seq") == 3

    def write(*blocks, where=~late):
        for block in blocks:
            rows.where(F.floor(F.col("seq") / 75) == block).where(where).coalesce(1).write.mode("append").parquet(path)

    def more():
        write(3, 2, 5, 4)
        write(0, where=late)

    write(1, 0)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return stream, more


@pytest.fixture(scope="module")
def in_two_parts(files, spark):
    """Every runner, run on the first part of the input, and again, with a new object, when the rest has come."""
    from evenkeel.scratch import new_folder

    make = {
        "windows": lambda root: streams.CountWindows(root, S, M),
        "online": lambda root: streams.OnlineStream(root, OnlineGrouping(K, S, M, THETA)),
        "online-drop": lambda root: streams.OnlineStream(root, OnlineGrouping(K, S, M, THETA, tail="drop")),
        "two-choice": lambda root: streams.TwoChoiceStream(root, TwoChoiceGrouping(K, S, chunk_rows=25), window=40),
        "learned": lambda root: streams.LearnedStream(root, LearnedGrouping(4, 0.1, 2.0, learn=200)),
        "discard": lambda root: streams.LearnedStream(root, LearnedGrouping(4, 0.1, 2.0, learn=200, learned="discard", skip=2)),
    }
    stream, more = files
    roots = {name: new_folder(spark, name) for name in make}
    early = {}
    for name, runner in make.items():
        part = runner(roots[name]).run(stream())
        early[name] = (part.result().count(), part.drained().count() if name in ("windows", "two-choice", "online") else None)
    more()
    late = {name: runner(roots[name]).run(stream()) for name, runner in make.items()}
    # Once more without anything new.
    return early, {name: late[name].run(stream()) for name in late}


def workers(df):
    return [r["worker"] for r in df.orderBy("seq").collect()]


def test_hash(files, in_two_parts, folder, keyed):
    got = streams.stream_hash(files[0](), HashGrouping(K), folder())
    assert workers(got) == workers(HashGrouping(K).assign(keyed(KEYS)))


def test_rows_wait_for_an_early_one(in_two_parts):
    early, _ = in_two_parts
    # 149 rows have come, without number 3: source 0 lacks a row, two others have a window of 20 and more.
    assert early["windows"] == (2 * 20 * 2 + 20, 149)
    assert early["online"] == (0, 149) and early["two-choice"] == (2 * 40, 149)
    assert early["learned"][0] == early["discard"][0] == 0


@pytest.mark.parametrize("tail", ["drop", "flush"])
def test_online(in_two_parts, keyed, tail):
    runner = in_two_parts[1]["online" if tail == "flush" else "online-drop"]
    grouping = runner.grouping
    _, want = online(KEYS, K, S, M, THETA, flush=tail == "flush")
    drained = runner.drained()
    assert workers(drained) == want
    assert [r["payload"] for r in drained.orderBy("seq").collect()] == [f"p{i}" for i in range(len(want))]
    assert workers(runner.result()) == want[: 7 * S * M]

    batch = OnlineGrouping(K, S, M, THETA, tail="drop")
    rows = keyed(KEYS)
    barrier = metrics.period_worker_load(batch.assign(rows), K)
    assert barrier.exceptAll(runner.barrier().select(*barrier.columns)).count() == 0
    assert runner.barrier().count() == 7 * K
    plan = routing.migration(batch.routing(rows), 7)
    got = runner.migration().select(*plan.columns)
    assert plan.exceptAll(got).count() == 0 and got.exceptAll(plan).count() == 0
    assert streams.final_balance(drained, grouping).first()["total"] == len(want)
    # Building tables was timed, batch by batch, over all runs.
    assert runner.delays("routing").where("delay_us > 0").count() >= 1 and runner.delays().count() >= 4


def test_two_choice(in_two_parts):
    assert workers(in_two_parts[1]["two-choice"].drained()) == two_choice(KEYS, K, lambda i, _: i % S)


@pytest.mark.parametrize("name", ["learned", "discard"])
def test_learned(in_two_parts, keyed, name):
    runner = in_two_parts[1][name]
    assert workers(runner.result()) == workers(runner.drained()) == workers(runner.grouping.assign(keyed(KEYS)))


def test_count_windows(in_two_parts):
    runner = in_two_parts[1]["windows"]
    got = runner.result()
    assert [r["seq"] for r in got.orderBy("seq").collect()] == list(range(7 * S * M))
    sizes = got.groupBy("source", "period").count()
    assert sizes.where(F.col("count") != M).count() == 0 and sizes.count() == 7 * S
    rows = runner.drained().orderBy("seq").collect()
    assert [(r["seq"], r["key"], r["payload"]) for r in rows] == [(i, k, f"p{i}") for i, k in enumerate(KEYS)]


def test_fewer_rows_than_to_learn_from(files, in_two_parts, folder, keyed):
    grouping = LearnedGrouping(4, 0.1, learn=1000)
    runner = streams.LearnedStream(folder(), grouping).run(files[0]())
    assert runner.result().count() == 0
    assert workers(runner.drained()) == workers(grouping.assign(keyed(KEYS)))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_null_keys_and_wide_numbers(spark, folder, kind):
    big = 2**53 + 1
    keys = [None if i % 3 == 0 else big if i % 3 == 1 else i for i in range(100)]
    path = folder()
    rows = spark.createDataFrame(list(enumerate(keys)), "seq bigint, key bigint").withColumn("key", F.col("key").cast(kind))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    grouping = OnlineGrouping(4, 2, 10, 0.1)
    got = streams.OnlineStream(folder(), grouping).run(stream).drained()
    assert got.exceptAll(grouping.assign(rows).select(*got.columns)).count() == 0 and got.count() == 100
    got = streams.CountWindows(folder(), 2, 10).run(stream).result().select("seq", "key")
    assert got.exceptAll(rows).count() == 0 and got.count() == 100


def test_nothing_has_come(spark, folder):
    path = folder()
    rows = spark.createDataFrame([], "seq bigint, key bigint")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    for runner in (
        streams.CountWindows(folder(), 2, 10),
        streams.OnlineStream(folder(), OnlineGrouping(4, 2, 10, 0.1)),
        streams.TwoChoiceStream(folder(), TwoChoiceGrouping(4, 2)),
        streams.LearnedStream(folder(), LearnedGrouping(4, 0.1, learn=10)),
    ):
        assert runner.run(stream).drained().count() == 0


def test_keyed_counts(files, in_two_parts, folder, keyed):
    got = streams.stream_keyed_counts(files[0](), folder())
    want = keyed(KEYS).groupBy("key").agg(F.count("*").alias("cnt"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def ticking(spark, path, files):
    for i in range(files):
        spark.range(i, i + 1).selectExpr("id AS seq", "id AS key").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("seq bigint, key bigint").option("maxFilesPerTrigger", 1).parquet(path)


def test_durations_of_more_batches_than_are_remembered(spark, folder):
    path, out = folder(), folder()
    stream = ticking(spark, path, 12)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        watch = watched(spark, folder("delays"), every=5)
        watch.follow(HashGrouping(4).assign(stream).writeStream.format("parquet").option("checkpointLocation", folder()).trigger(availableNow=True).start(out))
        watch.finish()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert len(watch.query.recentProgress) <= 3
    delays = streams.batch_delays(spark, watch.path)
    assert {r["period"] for r in delays.collect()} >= set(range(12))
    assert delays.where("delay_us > 0").count() >= 12
    assert metrics.source_delay(delays).first()["sources"] == 1


def test_a_stream_whose_mass_is_wrong_fails(spark, folder, monkeypatch):
    stream = ticking(spark, folder(), 4)
    watch = watched(spark, folder(), metric="mass", expect_equal=("rows", "mass"))
    odd = stream.observe("mass", F.count("*").alias("rows"), F.sum(F.when(F.col("key") != 2, 1)).alias("mass"))
    watch.follow(odd.writeStream.format("noop").option("checkpointLocation", folder()).trigger(availableNow=True).start())
    with pytest.raises(RuntimeError, match="rows is 1, mass is 0"):
        watch.finish()


def test_columns_that_cannot_wait_are_refused(spark):
    schema = spark.createDataFrame([], "seq bigint, key bigint, x array<int>").schema
    with pytest.raises(ValueError, match="column x"):
        Carried(schema)


class CountedState:
    """Stands for a processor's handle: states in memory, and the number of calls."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getValueState(self, name, schema):
        return self

    getMapState = getValueState

    def exists(self):
        return self._call("value" in self.held)

    def get(self):
        return self._call(self.held.get("value"))

    def update(self, value):
        self._call(self.held.update(value=value))

    def clear(self):
        self._call(self.held.pop("value", None))

    def containsKey(self, key):
        return self._call(key in self.held)

    def getValue(self, key):
        return self._call(self.held[key])

    def updateValue(self, key, value):
        self._call(self.held.update({key: value}))

    def removeKey(self, key):
        self._call(self.held.pop(key))

    def _call(self, out):
        self.calls += 1
        return out


def processed(processor, batches, key):
    """Rows that a processor gives for batches of one key, the calls to its state and the frames."""
    handle, frames = CountedState(), []
    values, maps = CountedState(), CountedState()
    handle.getValueState, handle.getMapState = lambda *_: values, lambda *_: maps
    processor.init(handle)
    for batch in batches:
        frames += list(processor.handleInputRows(key, iter(batch), None))
    return pd.concat(frames, ignore_index=True), values.calls + maps.calls, len(frames), maps.held


CARRIED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.LongType())])


def test_periods_in_order_are_placed_without_the_state():
    sketches = pd.DataFrame({"period": range(1, 301), "light": [[1, 0]] * 300, "heavy": [["a"]] * 300, "counts": [[3]] * 300})
    got, calls, frames, _ = processed(PlacedPeriods(2), [[sketches[:200], sketches[200:]]], (0,))
    assert calls <= 4 and frames == 2 and len(got) == 600
    late, calls, _, left = processed(PlacedPeriods(2), [[sketches[10:20]], [sketches[5:10]], [sketches[:5]]], (0,))
    assert late["worker"].tolist()[::2] == got["worker"].tolist()[:40:2] and not left


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_windows_of_a_batch_are_replayed_without_the_state(monkeypatch, limit):
    monkeypatch.setattr(state, "EARLY_ROWS", limit)
    rng = np.random.default_rng(5)
    n, k = 3000, 4
    rows = pd.DataFrame({"seq": range(n), "key": "1", "pos": range(n), "code": rng.integers(0, k * k, n)})
    codes = rows["code"].to_numpy()
    want = carry.chosen_of(codes, carry.two_choice_kernel(codes, np.zeros(k, np.int64), k), k).tolist()
    make = lambda: TwoChoiceRows(k, 30, Carried(CARRIED))
    got, calls, _, _ = processed(make(), [[rows[:700], rows[700:]]], (0,))
    assert got["worker"].tolist() == want and calls <= 4
    # In any order, over several batches: the last rows come first.
    mixed = rows.sample(frac=1, random_state=1)
    got, _, _, left = processed(make(), [[rows[2000:]], [mixed[mixed["pos"] < 1500]], [rows[1500:1990], rows[1990:2000]]], (0,))
    assert got["seq"].tolist() == list(range(n)) and got["worker"].tolist() == want and not left


def test_whole_periods_of_a_batch_are_sketched_at_once():
    s, m, k = 2, 10, 3
    n = 12 * s * m
    rows = pd.DataFrame({"seq": range(n), "key": [None if i % 7 == 0 else str(i % 5) for i in range(n)]})
    rows["source"], rows["period"], rows["bucket"] = rows["seq"] % s, rows["seq"] // (s * m) + 1, rows["seq"] % 5 % k
    make = lambda: SketchedPeriods(s, m, k, 2, False, Carried(CARRIED))
    whole, calls, frames, _ = processed(make(), [[rows]], (0,))
    assert calls <= 2 and frames == 1
    mixed = rows.sample(frac=1, random_state=2)
    parts, _, _, left = processed(make(), [[mixed[:100]], [mixed[100:130], mixed[130:200]], [mixed[200:]]], (0,))
    show = lambda df: sorted(map(str, df.sort_values(["kind", "period"])[["period", "light", "heavy", "counts"]][df["kind"] == "sketch"].values.tolist()))
    assert show(parts) == show(whole) and sorted(parts["seq"].dropna()) == list(range(n)) and not left
    for period, light, counts in whole[whole["kind"] == "sketch"][["period", "light", "counts"]].values.tolist():
        assert sum(light) + sum(counts) == s * m
