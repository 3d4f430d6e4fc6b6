"""Hand-worked cases, ties and degenerate inputs."""

import pytest
from pyspark.sql import functions as F

from evenkeel import HashGrouping, OnlineGrouping, TwoChoiceGrouping
from evenkeel.functions import hashing
from evenkeel.operators import metrics, placement, routing, shape, sketches


def place(spark, items, k, **options):
    heavy = spark.createDataFrame([(1, key, cnt) for key, cnt in items], "period bigint, key bigint, cnt bigint")
    none = spark.createDataFrame([], "period bigint, bucket int, cnt bigint")
    listed = placement.placement_items(heavy, none, by=["period"])
    rows = placement.place_online(listed, k, **options).orderBy("key").collect()
    return [r["worker"] for r in rows]


def test_placement_ties_go_to_the_lowest_worker(spark):
    assert place(spark, [(1, 5), (2, 5), (3, 5), (4, 1)], 3) == [0, 1, 2, 0]


def test_key_order_and_load_order_differ(spark):
    items = [(1, 1), (2, 1), (3, 10)]
    assert place(spark, items, 2) == [0, 1, 0]
    assert place(spark, items, 2, order="load") == [1, 1, 0]


def test_two_choice_tie_takes_the_second_candidate(keyed):
    rows = keyed([5])
    pair = rows.select(hashing.candidates(rows, 97).alias("c")).first()["c"]
    assert pair[0] != pair[1]
    assert TwoChoiceGrouping(97).assign(rows).first()["worker"] == pair[1]


def test_merge_does_not_apply_the_threshold_again(spark):
    # Key 7 is heavy in source 0 (5 of 10) and light in source 1 (2 of 10).
    keys = []
    for i in range(10):
        keys += [(2 * i, 7 if i < 5 else 100 + i), (2 * i + 1, 7 if i < 2 else 200 + i)]
    rows = shape.with_period(shape.with_source(spark.createDataFrame(keys, "seq bigint, key bigint"), 2), 2, 10)
    bucket_of = hashing.KeyHash(4)
    heavy, sparse = sketches.split_items(sketches.items_from_rows(rows, 0.5, 10, bucket_of))
    assert [(r["key"], r["cnt"]) for r in heavy.collect()] == [(7, 5)]
    own = rows.select(bucket_of(F.lit(7)).alias("b")).first()["b"]
    light = rows.where("key <> 7").where(bucket_of("key") == own).count()
    assert sparse.where(F.col("bucket") == own).first()["cnt"] == light + 2


def test_migration_lists_kept_dropped_and_added_keys(spark):
    tables = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 2, 1), (2, 3, 0)], "period bigint, key bigint, worker int")
    plan = routing.migration(tables).where("period = 2").orderBy("key").collect()
    assert [(r["key"], r["before"], r["after"], r["moved"]) for r in plan] == [
        (1, 0, None, True),
        (2, 1, 1, False),
        (3, None, 0, True),
    ]


def test_migration_into_an_empty_table(spark):
    tables = spark.createDataFrame([(1, 1, 0)], "period bigint, key bigint, worker int")
    plan = routing.migration(tables, 2).where("period = 2").collect()
    assert [(r["key"], r["before"], r["after"]) for r in plan] == [(1, 0, None)]


@pytest.mark.parametrize("dense", [True, False])
def test_incomplete_tail_is_dropped_or_flushed(keyed, dense):
    rows = shape.with_period(shape.with_source(keyed(list(range(9))), 2), 2, 2)
    assert shape.complete_only(rows, 2, 2, "drop", dense=dense).count() == 8
    assert shape.complete_only(rows, 2, 2).count() == 9


def test_imbalance_of_the_recorded_first_period(spark):
    loads = [171] + [123] * 20 + [124] * 4 + [125] * 1 + [124] * 6
    loads[-1] += 4000 - sum(loads)
    df = spark.createDataFrame(list(enumerate(loads)), "worker int, load bigint")
    row = metrics.balance(df, 32).first()
    assert (row["total"], row["avg_load"]) == (4000, 125)
    assert row["imbalance"] == pytest.approx(36.8)


def test_empty_input_has_no_imbalance(spark):
    rows = spark.createDataFrame([], "seq bigint, key bigint")
    loads = metrics.worker_load(HashGrouping(4).assign(rows), 4)
    assert loads.count() == 4
    assert metrics.balance(loads, 4).first()["imbalance"] is None


def test_deviation_uses_the_whole_number_average(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "worker int, load bigint")
    assert metrics.load_stddev(df, 2).first()["sigma"] == pytest.approx((1 / 2) ** 0.5)


@pytest.mark.parametrize(
    "keys",
    [[3] * 40, list(range(40)), [-(i % 7) - 1 for i in range(40)], ["", "a"] * 20, [-(2**63), 2**63 - 1] * 20],
    ids=["one key", "all distinct", "negative", "empty string", "extreme"],
)
@pytest.mark.parametrize("k", [1, 5])
def test_degenerate_streams_reach_valid_workers(keyed, keys, k):
    rows = keyed(keys)
    for grouping in (HashGrouping(k), TwoChoiceGrouping(k, 2), OnlineGrouping(k, 2, 5, 0.2)):
        routed = grouping.assign(rows)
        assert routed.count() == len(keys)
        assert routed.where((F.col("worker") < 0) | (F.col("worker") >= k) | F.col("worker").isNull()).count() == 0


def test_string_fold_is_the_32_bit_polynomial_hash(spark):
    # Absolute 32-bit base-31 hashes of UTF-16 strings.
    known = {"": 0, "a": 97, "hello": 99162322, "polygenelubricants": 2147483648, "é": 233, "\U0001f600": 1772899}
    df = spark.createDataFrame([(s,) for s in known], "s string")
    for row in df.select("s", hashing.fold_utf16(F.col("s")).alias("h")).collect():
        assert row["h"] == known[row["s"]], row["s"]


def test_seed_primes():
    assert hashing.seed_primes(4) == [31, 37, 41, 43]


def test_large_keys_survive_placement(spark):
    big = 2**60 + 1
    heavy = spark.createDataFrame([(big, 9)], "key bigint, cnt bigint")
    sparse = spark.createDataFrame([(0, 3), (1, 4)], "bucket int, cnt bigint")
    placed = placement.place_lpt(placement.placement_items(heavy, sparse), 2)
    assert placed.where("kind = 'heavy'").first()["key"] == big
    assert {(r["kind"], r["bucket"], r["worker"]) for r in placed.where("kind = 'bucket'").collect()} == {
        ("bucket", 1, 1),
        ("bucket", 0, 1),
    }


def test_murmur_workers_are_in_range_repeatable_and_even(spark):
    rows = spark.range(4000).withColumnRenamed("id", "key")
    once = HashGrouping(8, murmur=True).assign(rows)
    counts = {r["worker"]: r["count"] for r in once.groupBy("worker").count().collect()}
    assert set(counts) == set(range(8)) and all(400 < n < 600 for n in counts.values())
    assert once.exceptAll(HashGrouping(8, murmur=True).assign(rows.repartition(3))).count() == 0
    pair = rows.select(hashing.murmur_candidates(F.col("key"), 8).alias("c"))
    same = pair.where(F.col("c")[0] == F.col("c")[1]).count()
    assert 350 < same < 650
