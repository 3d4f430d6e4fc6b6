"""Physical plans: what is pushed down, what is shuffled, what never appears."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenkeel import ColumnGrouping, Grouping, HashGrouping, compare
from evenkeel.functions.hashing import KeyHash
from evenkeel.operators import routing, shape, sketches
from evenkeel.scratch import broadcast_within, pin

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange SinglePartition")


@pytest.mark.parametrize(
    "name",
    ["group_hash", "group_two_choice", "group_dkg", "group_online", "migration_plan", "period_imbalance", "sketch_merge_buckets"],
)
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_static_hashing_moves_nothing_and_reads_two_columns(spark):
    text = plan(entry.HASH.assign(entry.ev(spark, SF)))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_prefix_and_period_filters_reach_the_scan(spark):
    rows = entry.ev(spark, SF)
    assert "LessThan(event_id,2000)" in plan(shape.prefix(rows, 2000))
    assert "LessThan(event_id,520)" in plan(entry.ONLINE_DROP.stage(rows, 1))


def test_sketching_shuffles_once_by_period(spark):
    rows = entry.ev(spark, SF)
    items = sketches.items_from_rows(entry.ONLINE.stage(rows, 2), 0.02, F.lit(130), KeyHash(8))
    assert exchanges(items) == 1
    assert "hashpartitioning(period" in plan(items)


def test_routing_broadcasts_only_a_bounded_table(spark):
    rows = entry.ONLINE.stage(entry.ev(spark, SF), 2)
    table = pin(entry.ONLINE.routing(entry.ev(spark, SF)), "routing")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = routing.route_online(rows, table, KeyHash(8), 400)
        large = routing.route_online(rows, table, KeyHash(8), 10_000_000)
        assert "BroadcastHashJoin" in plan(small)
        assert "BroadcastHashJoin" not in plan(large)
        assert small.exceptAll(large).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketch_and_lookup_share_one_exchange(spark):
    rows = pin(entry.ONLINE.stage(entry.ev(spark, SF)).withColumn("payload", F.lit("x")), "staged")
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in keep}
    for name, value in keep.items():
        spark.conf.set(name, value)
    try:
        routed = entry.ONLINE.assign_in_place(rows)
        assert routed.count() == rows.count()
        routed.collect()
        text = plan(routed)
        text = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
        # The stream is read once, and its exchange is used twice.
        assert text.count("FileScan parquet") == 1 and "ReusedExchange" in text
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" not in text
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_tables_of_one_task_are_dealt_out_before_they_are_folded(spark):
    rows = spark.range(100).selectExpr("id AS seq", "id % 7 AS key", "id DIV 10 AS period").repartition("period")
    table = spark.range(10).selectExpr("id AS period", "id % 7 AS key", "1 AS worker").coalesce(1)
    routed = routing.route_by_period(rows, table, KeyHash(4), 8)
    lines = plan(routed).split("\n")
    folds = [i for i, x in enumerate(lines) if "HashAggregate" in x]
    dealt = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and i > folds[0]]
    assert dealt and max(folds) < max(dealt)
    # Neither side moves again to be joined.
    assert len([x for x in lines if "Exchange hashpartitioning" in x]) == 2
    want = {r.seq: 1 if r.key == r.period % 7 else None for r in rows.collect()}
    assert all(r.worker == want[r.seq] for r in routed.collect() if want[r.seq] is not None) and routed.count() == 100


def test_broadcasts_are_bounded_in_bytes(spark):
    numbers = spark.range(100).selectExpr("id AS key", "CAST(id AS INT) AS worker")
    texts = numbers.withColumn("key", F.repeat(F.col("key").cast("string"), 400_000))
    hinted = lambda df, rows: plan(spark.range(5).selectExpr("id AS worker").join(broadcast_within(df, rows), "worker"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in hinted(numbers, 100) and "BroadcastHashJoin" not in hinted(numbers, 2e6)
        assert "BroadcastHashJoin" not in hinted(texts, 100)
        assert "BroadcastHashJoin" in hinted(texts.withColumn("key", F.substring("key", 1, 9)), 100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_user_strategies_follow_the_protocol(spark):
    rows = entry.ev(spark, SF)
    custom = ColumnGrouping(3, lambda key: F.pmod(key, F.lit(3)), "modulo")
    assert isinstance(custom, Grouping) and isinstance(HashGrouping(3), Grouping)
    table = compare(rows, [custom, HashGrouping(3)])
    assert [r["strategy"] for r in table.orderBy("strategy").collect()] == ["hash", "modulo"]
    assert table.agg(F.min("total")).first()[0] == rows.count()
