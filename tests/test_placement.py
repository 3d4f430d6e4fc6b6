"""Online and learned groupings against brute force; placement quality; planted mistakes."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from brute import lpt, online, skewed
from evenkeel import LearnedGrouping, OnlineGrouping
from evenkeel.functions.hashing import key_hash
from evenkeel.operators import metrics, placement, routing, shape, sketches

K, S, M, THETA = 5, 3, 20, 0.1


def tables_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["period"], {})[r["key"]] = r["worker"]
    return out


def nonempty(tables):
    return {p: t for p, t in tables.items() if t}


@pytest.mark.parametrize("order", ["key", "load"])
@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("tail", ["drop", "flush"])
def test_online_equals_brute_force(keyed, order, text, tail):
    keys = [f"k{x}" if text else x for x in skewed(430)]
    want_tables, want = online(keys, K, S, M, THETA, order, tail == "flush")
    grouping = OnlineGrouping(K, S, M, THETA, order=order, tail=tail)
    rows = keyed(keys)
    assert tables_of(grouping.routing(rows)) == nonempty(want_tables)
    for routed in (grouping.assign(rows), grouping.assign_in_place(grouping.stage(rows))):
        assert [r["worker"] for r in routed.orderBy("seq").collect()] == want


def test_the_two_orders_differ_on_this_stream():
    keys = skewed(430)
    assert online(keys, K, S, M, THETA, "key") != online(keys, K, S, M, THETA, "load")


@pytest.mark.parametrize("rows", [0, 1, 59, 60, 61, 62, 119])
def test_sizes_of_the_last_period(keyed, rows):
    keys = skewed(rows) or [1]
    g = OnlineGrouping(K, S, M, THETA)
    _, want = online(keys, K, S, M, THETA, flush=True)
    df = keyed(keys)
    assert [r["worker"] for r in g.assign(df).orderBy("seq").collect()] == want
    by_number, counted = (g.items(g.stage(df), n) for n in (g._dense(df)[1], None))
    assert by_number.exceptAll(counted).count() == 0 and counted.exceptAll(by_number).count() == 0


def test_batches_of_periods_do_not_change_tables(spark, keyed):
    rows = keyed(skewed(430))
    whole = tables_of(OnlineGrouping(K, S, M, THETA).routing(rows))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert tables_of(OnlineGrouping(K, S, M, THETA).routing(rows)) == whole
        items = OnlineGrouping(K, S, M, THETA).items(OnlineGrouping(K, S, M, THETA).stage(rows))
        placed = placement.place_lpt(items.drop("period"), K).groupBy("worker").agg(F.sum("cnt").alias("n")).orderBy("worker").collect()
        assert [r["n"] for r in placed] == lpt([(0, r["cnt"]) for r in items.collect()], K)
        groups = placement.place_lpt(items, K, ["period"])
        for p in (1, 8):
            part = items.where(F.col("period") == p)
            assert groups.where(F.col("period") == p).exceptAll(placement.place_lpt(part, K).select(*groups.columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("mode", ["sketch", "space_saving"])
def test_sketch_modes_agree_while_keys_fit(keyed, mode):
    rows = keyed(skewed(430))
    exact = tables_of(OnlineGrouping(K, S, M, THETA).routing(rows))
    assert tables_of(OnlineGrouping(K, S, M, THETA, eps=1 / M, mode=mode).routing(rows)) == exact


def test_one_home_per_key_and_period(keyed):
    routed = OnlineGrouping(K, S, M, THETA).assign(keyed(skewed(430)))
    homes = routed.groupBy("period", "key").agg(F.count_distinct("worker").alias("n"))
    assert homes.agg(F.max("n")).first()[0] == 1


def test_placement_loads_match_the_fold(keyed):
    rows = keyed(skewed(430))
    g = OnlineGrouping(K, S, M, THETA)
    items = g.items(g.stage(rows))
    loads = placement.placement_loads(g.place(items), sketches.split_items(items)[1], K)
    # Heavy keys are routed where they were placed, so placed loads count every row.
    assert [r["n"] for r in loads.groupBy("period").agg(F.sum("load").alias("n")).orderBy("period").collect()] == [
        *(60 * p for p in range(1, 8)), 430
    ]


def test_learned_grouping(keyed):
    keys = skewed(1000)
    g = LearnedGrouping(4, 0.1, 2.0, learn=300)
    rows = keyed(keys)
    routed = g.assign(rows)
    assert routed.count() == 1000
    discarding = LearnedGrouping(4, 0.1, 2.0, learn=300, learned="discard", skip=2).assign(rows)
    assert discarding.exceptAll(routed.where("seq >= 302")).count() == 0 and discarding.count() == 698
    assert routed.groupBy("key").agg(F.count_distinct("worker").alias("n")).agg(F.max("n")).first()[0] == 1
    items = g.items(shape.prefix(rows, 300))
    assert items.agg(F.sum("cnt")).first()[0] == 300
    assert items.where("kind = 'bucket'").count() == g.buckets
    placed = placement.place_lpt(items, 4).groupBy("worker").agg(F.sum("cnt").alias("load")).orderBy("worker")
    want = lpt([(i, r["cnt"]) for i, r in enumerate(items.collect())], 4)
    assert [r["load"] for r in placed.collect()] == want


def test_learned_grouping_with_fewer_rows_learns_from_all(keyed):
    rows = keyed(skewed(200))
    few, whole = (LearnedGrouping(4, 0.1, learn=n).assign(rows) for n in (300, 200))
    assert few.exceptAll(whole).count() == 0 and few.count() == 200
    assert LearnedGrouping(4, 0.1, learn=300, learned="discard").assign(rows).count() == 0
    with pytest.raises(ValueError):
        LearnedGrouping(4, 0.1, learned="drop")


def test_makespan_is_within_the_known_bound(spark):
    amounts = [7, 7, 6, 6, 5, 4, 4, 3]
    k = 3
    heavy = spark.createDataFrame(list(enumerate(amounts)), "key bigint, cnt bigint")
    none = spark.createDataFrame([], "bucket int, cnt bigint")
    placed = placement.place_lpt(placement.placement_items(heavy, none), k)
    top = placed.groupBy("worker").agg(F.sum("cnt").alias("load")).agg(F.max("load")).first()[0]
    best = min(
        max(sum(a for a, w in zip(amounts, choice) if w == i) for i in range(k))
        for choice in product(range(k), repeat=len(amounts))
    )
    assert top <= (4 / 3 - 1 / (3 * k)) * best


def test_relocation_keeps_totals_and_gives_one_owner(keyed):
    g = OnlineGrouping(K, S, M, THETA)
    rows = keyed(skewed(430))
    tables = g.routing(rows)
    state = routing.keyed_state(g.assign(rows))
    plan = routing.migration(tables)
    last = plan.where(F.col("period") == plan.agg(F.max("period")).scalar())
    moved = routing.relocate(state, last, key_hash(rows, K))
    assert moved.groupBy("key").count().where("count > 1").count() == 0
    before = {r["key"]: r["cnt"] for r in routing.merge_partials(state).collect()}
    assert {r["key"]: r["cnt"] for r in moved.collect()} == before


def test_running_sum_in_blocks(spark):
    df = spark.createDataFrame([(w, p, w + p) for w in range(2) for p in range(1, 11)], "worker int, period bigint, x bigint")
    small = metrics.running_sum(df, ["worker"], "period", "x", "total", block=3)
    for r in small.collect():
        assert r["total"] == sum(r["worker"] + p for p in range(1, r["period"] + 1))


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_results_do_not_depend_on_partitions(spark, keyed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        keys = skewed(300)
        _, want = online(keys, K, S, M, THETA, flush=True)
        rows = keyed(keys).repartition(int(partitions), "key")
        assert [r["worker"] for r in OnlineGrouping(K, S, M, THETA).assign(rows).orderBy("seq").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_planted_mistakes_are_caught(keyed, monkeypatch):
    keys = skewed(430)
    want, _ = online(keys, K, S, M, THETA, flush=True)
    routed = lambda: tables_of(OnlineGrouping(K, S, M, THETA).routing(keyed(keys)))

    def last_on_ties(amounts, loads):
        chosen = []
        for amount in amounts:
            worker = max(w for w, load in enumerate(loads) if load == min(loads))
            loads[worker] += amount
            chosen.append(worker)
        return chosen

    with monkeypatch.context() as patch:
        patch.setattr(placement, "greedy", last_on_ties)
        assert routed() != want

    def threshold_again(counts, is_heavy, bucket_of, by=(), key="key"):
        merged = counts.where(is_heavy).groupBy(*by, key).agg(F.sum("cnt").alias("cnt"))
        return whole(merged, F.col("cnt") >= THETA * M * S, bucket_of, by, key)

    whole = sketches.items_from_counts
    with monkeypatch.context() as patch:
        patch.setattr(sketches, "items_from_counts", threshold_again)
        assert routed() != want
    assert routed() == want


def test_building_tables_is_timed(keyed):
    g = OnlineGrouping(K, S, M, THETA)
    rows = keyed(skewed(430))
    built = g.place(g.items(g.stage(rows)), timed=True)
    sizes = {r["period"]: r["routing_size"] for r in built.collect()}
    assert sizes == {p: len(t) for p, t in online(skewed(430), K, S, M, THETA, flush=True)[0].items()}
    assert built.where("build_us < 0").count() == 0
