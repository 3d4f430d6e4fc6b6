"""Frequent keys in all modes, conservation, distinct keys."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import skewed, space_saving
from evenkeel.functions.hashing import key_hash
from evenkeel.operators import shape, sketches


def stage(rows, s=2, m=50):
    return shape.with_period(shape.with_source(rows, s), s, m)


@pytest.mark.parametrize("text", [False, True])
def test_space_saving_with_eviction(keyed, text):
    keys = [f"k{x}" if text else x for x in skewed(300, keys=40)]
    got = {}
    for r in sketches.space_saving(stage(keyed(keys)), eps=0.2).collect():
        got.setdefault((r["source"], r["period"]), {})[r["key"]] = [r["count"], r["err"]]
    for (source, period), kept in got.items():
        mine = keys[(period - 1) * 100 : period * 100][source::2]
        assert kept == space_saving(mine, 5)
        true = Counter(mine)
        for key, (count, err) in kept.items():
            assert count - err <= true[key] <= count


def test_space_saving_across_batches_and_null_keys(spark):
    keys = [None if x == 7 else x for x in skewed(300, keys=40)]
    rows = spark.createDataFrame(list(enumerate(keys)), "seq bigint, key bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole = sketches.space_saving(rows, 0.2, by=()).collect()
        parts = sketches.space_saving(stage(rows), 0.2).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    named = [-1 if k is None else k for k in keys]
    assert {-1 if r["key"] is None else r["key"]: [r["count"], r["err"]] for r in whole} == space_saving(named, 5)
    assert parts == 5 * 2 * 3


@pytest.mark.parametrize("by", [[], ["part"]])
@pytest.mark.parametrize("eps", [0.02, 0.3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_merged_summaries_keep_their_bounds(spark, by, eps, partitions):
    keys = skewed(4000, keys=900, every=5)
    rows = spark.createDataFrame([(i % 2, None if k == 3 else k) for i, k in enumerate(keys)], "part long, key long")
    found = sketches.merged_space_saving(rows.repartition(partitions), eps, by).collect()
    for part in (0, 1) if by else (None,):
        mine = [None if k == 3 else k for i, k in enumerate(keys) if part in (None, i % 2)]
        true, n = Counter(mine), len(mine)
        kept = {r["key"]: r for r in found if not by or r["part"] == part}
        assert len(kept) <= sketches.capacity(eps)
        for key, r in kept.items():
            assert r["count"] - r["err"] <= true[key] <= r["count"] and r["err"] <= eps * n
        assert all(key in kept for key, cnt in true.items() if cnt > eps * n)
    assert sketches.merged_space_saving(rows.limit(0), eps, by).count() == 0


@pytest.mark.parametrize("mode", ["exact", "sketch", "space_saving"])
@pytest.mark.parametrize("by", [(), ("source", "period")])
@pytest.mark.parametrize("known", [True, False])
def test_heavy_hitters(keyed, mode, by, known):
    keys = skewed(300, keys=20)
    rows = stage(keyed(keys))
    n = (50 if by else 300) if known else None
    got = sketches.heavy_hitters(rows, 0.1, 0.01, by, mode, n)
    if by:
        want = {
            (s, p, key): cnt
            for p in range(1, 4)
            for s in range(2)
            for key, cnt in Counter(keys[(p - 1) * 100 : p * 100][s::2]).items()
            if cnt >= 5
        }
        assert {(r["source"], r["period"], r["key"]): r["cnt"] for r in got.collect()} == want
    else:
        want = {key: cnt for key, cnt in Counter(keys).items() if cnt >= 30}
        assert {r["key"]: r["cnt"] for r in got.collect()} == want


def test_merged_sketch_states(keyed):
    keys = skewed(400, keys=20)
    parts = sketches.sketch_state(stage(keyed(keys)), 0.01, ("source", "period"))
    merged = sketches.estimate_top(sketches.combine_states(parts, 0.01), 0.01)
    assert {r["key"]: r["cnt"] for r in merged.collect()} == dict(Counter(keys))


def test_one_pass_equals_sketch_and_merge(keyed):
    rows = stage(keyed(skewed(300)))
    bucket_of = key_hash(rows, 6)
    heavy = sketches.heavy_hitters(rows, 0.1, n=50)
    hist = sketches.bucket_hist(rows, 6, bucket_of)
    sparse = sketches.sparse_buckets(hist, heavy, bucket_of)
    assert sketches.check_conservation(heavy, sparse, 50).where("not conserved").count() == 0
    a, b = sketches.merge_sketches(heavy, sparse)
    c, d = sketches.split_items(sketches.items_from_rows(rows, 0.1, 50, bucket_of))
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
    some = b.where("cnt > 0").select("period", "bucket", "cnt")
    assert some.exceptAll(d).count() == 0 and d.exceptAll(some).count() == 0


def test_distinct_keys(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("key"))
    assert sketches.distinct_keys(rows).first()[0] == 5000
    for mode in ("hll", "quick"):
        assert sketches.distinct_keys(rows, mode).first()[0] == pytest.approx(5000, rel=0.1)
    parts = sketches.hll_state(rows.withColumn("part", F.col("key") % 7), ("part",))
    assert sketches.hll_merge(parts).first()[0] == pytest.approx(5000, rel=0.01)


def test_threshold_is_rounded_up():
    assert math.ceil(0.02 * 125) == 3


def test_merged_summaries_read_the_rows_once(spark):
    rows, read = spark.range(30_000).select((F.col("id") % 700).alias("key")).repartition(3), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = sketches.merged_space_saving(rows.mapInArrow(seen, rows.schema), 0.01).collect()
    assert len(found) == 100 and read.value == 30_000


def test_rows_merged_into_a_summary_keep_its_bounds():
    """Many small parts, one after another, with NULL keys and groups: true numbers lie within the bounds."""
    keys = [None if k % 9 == 4 else f"k{k}" for k in skewed(6000, keys=300)]
    groups = [i % 3 if i % 7 else None for i in range(len(keys))]
    for by in ([], ["g"]):
        kept, counters = None, 20
        for a in range(0, len(keys), 150):
            columns = {"key": pa.array(keys[a : a + 150], pa.string()), **({"g": pa.array(groups[a : a + 150], pa.int32())} if by else {})}
            batch = pa.RecordBatch.from_pydict(columns)
            kept = sketches._summed_up(kept, [batch.slice(0, 60), batch.slice(60)], by, "key", counters)
        true = Counter(zip(groups, keys) if by else keys)
        sizes = Counter(groups) if by else {None: len(keys)}
        found = {((r["g"], r["key"]) if by else r["key"]): r for r in kept.to_pylist()}
        distinct = Counter(k[0] if by else None for k in true)
        assert len(found) == kept.num_rows == sum(min(counters, n) for n in distinct.values())
        for key, r in found.items():
            n = sizes[key[0] if by else None]
            assert r["count"] - r["err"] <= true[key] <= r["count"] and r["err"] <= n / counters
            assert r["_floor"] <= n / counters and r["count"] >= r["_floor"]
        floors = {(k[0] if by else None): r["_floor"] for k, r in found.items()}
        assert all(k in found or n <= floors[k[0] if by else None] for k, n in true.items())
