"""Readers, generated keys, sinks and numbering."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import zipf
from evenkeel.operators import shape
from evenkeel.sources import generated, records, sinks


def test_key_records_keep_record_and_item_order(spark, tmp_path):
    for i in range(3):
        lines = [",".join(str(100 * i + 10 * j + x) for x in range(3 if j else 1)) for j in range(4)]
        (tmp_path / f"part-{i}.csv").write_text("\n".join(lines) + "\n\n")
    rows = records.read_key_records(spark, str(tmp_path)).orderBy("seq").collect()
    keys = [100 * i + 10 * j + x for i in range(3) for j in range(4) for x in range(3 if j else 1)]
    assert [r["key"] for r in rows] == keys
    assert [r["seq"] for r in rows] == list(range(len(keys)))
    assert [(r["rec"], r["pos"]) for r in rows][:5] == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_records_over_many_splits(spark, tmp_path):
    (tmp_path / "one.csv").write_text("\n".join(f"{2 * i}, {2 * i + 1}" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = records.read_key_records(spark, str(tmp_path))
        assert rows.where("seq <> key").count() == 0
        assert rows.count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_key_that_is_no_number_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        records.read_key_records(spark, str(tmp_path)).collect()


def test_all_fields_of_a_log_as_keys(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1 a u1 -\n2 b u2 -\n")
    rows = records.read_key_records(spark, str(tmp_path), " ", "string").orderBy("seq").collect()
    assert [r["key"] for r in rows] == ["1", "a", "u1", "-", "2", "b", "u2", "-"]


def test_access_log(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("1 t http://x/1 -\n\n2 t\n3 t http://x/3\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("4 t http://x/4 -\n")
    rows = records.read_access_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["key"]) for r in rows] == [(0, "http://x/1"), (1, "http://x/3"), (2, "http://x/4")]
    assert records.short_lines(spark, str(tmp_path)).first().asDict() == {"lines": 4, "short_lines": 1}
    assert records.read_access_log(spark, str(tmp_path), ordered=False, partitions=3).count() == 3


def test_zipf_frequencies_fall_with_the_exponent(spark):
    for z in (1.0, 2.0):
        n = 200_000
        counts = {
            r["key"]: r["count"] for r in generated.zipf(spark, n, 1000, z, 7).groupBy("key").count().collect()
        }
        h = sum(i**-z for i in range(1, 1001))
        for rank in (1, 2, 4):
            assert counts[rank] / n == pytest.approx(rank**-z / h, rel=0.05)
        assert max(counts) <= 1000


def test_zipf_is_the_same_on_every_run(spark):
    a = generated.zipf(spark, 500, seed=3)
    assert a.exceptAll(generated.zipf(spark, 500, seed=3).repartition(3)).count() == 0
    with pytest.raises(ValueError):
        generated.zipf(spark, 5, n=0)


@pytest.mark.parametrize("n", [1, 2, 7, 1023, 1024, 1025, 200_000])
@pytest.mark.parametrize("z", [0.5, 1.0, 2.0])
def test_zipf_inverts_the_whole_distribution(spark, n, z):
    rows = spark.range(3000).select("id", zipf.uniform_integer(F.col("id"), 5).alias("u"), zipf.zipf_key(F.col("id"), n, z, 5).alias("key"))
    got = rows.orderBy("id").toPandas()
    sums = np.cumsum(np.arange(1, n + 1, dtype=float) ** -z)
    bounds = np.floor(sums / sums[-1] * 2.0**52)
    want = np.minimum(np.searchsorted(bounds, got["u"], side="right") + 1, n)
    head = want <= zipf.HEAD_KEYS
    assert (got["key"][head] == want[head]).mean() > 0.999
    # Beyond the head both ways round differently, at the very border of two keys.
    assert (abs(got["key"] - want) <= 1).all() and (got["key"] == want).mean() > 0.995


@pytest.mark.parametrize("n", [10_000_000, 1_000_000_000])
@pytest.mark.parametrize("z", [1.0, 1.2])
def test_zipf_of_very_many_keys(spark, n, z):
    rows = 100_000
    keys = generated.zipf(spark, rows, n, z, 3)
    total = np.sum(np.arange(1, 10**6, dtype=float) ** -z)
    total += np.log(n / 10**6) if z == 1 else (n ** (1 - z) - (10.0**6) ** (1 - z)) / (1 - z)
    counts = {r["key"]: r["count"] for r in keys.where("key <= 5").groupBy("key").count().collect()}
    for key in range(1, 6):
        share = key**-z / total
        assert abs(counts[key] / rows - share) < 5 * (share / rows) ** 0.5
    beyond = keys.where("key > 1000000").count() / rows
    share = (np.log(n / 10**6) if z == 1 else (n ** (1 - z) - (10.0**6) ** (1 - z)) / (1 - z)) / total
    assert abs(beyond - share) < 5 * (share / rows) ** 0.5
    assert 10**6 < keys.agg(F.max("key")).first()[0] <= n
    assert "Python" not in keys._jdf.queryExecution().executedPlan().toString()


def test_harmonic_numbers(spark):
    assert zipf.harmonic(spark, 1000, 2.0).first()[0] == pytest.approx(np.sum(1 / np.arange(1.0, 1001) ** 2))
    size = zipf.harmonic(spark, 10_000, 2.0).select(zipf.expected_table_size(1e-4, F.col("harmonic"), 2.0))
    assert size.first()[0] == pytest.approx((1e-4 * np.pi**2 / 6) ** -0.5, rel=1e-3)


def test_delivery_fills_the_partition_of_the_worker(spark, keyed):
    rows = keyed(list(range(100))).withColumn("worker", F.pmod("key", F.lit(5)).cast("int"))
    for splits in (1, 4):
        placed = sinks.deliver(rows, 5, splits=splits).withColumn("part", F.spark_partition_id())
        assert placed.count() == 100
        assert placed.where(F.floor(F.col("part") / splits) != F.col("worker")).count() == 0


def test_files_by_worker(spark, keyed, folder):
    path = folder()
    rows = keyed(list(range(20))).withColumn("worker", F.pmod("key", F.lit(3)).cast("int"))
    sinks.write_by_worker(rows, path)
    assert spark.read.parquet(path).where("worker = 1").count() == 7


def test_statistics_of_a_repeated_batch_are_kept_once(spark, folder):
    path = folder()
    df = spark.createDataFrame([(1, 36.8, 23.5), (2, 14.5, 31.0)], "period bigint, imbalance double, sigma double")
    sinks.write_stats(df, path, batch_id=0)
    sinks.write_stats(df, path, batch_id=0)
    assert spark.read.csv(f"{path}/batch=0").count() == 2


def test_dense_numbering_under_skew(spark):
    # Two thirds of the rows share one group.
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(9).alias("g"))
    numbered = shape.dense_seq(df, ["x"])
    assert numbered.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()[:] == (0, 2999, 3000)
    rows = numbered.orderBy("x").select("seq").collect()
    assert [r["seq"] for r in rows] == list(range(3000))
    within = shape.number_within(df, ["g"], ["x"])
    check = within.groupBy("g").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.min("pos").alias("low"), F.count_distinct("pos").alias("d"))
    assert check.where("n <> top + 1 or low <> 0 or d <> n").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    from evenkeel.scratch import new_folder, shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert os.path.basename(new_folder(spark, "x")).startswith("evenkeel-x-")


def test_streaming_readers(spark, tmp_path, folder):
    (tmp_path / "a.csv").write_text("1,2\n3\n\n")
    stream = records.stream_key_records(spark, str(tmp_path))
    out = folder()
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 2, 3]
    generator = generated.zipf_stream(spark, 10, 100, 2.0)
    assert generator.isStreaming and generator.columns == ["seq", "key"]


def test_documents_need_ids_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="3 documents have 2 different ids"):
        shape.word_stream(docs)
    assert [r["key"] for r in shape.word_stream(docs.limit(2)).orderBy("seq").collect()] == ["a", "b", "c"]
