"""NULL keys, gaps in the numbering and workers out of range."""

import pytest
from pyspark.sql import functions as F

from evenkeel import HashGrouping, LearnedGrouping, OnlineGrouping, TwoChoiceGrouping
from evenkeel.operators import metrics
from evenkeel.plans.groupings import ColumnGrouping

HALF = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 0 ELSE id END"


def rows(spark, n=60, kind="BIGINT"):
    return spark.range(n).selectExpr("id AS seq", f"CAST({HALF} AS {kind}) AS key")


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
@pytest.mark.parametrize(
    "grouping",
    [
        HashGrouping(4),
        HashGrouping(4, murmur=True),
        TwoChoiceGrouping(4, 2),
        LearnedGrouping(4, 0.1, learn=20),
        OnlineGrouping(4, 2, 10, 0.1),
        OnlineGrouping(4, 2, 10, 0.1, order="load", tail="flush"),
    ],
    ids=lambda g: f"{g.name}-{getattr(g, 'tail', '')}{getattr(g, 'murmur', '')}",
)
def test_null_keys_keep_their_rows(spark, grouping, kind):
    routed = grouping.assign(rows(spark, kind=kind)).cache()
    given = 60
    assert routed.count() == routed.select("seq").distinct().count() == given
    assert metrics.worker_load(routed, 4).agg(F.sum("load")).first()[0] == given


def test_a_heavy_null_key_is_placed_apart_from_zero(spark):
    table = OnlineGrouping(4, 2, 10, 0.1).routing(rows(spark)).where("period = 1").collect()
    assert sorted(r["cnt"] for r in table if r["key"] is None) == [7]
    assert sorted(r["cnt"] for r in table if r["key"] == 0) == [7]


def test_two_choice_with_gaps(spark):
    kept = [i for i in range(200) if i % 4 != 1]
    df = spark.createDataFrame([(i, i % 7) for i in kept], "seq long, key long")
    whole = TwoChoiceGrouping(4, 1, chunk_rows=16).assign(df).orderBy("seq").collect()
    dense = spark.createDataFrame([(n, i % 7) for n, i in enumerate(kept)], "seq long, key long")
    wanted = TwoChoiceGrouping(4, 1, chunk_rows=16).assign(dense).orderBy("seq").collect()
    assert [r["seq"] for r in whole] == kept
    assert [r["worker"] for r in whole] == [r["worker"] for r in wanted]


@pytest.mark.parametrize("by", [(), ("part",)])
def test_workers_out_of_range_fail(spark, by):
    df = spark.range(20).selectExpr("id AS seq", "id AS key", "id % 2 AS part")
    routed = ColumnGrouping(4, lambda key: key).assign(df)
    with pytest.raises(Exception, match="worker not in 0..3"):
        metrics.worker_load(routed, 4, by).collect()
    with pytest.raises(Exception, match="worker not in 0..3: NULL"):
        metrics.worker_load(df.withColumn("worker", F.lit(None).cast("int")), 4, by).collect()
