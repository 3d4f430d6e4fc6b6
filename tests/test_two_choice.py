"""The chunked two-choice rule equals the sequential one, whatever the chunks and the skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import skewed, two_choice
from evenkeel import TwoChoiceGrouping
from evenkeel.operators import shape
from evenkeel.operators import carry


def workers(df):
    return [r["worker"] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("chunk_rows", [40, 150, 10_000])
@pytest.mark.parametrize("s", [1, 3])
def test_chunks_do_not_change_the_result(keyed, chunk_rows, s):
    keys = skewed(900)
    got = workers(TwoChoiceGrouping(5, s, chunk_rows=chunk_rows).assign(keyed(keys)))
    assert got == two_choice(keys, 5, lambda i, _: i % s)


def test_a_source_that_holds_most_rows(keyed):
    keys = skewed(800)
    source = lambda i, _: 0 if i % 5 else 1 + i % 2
    rows = keyed(keys).withColumn(
        "source", F.when(F.col("seq") % 5 != 0, 0).otherwise(1 + F.col("seq") % 2).cast("int")
    )
    placed = shape.number_within(rows, ["source"], ["seq"])
    got = workers(TwoChoiceGrouping(6, None, chunk_rows=100).assign(placed))
    assert got == two_choice(keys, 6, source)


def test_string_keys_and_at_most_two_homes(keyed):
    keys = [f"w{x}" for x in skewed(600)]
    routed = TwoChoiceGrouping(7, 2, chunk_rows=64).assign(keyed(keys))
    assert workers(routed) == two_choice(keys, 7, lambda i, _: i % 2)
    homes = routed.groupBy("key").agg(F.count_distinct("worker").alias("n")).agg(F.max("n")).first()[0]
    assert homes <= 2


def test_loads_per_source(keyed):
    keys = skewed(500)
    loads = TwoChoiceGrouping(5, 2, chunk_rows=60).loads(keyed(keys))
    assert loads.agg(F.sum("load")).first()[0] == 500
    want = two_choice(keys, 5, lambda i, _: i % 2)
    got = {(r["source"], r["worker"]): r["load"] for r in loads.collect()}
    for source in (0, 1):
        for worker in range(5):
            assert got[(source, worker)] == sum(w == worker for w in want[source::2])


def some_codes(rng, k, n):
    """Codes as hashing gives them: a key always has the same two candidates, and some keys are frequent."""
    of_key = rng.integers(0, k * k, 60).astype(np.int32)
    return of_key[np.minimum(rng.zipf(1.5, n) - 1, 59)]


def test_room_tells_when_a_shift_changes_choices():
    rng = np.random.default_rng(5)
    k, kept = 6, 0
    for _ in range(300):
        codes = some_codes(rng, k, 60)
        start = rng.integers(0, 4, k)
        gaps = carry.two_choice_kernel(codes, start, k)
        shift = rng.integers(-1, 2, k) if rng.random() < 0.7 else np.full(k, 3)
        fits = carry.has_room(*carry.room_of(codes, gaps, k), shift, k)
        again = carry.two_choice_kernel(codes, start + shift, k)
        assert fits == (carry.chosen_of(codes, again, k) == carry.chosen_of(codes, gaps, k))[codes // k != codes % k].all()
        kept += fits
    assert 0 < kept < 300


@pytest.mark.parametrize("n", [0, 1, 70, 3000])
def test_moving_a_chunk_equals_a_run_from_there(n, monkeypatch):
    monkeypatch.setattr(carry, "_REPLAY", 16)
    rng = np.random.default_rng(n)
    for k in (2, 5, 9):
        for far in (1, 3, 200):
            codes, start = some_codes(rng, k, n), rng.integers(0, 50, k)
            gaps = carry.two_choice_kernel(codes, start, k)
            to = start + rng.integers(-far, far + 1, k)
            want = carry.two_choice_kernel(codes, to, k).tolist()
            assert carry.replayed(codes, gaps, start, to, k).tolist() == want
            assert carry.shifted(codes, gaps, start, to, k)[0].tolist() == want


def test_groups_and_their_sums():
    codes = np.array([1, 2 * 4 + 3] * 40, np.int32)
    gaps = carry.two_choice_kernel(codes, np.array([0, 0, 100, 100]), 4)
    assert carry.level_groups(codes, gaps, 4).tolist() == [0, 0, 2, 2]
    moved = carry.with_group_sums(np.array([5, 5, 9, 9]), np.array([12, 1, 0, 17]), np.array([0, 0, 2, 2]))
    assert moved.tolist() == [7, 6, 9, 8]


def test_a_guess_keeps_the_number_of_rows():
    rng = np.random.default_rng(2)
    codes = some_codes(rng, 7, 999)
    cells, counts = np.unique(codes, return_counts=True)
    assert carry.foreseen(np.arange(7), cells.astype(np.int64), counts, 7).sum() == 21 + 999


def chunks_of(spark, codes, k, size):
    """One source, cut into chunks."""
    rows = [(0, n, [(i << 32) + int(c) for i, c in enumerate(codes[a : a + size])]) for n, a in enumerate(range(0, len(codes), size))]
    return spark.createDataFrame(rows, "source int, chunk long, ops array<long>").repartition(4)


@pytest.mark.parametrize("k, hot", [(32, 0.3), (8, 0.5), (32, 0.1), (32, 0.0)])
def test_hot_keys_take_two_replays_of_a_chunk_at_most(spark, k, hot):
    rng = np.random.default_rng(k)
    n, size = 48_000, 4_000
    keys = np.where(rng.random(n) < hot, 7, rng.integers(8, 10**6, n))
    first, second = (((keys * a + b) % 10000019) % k for a, b in ((3141593, 2718282), (5772157, 1618034)))
    codes = (first * k + second).astype(np.int32)
    found = carry.carry_loads(chunks_of(spark, codes, k, size), k, n // size).orderBy("chunk").collect()
    assert len(found) == 12 and max(r["replays"][0] for r in found) <= 2
    want = carry.chosen_of(codes, carry.two_choice_kernel(codes, np.zeros(k, np.int64), k), k)
    assert [w for r in found for w in r["chosen"]] == want.tolist()


def test_a_jump_of_the_stream_is_walked_through(spark):
    rng = np.random.default_rng(3)
    k, n, size = 16, 24_000, 2_000
    hot = rng.random(n) < 0.4 * (np.arange(n) > 9_300)
    codes = np.where(hot, 3 * k + 11, rng.integers(0, k * k, n)).astype(np.int32)
    codes[15_000:20_000] = 5 * k + 6
    initial = spark.createDataFrame([(0, [0, 50] * 8)], "source int, loads array<long>")
    found = carry.carry_loads(chunks_of(spark, codes, k, size), k, n // size, initial).orderBy("chunk").collect()
    want = carry.chosen_of(codes, carry.two_choice_kernel(codes, np.array([0, 50] * 8), k), k)
    assert [w for r in found for w in r["chosen"]] == want.tolist()


def test_exchanges_carry_few_columns(keyed):
    """What follows from a row's number does not travel: one number to decide, then the row as it is."""
    plan = TwoChoiceGrouping(4, 2).assign(keyed(["a", "b"] * 50))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("pmod(seq#" in line for line in sent) and any("pmod((_both#" in line for line in sent)
    assert not any("chunk#" in line and "_chunk#" not in line and "REPARTITION" in line for line in sent)


def test_numbers_are_packed_and_unpacked():
    for numbers in ([], [0], [-128, 127], [128], [-32769, 5], [2**31, -(2**40)]):
        data = carry.packed(np.array(numbers, np.int64))
        assert carry.unpacked(memoryview(data)).tolist() == numbers
        assert len(data) == 1 + len(numbers) * data[0]
    assert [carry.packed(np.array([n]))[0] for n in (0, 128, 1 << 15, 1 << 31)] == [1, 2, 4, 8]


def test_what_is_held_at_once_does_not_grow_with_the_rows(keyed, spark, tmp_path, monkeypatch):
    """Many chunks a task: readers hold small row groups of bytes, and no list of a chunk's rows is made in an aggregate."""
    import pyarrow.parquet as pq

    monkeypatch.setattr("evenkeel.scratch.shared_folder", lambda _: f"file://{tmp_path}")
    keys = skewed(4000)
    assert workers(TwoChoiceGrouping(5, 2, chunk_rows=10).assign(keyed(keys))) == two_choice(keys, 5, lambda i, _: i % 2)
    for label in ("chunks", "runs", "moved", "answers"):
        found = [pq.ParquetFile(f).metadata for f in tmp_path.glob(f"evenkeel-{label}-*/*.parquet")]
        sizes = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
        assert sum(sizes) == 400 and max(sizes) <= 16
        kinds = {m.schema.column(i).path.split(".")[0]: m.schema.column(i).physical_type for m in found for i in range(m.num_columns)}
        assert all(kinds[c] == "BYTE_ARRAY" for c in ("code", "gap") if c in kinds)
    plan = lambda: TwoChoiceGrouping(4, 2).assign(keyed(["a", "b"] * 3000))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan()
    tasks = TwoChoiceGrouping(4, 2)._tasks
    assert tasks(spark, 1 << 24) == 16 and tasks(spark, 1 << 30) == 1024 and tasks(spark, 1000) <= 4
