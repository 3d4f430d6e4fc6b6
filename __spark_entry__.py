"""Registered queries: every operator over the given tables, with its SQL equivalent.

``entry`` runs the online grouping on the small tables, ``queries`` lists all operators, and
``oracle_sql`` the SQL that must give the same rows.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle as o
from evenkeel import (
    ColumnGrouping,
    HashGrouping,
    LearnedGrouping,
    OnlineGrouping,
    PandasGrouping,
    TwoChoiceGrouping,
    compare,
)
from evenkeel.functions import hashing, zipf
from evenkeel.operators import metrics, placement, routing, shape, sketches
from evenkeel.scratch import new_folder, pin
from evenkeel.sources import generated, records, sinks
from evenkeel.streaming import groupings as streams

# The operators for training data are optional: both may be missing, and only here is that met.
try:
    import corpus_pipeline
    from evenkeel.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

HASH = HashGrouping(o.K)
TWO_CHOICE = TwoChoiceGrouping(o.K, o.S)
DKG = LearnedGrouping(o.K, o.DKG_THETA, o.FACTOR, o.LEARN)
DKG_DISCARD = LearnedGrouping(o.K, o.DKG_THETA, o.FACTOR, o.LEARN, learned="discard", skip=o.SKIP)
TWO_CHOICE_HOT = TwoChoiceGrouping(o.HOT_K, o.S, chunk_rows=o.HOT_CHUNK)
ONLINE = OnlineGrouping(o.K, o.S, o.M, o.THETA, o.EPS)
ONLINE_DROP = OnlineGrouping(o.K, o.S, o.M, o.THETA, o.EPS, tail="drop")
ONLINE_SHORT = OnlineGrouping(o.K, o.S, o.SHORT_M, o.SHORT_THETA)
WORD_HASH = HashGrouping(o.WK)
WORD_TWO_CHOICE = TwoChoiceGrouping(o.WK, o.WS)
WORD_DKG = LearnedGrouping(o.WK, o.WTHETA, o.FACTOR, o.LEARN)
WORD_ONLINE = OnlineGrouping(o.WK, o.WS, o.WM, o.WTHETA)


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    """Integer keys: the events, numbered by their dense id."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


def hot_ev(spark: SparkSession, d: str) -> DataFrame:
    """The events with one key that holds three rows in ten."""
    return ev(spark, d).withColumn("key", F.when(F.col("seq") % 10 < 3, o.HOT_KEY).otherwise(F.col("key")).cast("bigint"))


def wd(spark: SparkSession, d: str) -> DataFrame:
    """String keys: every word of every document, naturally skewed."""
    return shape.word_stream(table(spark, d, "documents"))


def written_words(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once for strategies that read the stream several times."""
    return pin(wd(spark, d).select("seq", "key"), "words", codec="zstd")


def bare_words(spark: SparkSession, d: str) -> DataFrame:
    """The words without numbering, for operators that need no order."""
    exploded = table(spark, d, "documents").select(F.explode_outer(shape.words("text")).alias("key"))
    return exploded.where(F.col("key").isNotNull())


def ev_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream: written in ranges, read a few files per micro-batch."""
    path = new_folder(spark, "arrivals")
    rows = ev(spark, d)
    rows.repartitionByRange(6, "seq").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def staged(spark: SparkSession, d: str) -> DataFrame:
    return ONLINE.stage(ev(spark, d))


def complete(spark: SparkSession, d: str, dense: bool = True) -> DataFrame:
    return shape.complete_only(staged(spark, d), o.S, o.M, "drop", dense)


def sketch_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heavy keys, histogram and sparse buckets of each source and period."""
    bucket_of = hashing.key_hash(rows, o.K)
    heavy = sketches.heavy_hitters(rows, o.THETA, o.EPS)
    hist = sketches.bucket_hist(rows, o.K, bucket_of)
    return heavy, hist, sketches.sparse_buckets(hist, heavy, bucket_of)


def online_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged rows, routing tables of all periods (written once), and routed rows."""
    rows = ev(spark, d)
    periods = ONLINE.periods(rows)
    stage = ONLINE.stage(rows, periods)
    tables = pin(ONLINE.routing(rows), "routing")
    return stage, tables, ONLINE.route(stage, tables, periods)


def hash_loads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worker_load(HASH.assign(ev(spark, d)), o.K)


# ---------------------------------------------------------------- sources and sinks


def scan_key_records(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "records")
    (
        ev(spark, d)
        .groupBy(F.floor(F.col("seq") / 10).alias("rec"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "key"))).alias("items"))
        .repartitionByRange("rec")
        .sortWithinPartitions("rec")
        .select(F.array_join(F.col("items.key").cast("array<string>"), ",").alias("value"))
        .write.text(path)
    )
    return records.read_key_records(spark, path)


def _access_log(spark: SparkSession, d: str) -> str:
    """Pages as a gzip log; some lines are short, some empty."""
    path = new_folder(spark, "log")
    line = F.concat_ws(" ", "page_id", F.length("html"), "url", F.lit("-"))
    short = F.concat_ws(" ", "page_id", F.length("html"))
    (
        table(spark, d, "pages")
        .withColumn(
            "value",
            F.when(F.col("page_id") % 7 == 6, "").when(F.col("page_id") % 5 == 4, short).otherwise(line),
        )
        .repartitionByRange("page_id")
        .sortWithinPartitions("page_id")
        .select("value")
        .write.option("compression", "gzip")
        .text(path)
    )
    return path


def sink_period_stats(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "stats")
    sinks.write_stats(metrics.period_imbalance(HASH.assign(staged(spark, d)), o.K), path)
    return spark.read.schema("period bigint, imbalance double, sigma double").csv(path)


def route_to_partitions(spark: SparkSession, d: str, splits: int = 1) -> DataFrame:
    placed = sinks.deliver(HASH.assign(ev(spark, d)), o.K, splits=splits)
    return placed.groupBy("worker", F.spark_partition_id().alias("part")).agg(F.count("*").alias("cnt"))


# ---------------------------------------------------------------- shape and functions


def period_assign_by_position(spark: SparkSession, d: str) -> DataFrame:
    uneven = ev(spark, d).withColumn("source", F.pmod("key", F.lit(o.S)).cast("int"))
    placed = shape.number_within(uneven, ["source"], ["seq"])
    return shape.with_period_by_position(placed, o.M).select("seq", "source", "period")


def learn_assign_split(spark: SparkSession, d: str) -> DataFrame:
    learned, rest = shape.split_learning(ev(spark, d), o.LEARN)
    return learned.select(F.lit("learn").alias("phase"), "seq", "key").unionByName(
        rest.select(F.lit("route").alias("phase"), "seq", "key")
    )


def hash_cw_string(spark: SparkSession, d: str) -> DataFrame:
    counts = sketches.key_counts(bare_words(spark, d), ())
    return counts.select("key", hashing.key_hash(counts, o.WK)("key").alias("worker"), "cnt")


def harmonic_number(spark: SparkSession, d: str) -> DataFrame:
    rank = F.col("event_id") + 1
    sums = [zipf.harmonic_sum(rank, z).alias(str(i)) for i, z in enumerate((1.0, 2.0, 3.0))]
    one = table(spark, d, "events").agg(*sums)
    pairs = F.array(*[F.struct(F.lit(z).alias("z"), F.round(str(i), 9).alias("harmonic")) for i, z in enumerate((1.0, 2.0, 3.0))])
    return one.select(F.inline(pairs))


def routing_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "events").agg(zipf.harmonic_sum(F.col("event_id") + 1, 2.0).alias("h"))
    return total.select(F.round(zipf.expected_table_size(0.0001, F.col("h"), 2.0), 6).alias("table_size"))


def hash_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = ev(spark, d)
    pair = hashing.candidates(rows, o.K)
    return rows.select("seq", pair[0].alias("first"), pair[1].alias("second"))


def heavy_sorted(spark: SparkSession, d: str) -> DataFrame:
    heavy, _, _ = sketch_of(staged(spark, d))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("cnt"), "key")).cast("bigint")
    return placement.top_heavy(sketches.merge_heavy(heavy)).withColumn("place", place)


def least_loaded(spark: SparkSession, d: str) -> DataFrame:
    totals = metrics.period_worker_load(HASH.assign(staged(spark, d)), o.K)
    return placement.least_loaded(totals.select("period", "worker", F.col("total").alias("load")), ["period"])


# ---------------------------------------------------------------- placement and routing


def place_heavy(spark: SparkSession, d: str, order: str = "key") -> DataFrame:
    heavy, _, sparse = sketch_of(staged(spark, d))
    items = placement.placement_items(*sketches.merge_sketches(heavy, sparse), by=["period"])
    return placement.place_online(items, o.K, order).select("period", "key", "worker")


def placement_loads(spark: SparkSession, d: str) -> DataFrame:
    items = pin(ONLINE.items(staged(spark, d)), "items")
    return placement.placement_loads(ONLINE.place(items), sketches.split_items(items)[1], o.K)


def learned_items(spark: SparkSession, d: str) -> DataFrame:
    return DKG.items(DKG.learning(ev(spark, d)))


def route_two_level(spark: SparkSession, d: str) -> DataFrame:
    rows = ev(spark, d)
    return DKG.route(DKG.to_route(rows), *DKG.maps(rows))


def route_lookup_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Tables too large to send: rows are dealt out by period once, for sketch and lookup."""
    return ONLINE.assign_in_place(staged(spark, d)).select("seq", "key", "period", "worker")


def distinct_keys_hll(spark: SparkSession, d: str) -> DataFrame:
    """The exact number, and whether the estimate is within a hundredth of it."""
    words = bare_words(spark, d)
    guess = sketches.distinct_keys(words, "hll").scalar()
    off = F.abs(guess - F.col("distinct_keys")) <= F.col("distinct_keys") / 100
    return sketches.distinct_keys(words).withColumn("near", off)


def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return routing.migration(online_parts(spark, d)[1])


def state_relocate(spark: SparkSession, d: str) -> DataFrame:
    _, tables, routed = online_parts(spark, d)
    plan = pin(routing.migration(tables), "plan")
    last = plan.where(F.col("period") == plan.agg(F.max("period")).scalar())
    # Two successive tables of one period each.
    bound = 2 * ONLINE.heavy_per_period
    return routing.relocate(routing.keyed_state(routed), last, hashing.KeyHash(o.K), bound)


def zipf_source_wide(spark: SparkSession, d: str) -> DataFrame:
    """Keys out of a billion; SQL can tell the first ones, and that the others lie beyond them."""
    keys = generated.with_zipf_key(ev(spark, d).select("seq"), o.ZIPF_WIDE, o.ZIPF_Z, o.ZIPF_SEED)
    known = F.col("key") <= zipf.HEAD_KEYS
    return keys.select("seq", F.when(known, F.col("key")).alias("key"), F.col("key").between(1, o.ZIPF_WIDE).alias("valid"))


def compile_stats(spark: SparkSession, d: str, timed: bool = False) -> DataFrame:
    stage, tables, _ = online_parts(spark, d)
    built = ONLINE.place(ONLINE.items(stage), timed=True) if timed else None
    return metrics.compile_stats(stage.select("period").distinct(), tables, routing.migration(tables), built)


def sink_compile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and build times written as CSV, and read again; the times differ from run to run."""
    path = new_folder(spark, "compile-stats")
    sinks.write_stats(compile_stats(spark, d, timed=True), path)
    stats = spark.read.schema("period bigint, routing_size bigint, migration_size bigint, build_us bigint").csv(path)
    return stats.select("period", "routing_size", "migration_size", (F.col("build_us") >= 0).alias("timed"))


def space_saving_merged(spark: SparkSession, d: str) -> DataFrame:
    """Frequent words by exact count, and whether the merged summary of all words holds each within its bound."""
    words = pin(bare_words(spark, d), "words", codec="zstd")
    kept = sketches.merged_space_saving(words, 1 / o.WORD_COUNTERS)
    exact = sketches.key_counts(words, ())
    total = words.agg(F.count("*")).scalar()
    frequent = exact.where(F.col("cnt") * o.WORD_COUNTERS > total)
    low, high = F.col("count") - F.col("err"), F.col("count")
    bound = (low <= F.col("cnt")) & (F.col("cnt") <= high) & (F.col("err") * o.WORD_COUNTERS <= total)
    return frequent.join(kept, "key", "left").select("key", "cnt", F.coalesce(bound, F.lit(False)).alias("bounded"))


def custom_ordered_grouping(spark: SparkSession, d: str) -> DataFrame:
    """A user's rule that deals the rows of each window out in turn."""
    k = o.K
    turn = PandasGrouping(k, o.S, o.M, lambda pdf: [i % k for i in range(len(pdf))])
    return turn.assign(ev(spark, d)).select("seq", "key", "worker")


# ---------------------------------------------------------------- streams


def _online_stream(spark: SparkSession, d: str) -> streams.OnlineStream:
    return streams.OnlineStream(new_folder(spark, "online"), ONLINE).run(ev_stream(spark, d))


def stream_two_choice(spark: SparkSession, d: str) -> DataFrame:
    runner = streams.TwoChoiceStream(new_folder(spark, "two-choice"), TWO_CHOICE, window=300)
    return runner.run(ev_stream(spark, d)).drained().select("seq", "key", "source", "worker")


def stream_learned(spark: SparkSession, d: str) -> DataFrame:
    return streams.LearnedStream(new_folder(spark, "learned"), DKG).run(ev_stream(spark, d)).drained()


def _windows(spark: SparkSession, d: str) -> streams.CountWindows:
    return streams.CountWindows(new_folder(spark, "windows"), o.S, o.M).run(ev_stream(spark, d))


def stream_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    """Running counts per key, each shown on the worker that owns the key in the last period."""
    counts = streams.stream_keyed_counts(ev_stream(spark, d), new_folder(spark, "counts"))
    rows = ev(spark, d)
    tables = pin(ONLINE.routing(rows), "routing")
    last = tables.where(F.col("period") == F.lit(ONLINE.periods(rows)))
    return routing.route_online(counts, last, hashing.KeyHash(o.K), ONLINE.heavy_per_period, by=()).select(
        "worker", "key", "cnt"
    )


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Online grouping of the events, as balance over the periods."""
    return metrics.period_imbalance(ONLINE.assign(ev(spark, "/root/testdata/sf0.001")), o.K)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _grouping_queries()
    if llm:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def _grouping_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    rows_of = lambda g, source: lambda s, d: g.assign(source(s, d))
    worker_of = lambda g, source: lambda s, d: g.assign(source(s, d)).select("seq", "key", "worker")
    frequent = lambda mode, eps: lambda s, d: sketches.heavy_hitters(staged(s, d), o.THETA, eps, mode=mode)
    full = ["seq", "key", "source", "period", "worker"]
    return {
        # sources and sinks
        "scan_key_records": scan_key_records,
        "scan_access_log": lambda s, d: records.read_access_log(s, _access_log(s, d)),
        "access_log_short_lines": lambda s, d: records.short_lines(s, _access_log(s, d)),
        "zipf_source": lambda s, d: generated.with_zipf_key(
            ev(s, d).select("seq"), o.ZIPF_N, o.ZIPF_Z, o.ZIPF_SEED
        ),
        "stream_prefix": lambda s, d: shape.prefix(ev(s, d), o.LEARN),
        "sink_period_stats": sink_period_stats,
        "sink_compile_stats": sink_compile_stats,
        "zipf_source_wide": zipf_source_wide,
        "route_to_partitions": route_to_partitions,
        "route_to_split_partitions": lambda s, d: route_to_partitions(s, d, 3),
        # projections and filters
        "key_select": lambda s, d: shape.with_key(
            table(s, d, "pages").select("page_id", "url"), F.parse_url(F.col("url"), F.lit("HOST"))
        ).select("page_id", "key"),
        "source_round_robin": lambda s, d: shape.with_source(ev(s, d), o.S).select("seq", "source"),
        "period_assign": lambda s, d: staged(s, d).select("seq", "source", "period"),
        "period_assign_by_position": period_assign_by_position,
        "learn_assign_split": learn_assign_split,
        "complete_periods": lambda s, d: complete(s, d).select("seq", "source", "period"),
        "complete_periods_flush": lambda s, d: shape.complete_only(staged(s, d), o.S, o.M).select("seq", "source", "period"),
        "complete_periods_counted": lambda s, d: complete(s, d, dense=False).select("seq", "source", "period"),
        "heavy_hitter_filter": lambda s, d: sketches.heavy_hitter_filter(
            sketches.key_counts(bare_words(s, d), ()), 0.005
        ),
        # functions
        "hash_cw_int": lambda s, d: HASH.assign(ev(s, d)).select("seq", "worker"),
        "hash_cw_string": hash_cw_string,
        "hash_md5_string": lambda s, d: bare_words(s, d).distinct().select(
            "key", hashing.cw_hash_str(F.col("key"), o.WK, *hashing.COEFFICIENTS[0], fold=hashing.fold_md5).alias("worker")
        ),
        "hash_string_fold": lambda s, d: bare_words(s, d).distinct().select(
            "key", hashing.fold_utf16(F.col("key")).alias("folded")
        ),
        "hash_murmur": lambda s, d: HashGrouping(o.K, murmur=True).assign(ev(s, d)).select("seq", "worker"),
        "hash_candidates": hash_candidates,
        "hash_candidates_murmur": lambda s, d: ev(s, d).select(
            "seq", F.explode(hashing.murmur_candidates(F.col("key"), o.K)).alias("worker")
        ),
        "harmonic_number": harmonic_number,
        "routing_size_estimate": routing_size_estimate,
        # sketches
        "heavy_hitters": frequent("exact", o.EPS),
        "space_saving": frequent("space_saving", 1 / o.M),
        "space_saving_evicting": lambda s, d: sketches.space_saving(staged(s, d), 1 / o.COUNTERS),
        "space_saving_merged": space_saving_merged,
        "frequent_sketch": frequent("sketch", 1 / o.M),
        "bucket_histogram": lambda s, d: sketch_of(staged(s, d))[1],
        "sparse_residual": lambda s, d: sketch_of(staged(s, d))[2],
        "sketch_merge": lambda s, d: sketches.merge_heavy(sketch_of(staged(s, d))[0]),
        "sketch_merge_buckets": lambda s, d: sketches.merge_buckets(sketch_of(staged(s, d))[2]),
        "sketch_conservation": lambda s, d: sketches.check_conservation(*sketch_of(complete(s, d))[::2], o.M),
        "distinct_keys": lambda s, d: sketches.distinct_keys(bare_words(s, d)),
        "distinct_keys_hll": distinct_keys_hll,
        "keyed_count": lambda s, d: routing.keyed_state(HASH.assign(ev(s, d))),
        "keyed_count_merge": lambda s, d: routing.merge_partials(
            routing.keyed_state(TWO_CHOICE.assign(ev(s, d)))
        ),
        "worker_load": hash_loads,
        # placement
        "least_loaded": least_loaded,
        "place_heavy_online": place_heavy,
        "place_heavy_by_load": lambda s, d: place_heavy(s, d, "load"),
        "placement_loads": placement_loads,
        "place_lpt": lambda s, d: placement.place_lpt(learned_items(s, d), o.K),
        "heavy_sorted": heavy_sorted,
        "top_heavy": lambda s, d: placement.top_heavy(sketches.merge_heavy(sketch_of(staged(s, d))[0]), 20),
        "placement_items": learned_items,
        # routing
        "route_lookup": lambda s, d: online_parts(s, d)[2].select("seq", "key", "period", "worker"),
        "route_lookup_in_place": route_lookup_in_place,
        "route_two_level": route_two_level,
        "migration_plan": migration_plan,
        "state_relocate": state_relocate,
        "routing_kept": lambda s, d: routing.routing_kept(online_parts(s, d)[1]),
        "routing_dropped": lambda s, d: routing.routing_dropped(online_parts(s, d)[1]),
        "routing_added": lambda s, d: routing.routing_added(online_parts(s, d)[1]),
        # strategies
        "group_hash": rows_of(HASH, ev),
        "group_two_choice": lambda s, d: TWO_CHOICE.assign(ev(s, d)).select("seq", "key", "source", "worker"),
        "group_two_choice_hot": lambda s, d: TWO_CHOICE_HOT.assign(hot_ev(s, d)).select("seq", "key", "source", "worker"),
        "group_dkg": rows_of(DKG, ev),
        "group_dkg_discard": rows_of(DKG_DISCARD, ev),
        "group_online_drop": lambda s, d: ONLINE_DROP.assign(ev(s, d)).select(*full),
        "group_online_short_periods": lambda s, d: ONLINE_SHORT.assign(ev(s, d)).select(*full),
        "group_online": lambda s, d: ONLINE.assign(ev(s, d)).select(*full),
        "group_hash_words": worker_of(WORD_HASH, wd),
        "group_two_choice_words": worker_of(WORD_TWO_CHOICE, written_words),
        "group_dkg_words": worker_of(WORD_DKG, written_words),
        "group_online_words": lambda s, d: WORD_ONLINE.assign(written_words(s, d)).select(*full),
        "group_compare": lambda s, d: compare(ev(s, d), [HASH, TWO_CHOICE, DKG, ONLINE]),
        "custom_grouping": rows_of(ColumnGrouping(o.K, lambda key: F.pmod(key, F.lit(o.K))), ev),
        "custom_ordered_grouping": custom_ordered_grouping,
        # metrics
        "load_summary": lambda s, d: metrics.load_summary(hash_loads(s, d), o.K),
        "imbalance": lambda s, d: metrics.load_imbalance(hash_loads(s, d), o.K),
        "load_stddev": lambda s, d: metrics.load_stddev(hash_loads(s, d), o.K),
        "period_imbalance": lambda s, d: metrics.period_imbalance(ONLINE.assign(ev(s, d)), o.K),
        "period_worker_load": lambda s, d: metrics.period_worker_load(ONLINE.assign(ev(s, d)), o.K),
        "compile_stats": compile_stats,
        "source_counts": lambda s, d: metrics.source_counts(shape.with_source(ev(s, d), o.S)),
        "source_delay": lambda s, d: metrics.source_delay(
            metrics.period_spans(
                shape.with_period(
                    shape.with_source(
                        table(s, d, "events").select(F.col("event_id").alias("seq"), "ts"), o.S
                    ),
                    o.S,
                    o.M,
                )
            )
        ),
        # streams
        "stream_hash": lambda s, d: streams.stream_hash(ev_stream(s, d), HASH, new_folder(s, "hash")),
        "stream_online": lambda s, d: _online_stream(s, d).drained().select(*full),
        "stream_two_choice": stream_two_choice,
        "stream_learned": stream_learned,
        "stream_count_window": lambda s, d: _windows(s, d).result(),
        "stream_count_window_flush": lambda s, d: _windows(s, d).drained(),
        "stream_period_barrier": lambda s, d: _online_stream(s, d).barrier(),
        "stream_migration": lambda s, d: _online_stream(s, d).migration(),
        "stream_keyed_state": stream_keyed_state,
        "stream_drain": lambda s, d: streams.final_balance(_online_stream(s, d).drained(), ONLINE),
    }


def oracle_sql() -> dict[str, str]:
    return o.all_sql() | (llm.SQL if llm else {})
