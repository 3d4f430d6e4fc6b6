"""From raw documents to token ids: quality rules, line dedup, near-duplicates, decontamination, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and hands what it reads back to the next one. All stages but the last
return the columns of documents. Stages that run Python make the session's Arrow batches small
(:func:`small_batches`), which they still need when what they return is written; ``run`` undoes that.

Near-duplicates: documents that share 0.8 of their five-word shingles are linked, and of each group
of copies that with the least id stays. The radius of the SimHash query is too narrow for that, so
the stage of this name compares shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bpe, copies, decontaminate, line_dedup, quality
from evenkeel.llm.queries import table, tokenizer_path
from evenkeel.scratch import new_folder, pin

# Fewer than the operator's own: the heap of an executor has grown to its full size by the last stage.
BPE_CACHED = 100_000

# Rows that go to a Python worker at once. Spark's default, 10,000, is some 35 MB of text, held by the JVM outside its
# heap and by the worker, of which there are as many as cores; neither gives all of it back between stages.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> bool:
    """Have the session's stages send ``BATCH_ROWS`` rows at once; whether that was set here. A size that the session names itself holds."""
    unset = _BATCH_SETTING not in spark.conf.getAll
    if unset:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    return unset


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go; a null id is decided by the text alone."""
    small_batches(spark)
    return quality.keep_good(docs, quality.quality_labels(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or nearly equal one go, and short lines with them; documents without lines left go too."""
    lines, removed = "_lines_of_text", "_lines_removed"
    done = line_dedup.dedup_lines(docs, context=True, counts=(lines, removed)).where(F.col(removed).eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    left = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", left).select(docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return copies.keep_first(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of ids and decoded text; executors still hold what earlier stages grew to."""
    small_batches(spark)
    return bpe.bpe_digests(docs, tokenizer_path("word_bpe_49k.json"), cached=BPE_CACHED)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", copies_stage),
    ("decontaminate", leaks_stage),
    ("bpe", tokens_stage),
]

# The forest, SimHash and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ours = small_batches(spark)
    try:
        for name, stage in STAGES:
            docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        if ours:
            spark.conf.unset(_BATCH_SETTING)
    return docs
