"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import (
    bpe,
    decontaminate,
    langid,
    license_scan,
    line_dedup,
    lm_score,
    periodic,
    quality,
    resample,
    simhash,
    token_files,
    toxicity,
    warc,
)
from evenkeel.scratch import new_folder

TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """A file of the public vocabularies; their package names its place if it can be imported."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_checksums(spark, path)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), quality.quality_labels(spark, sf_dir))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_report(license_scan.license_spans(table(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = resample.resample_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.with_planted_tail)
    return periodic.run_report(periodic.collapsed(*found))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_files, op3_simhash, op4_warc, op5_bpe,
        op6_line_dedup, op7_langid, op8_toxicity, op9_lm_score, op10_quality,
        op11_licenses, op12_resample, op13_periodic,
    )
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_warc": warc.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_lm_score": lm_score.SQL,
    "op12_resample": resample.SQL,
    "op13_periodic": periodic.SQL,
}
