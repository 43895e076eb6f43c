"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm import bpe, decontaminate, langid, licences, oracles, pii, quality, resampling, secrets, sharding, simhash, suffixes, warc, whitening
from gatherum.llm.common import scratch_path, table


def op1_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.configured_key(spark))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op6_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.embedded_notices(table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, payload=False))
    return warc.capture_table(captures)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(spark, docs).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_quality": op1_adaptive_quality,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_shard_placement": op3_shard_placement,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_licence_scan": op6_licence_scan,
    "op6_licence_windows": op6_licence_windows,
    "op7_simhash_components": op7_simhash_components,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_whitened_embeddings": op11_whitened_embeddings,
    "op12_repeat_removal": op12_repeat_removal,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_adaptive_quality": oracles.OP1,
    "op2_warc_transactions": oracles.OP2,
    "op3_shard_placement": oracles.OP3,
    "op6_licence_scan": oracles.OP6,
}
