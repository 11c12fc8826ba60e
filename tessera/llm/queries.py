"""The opN_ queries: thin wrappers that apply an operator to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mpeg import media_features

    out = media_features(table(spark, sf_dir, "documents"))
    found = F.concat_ws(":", "frames", "samples", "rate", "duration_s", F.sha2("seek_offsets", 256), "table_ok", "crc_checked", "crc_bad", "skipped")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", found.alias("feature"))


def op4_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.dialogue import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.addquant import search

    return search(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.unigram import sentencepiece_digest

    return sentencepiece_digest(table(spark, sf_dir, "documents"))


def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.wavelet import token_shards

    return token_shards(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mainregion import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_groups

    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rotation_sql() -> str:
    from tessera.llm.dialogue import ORACLE

    return ORACLE.replace("{conversations}", "conversations")


def _mixing_sql() -> str:
    from tessera.llm.mixing import ORACLE

    return ORACLE.replace("{documents}", "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_rotate_perspectives": op4_rotate_perspectives,
    "op5_additive_quantisation": op5_additive_quantisation,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_wavelet_shards": op7_wavelet_shards,
    "op8_main_text": op8_main_text,
    "op9_licence_scan": op9_licence_scan,
    "op10_simhash_groups": op10_simhash_groups,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op1_mix_sources": _mixing_sql,
    "op4_rotate_perspectives": _rotation_sql,
}
