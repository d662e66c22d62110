"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, decontaminate, importance, license_scan, line_frequency, near_dups, oracle, packing, periodic_runs, quality, site_spread, token_counts, unit_dedup, url_filter
from .common import spread, table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
QUALITY_FROM = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_chunks.encode_decode(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))
    return bpe_digests(out)


def bpe_digests(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = quality.tokenised(documents(spark, sf_dir), {"doc_id": F.col("doc_id")})
    out = quality.score(seen, quality.train(seen, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= QUALITY_FROM, 1).otherwise(0).alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(unit_dedup.repeated_passages(documents(spark, sf_dir)))


def passage_digests(out: DataFrame) -> DataFrame:
    places = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    kept = F.array_join(F.col("kept_in").cast("array<string>"), ",")
    return out.select("doc_id", "n_units", "n_repeated", "n_removed", places.alias("removed_spans"), kept.alias("kept_in"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def contamination_digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(site_spread.remove_spread_lines(documents(spark, sf_dir)))


def _cleaned(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_removed_lines", "n_removed_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def made_up_repetition(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """A tenth of the documents, by CRC-32 of the id, repeat themselves from a word on: its number and the period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    start = g % n
    return None if h % 10 else (start, 1 + (n - start) // (3 + g % 8))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(documents(spark, sf_dir), fold=made_up_repetition))


QUERIES = {
    f.__name__: f
    for f in (op1_line_frequency, op2_bpe_chunks, op3_quality, op4_token_counts, op5_license_scan, op6_unit_dedup, op7_decontaminate, op8_near_dups, op9_url_filter, op10_site_spread, op11_packing, op12_importance, op13_periodic_runs)
}
SQL: dict[str, str] = {
    "op1_line_frequency": oracle.OP1,
    "op5_license_scan": oracle.OP5,
    "op6_unit_dedup": oracle.OP6,
    "op7_decontaminate": oracle.OP7,
    "op8_near_dups": oracle.OP8,
    "op9_url_filter": oracle.OP9,
    "op10_site_spread": oracle.OP10,
    "op12_importance": oracle.OP12,
}
