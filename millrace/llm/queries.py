"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, centroids, filter_audit, language_id, licence_texts, licenses, media, packing, quality_rules, secret_scan, sharding, simhash, sql, substring, weak_quality


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict of every document."""
    rows = quality_rules.judged(quality_rules.ledger(_documents(spark, sf_dir)))
    base = quality_rules.mask(quality_rules.POLICIES["base", 1])
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document's ids lies in sequences of 2048."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return packing.packed(_documents(spark, sf_dir), path, pattern).drop("ids")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, of 40 shards; the law is that of row counts."""
    rows = sharding.sharded(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as an image and read back, and its perceptual hash."""
    rows = media.features(media.with_media(_documents(spark, sf_dir)))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class (smallest doc_id reachable over links) of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans of every text, and all spans with those that the field adds."""
    rows = secret_scan.scanned(_documents(spark, sf_dir))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "crf")]
    base = listed(F.filter("spans", lambda s: s["kind"] != "crf"))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every text's ids, and the digest of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decoded(bpe.encoded(_documents(spark, sf_dir), path, pattern), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text's canonical form, the licence that it is, and one-line notices in it."""
    rows = licenses.scanned(_documents(spark, sf_dir), licence_texts.KNOWN)
    return rows.withColumn("notices", F.array_join("notices", ","))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that occurred earlier, and where they were."""
    rows = substring.deduplicated(_documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed_spans"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, weak label, score and verdict of every document."""
    return weak_quality.classified(_documents(spark, sf_dir))


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of every vector after five rounds, with inertias and the centroid's digest."""
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles, learned from the four fifths that aren't held out."""
    docs = _documents(spark, sf_dir)
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return language_id.identified(docs, language_id.profiles(docs, remainder != 0), "text", "doc_id", (remainder == 0).alias("held_out"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps of each language, and each filter's share."""
    return filter_audit.audited(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_packing": op2_packing,
        "op3_feistel_shards": op3_feistel_shards,
        "op4_media_columns": op4_media_columns,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_license_scan": op8_license_scan,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_weak_quality": op10_weak_quality,
        "op11_exponion_clusters": op11_exponion_clusters,
        "op12_language_id": op12_language_id,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": sql.OP1,
        "op8_license_scan": sql.op8(licence_texts.KNOWN, licenses.SPELLINGS, licenses.COPYRIGHT),
        "op9_substring_dedup": sql.OP9,
        "op11_exponion_clusters": sql.op11(),
        "op12_language_id": sql.op12(),
        "op13_filter_audit": sql.OP13,
    }
