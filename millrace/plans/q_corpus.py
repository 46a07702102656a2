"""Corpus-level queries: exact deduplication and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def m1_f1_gate_after_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of a length gate over documents deduplicated by trimmed text, lowest doc_id kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.trim("text").alias("key"))
    kept = docs.filter(F.col("key") != "").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    reason = F.when(F.length("key") < 80, "response_too_short").when(F.contains(F.lower("key"), F.lit("###")), "banned_phrase").otherwise("ok")
    return kept.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {"m1_f1_gate_after_dedup": m1_f1_gate_after_dedup}
SQL = {
    "m1_f1_gate_after_dedup": """
        WITH kept AS (SELECT trim(text) AS key, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY 1)
        SELECT CASE WHEN length(key) < 80 THEN 'response_too_short' WHEN contains(lower(key), '###') THEN 'banned_phrase' ELSE 'ok' END AS reason,
               count(*) AS n
        FROM kept GROUP BY 1""",
}
