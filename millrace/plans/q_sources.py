"""Discovery of files, quotas and sinks' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.fixtures import documents
from millrace.sources import json_files as J

#: File names as a reports folder has them, made from documents.
PATH = """concat('/reports/', CASE WHEN doc_id % 2 = 0 THEN concat(source, '/') ELSE '' END, CASE doc_id % 6 WHEN 0 THEN 'constitution' WHEN 1 THEN 'category' WHEN 2 THEN 'drift' WHEN 3 THEN 'persona' WHEN 4 THEN 'adversarial' ELSE 'other' END,
 '_report', CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('_', source) END, '_2026', lpad(CAST(doc_id % 1200 AS VARCHAR(8)), 4, '0'), '_', lpad(CAST(doc_id % 235959 AS VARCHAR(8)), 6, '0'), CASE WHEN doc_id % 19 = 0 THEN '_rescored' ELSE '' END, '.json')"""


def s4_s8_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The latest report per label and suite; folders win over labels in names."""
    files = documents(spark, d).select(F.expr(PATH.replace("VARCHAR(8)", "STRING")).alias("path"), F.col("doc_id").alias("changed"))
    return J.discovered(files)


def s6_newest(spark: SparkSession, d: str) -> DataFrame:
    """The latest report per label and suite by time of change, whatever its name."""
    files = documents(spark, d).select(F.expr(PATH.replace("VARCHAR(8)", "STRING")).alias("path"), F.col("doc_id").alias("changed"))
    return J.discovered(files, skip=None, newest_by="changed")


def s12_quota(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents of each source, those of 300 characters or more, in order of id."""
    return J.quota(documents(spark, d).filter("n_chars >= 300").select("doc_id", "source"), "source", 10, "doc_id")


def k3_total(spark: SparkSession, d: str) -> DataFrame:
    """Means per language with an OVERALL row."""
    return J.summed(documents(spark, d).select("lang", "n_chars"), "lang", "n_chars")


QUERIES = {f.__name__: f for f in (s4_s8_discovery, s6_newest, s12_quota, k3_total)}
_ALL_FILES = rf"""f AS (SELECT {PATH} AS path, doc_id AS changed FROM documents),
 p AS (SELECT path, changed, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS folder FROM f),
 s AS (SELECT *, regexp_extract(name, '{J.NAME}', 1) AS suite, regexp_extract(name, '{J.NAME}', 2) AS own, regexp_extract(name, '{J.NAME}', 3) AS stamp FROM p),
 r AS (SELECT *, CASE WHEN own <> '' THEN own ELSE folder END AS label FROM s WHERE suite <> '')"""
_FILES = _ALL_FILES.replace("FROM f)", "FROM f WHERE NOT regexp_matches(path, '_rescored|_alignment'))")
SQL = {
    "s4_s8_discovery": f"WITH {_FILES} SELECT label, suite, path FROM r QUALIFY row_number() OVER (PARTITION BY label, suite ORDER BY own = '' DESC, stamp DESC, name DESC, path DESC) = 1",
    "s6_newest": f"WITH {_ALL_FILES} SELECT label, suite, path FROM r QUALIFY row_number() OVER (PARTITION BY label, suite ORDER BY changed DESC) = 1",
    "s12_quota": "SELECT doc_id, source FROM documents WHERE n_chars >= 300 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10",
    "k3_total": "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1 UNION ALL SELECT 'OVERALL', count(*), round(avg(n_chars), 6) FROM documents",
}
