"""JSON and JSON-lines sources with declared schemas, discovery of reports, and sinks.

Schemas are declared, never inferred: several fields are unions (text or list, object or text), which read as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAJECTORY = "messages ARRAY<STRUCT<role STRING, content STRING, name STRING, tool_call_id STRING>>, metadata STRUCT<category STRING, question_type STRING, source STRING, question_id STRING, tool_profile STRING>"
REPORT = """run_metadata STRUCT<timestamp STRING, model_label STRING>, constitution_score DOUBLE, scores_by_principle MAP<STRING, DOUBLE>,
 probe_results ARRAY<STRUCT<id STRING, principle STRING, rule_score DOUBLE, llm_score DOUBLE,
  question_results ARRAY<STRUCT<question_idx INT, question STRING, tool_profile STRING, response STRING, rule_passed BOOLEAN, rule_score DOUBLE, llm_score DOUBLE>>>>"""


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, limit: int | None = None) -> DataFrame:
    """One object per line, blank lines skipped. Lines that are no JSON raise if strict, else they keep their text in _corrupt."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt STRING").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows if limit is None else rows.limit(limit)


def corrupt_count(rows: DataFrame) -> DataFrame:
    """n, n_corrupt of rows read by read_lines."""
    return rows.agg(F.count("*").alias("n"), F.count("_corrupt").alias("n_corrupt"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per file, with the file's path and time of change."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))


#: File names of reports: suite, an optional label and a stamp.
NAME = r"(constitution|category|drift|adversarial|persona)_report(?:_(.*?))?_(\d{8}_\d{6})\.json$"


def suite_of(name: Column) -> Column:
    return F.regexp_extract(name, NAME, 1)


def discovered(files: DataFrame, skip: str | None = "_rescored|_alignment", newest_by: str = "name") -> DataFrame:
    """files (path, changed) to label, suite, path: the latest report of each. A label folder wins over a label in the name.

    skip: paths that are left out, as a regular expression, or None. newest_by: "name" (its stamp) or "changed".
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    rows = (files.filter(~F.col("path").rlike(skip)) if skip else files).select("path", "changed", name.alias("name"), folder.alias("folder")).withColumn("suite", suite_of(F.col("name"))).filter("suite <> ''")
    inner = F.regexp_extract("name", NAME, 2)
    rows = rows.withColumn("label", F.when(inner != "", inner).otherwise(F.col("folder"))).withColumn("in_folder", (inner == "").cast("int")).withColumn("stamp", F.regexp_extract("name", NAME, 3))
    newest = F.struct("in_folder", "stamp", "name", "path") if newest_by == "name" else F.struct("changed", "path")
    return rows.groupBy("label", "suite").agg(F.max_by("path", newest).alias("path"))


def siblings(files: DataFrame) -> DataFrame:
    """Pairs of reports with one time stamp."""
    stamped = files.withColumn("stamp", F.regexp_extract("path", r"(\d{8}_\d{6})", 1)).filter("stamp <> ''").select("path", "stamp")
    return stamped.join(stamped.withColumnRenamed("path", "other"), "stamp").filter("path < other")


def responses_of(reports: DataFrame) -> DataFrame:
    """One row per answered question of probe reports."""
    each = reports.select("path", F.col("run_metadata.model_label").alias("label"), F.explode("probe_results").alias("p")).select("path", "label", F.col("p.id").alias("group_id"), "p.principle", F.posexplode("p.question_results").alias("at", "q"))
    return each.select("path", "label", "group_id", "principle", F.coalesce("q.question_idx", "at").alias("question_idx"), "q.question", "q.tool_profile", "q.response", "q.rule_passed", "q.rule_score", "q.llm_score")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 as it is."""
    rows.write.option("ignoreNullFields", True).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row, nulls written out; the rows' nested columns are the report's shape."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Rows as CSV with a header, in order within ranges of it."""
    rows.sort(*order).write.option("header", True).csv(path)


def append_log(rows: DataFrame, path: str, keep: Column | None = None) -> None:
    """Adds rows (those of which keep is true, if given) to a log of JSON lines; files that are there stay as they are."""
    (rows if keep is None else rows.filter(F.coalesce(keep, F.lit(False)))).write.mode("append").json(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """The same for a stream: each micro-batch adds files once, also after a restart."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_csv_with_total(rows: DataFrame, path: str, by: str, value: str) -> None:
    """One row per group and an OVERALL row, as CSV with a header."""
    summed(rows, by, value).write.option("header", True).csv(path)


def summed(rows: DataFrame, by: str, value: str) -> DataFrame:
    total = rows.rollup(by).agg(F.grouping_id().alias("__all"), F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return total.select(F.when(F.col("__all") == 1, "OVERALL").otherwise(F.col(by)).alias(by), "n", "mean")


def quota(rows: DataFrame, by: str, most: int, order: str) -> DataFrame:
    """The first rows per group, by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("__n") <= most).drop("__n")
