"""Queries over keyed state: a harness's rolling rates, a server's counters, and results applied once.

Each stream has a batch twin with the same rows. A stream runs over what its table holds, from a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import q_scoring
from millrace.plans.fixtures import CATEGORY, PROFILE, RESPONSE, _spark
from millrace.session import shared_folder
from millrace.streaming import applied, harness

#: Flags of a harness's records, by document: asked again, mended by it, reset before it.
FLAGS = {"retried": "doc_id % 4 = 1", "cleared": "doc_id % 8 = 1", "reset": "doc_id % 97 = 0"}
#: A server's requests from events.
REQUEST = {"latency": "(event_id * 7919 % 5000) / 1000.0", "tokens": "event_id % 700", "ok": "event_id % 7 <> 0", "reset": "event_id % 301 = 0"}


def _harness_records(docs: DataFrame) -> DataFrame:
    """The responses' violations as a harness's records: the key is the document's source, the order its id."""
    r = docs.selectExpr("doc_id", "source AS key", f"{_spark(RESPONSE)} AS r", f"{CATEGORY} AS category", f"{PROFILE} AS profile")
    return r.select("key", F.col("doc_id").alias("request_id"), F.timestamp_seconds("doc_id").alias("at"), q_scoring.violations_of().alias("violations"), *[F.expr(e).alias(n) for n, e in FLAGS.items()])


def _request_records(events: DataFrame) -> DataFrame:
    tools = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("web_search"), F.lit(2), F.lit("read_url"), F.lit(1))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("python_execute"), F.lit(1)))
    return events.select(F.col("event_type").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), *[F.expr(e).cast({"latency": "double", "tokens": "long"}.get(n, "boolean")).alias(n) for n, e in REQUEST.items()], tools.alias("tools"))


def _stream(spark: SparkSession, path: str) -> DataFrame:
    # As a pattern: a stream's source takes a table that is one file only so.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    place = shared_folder(spark, name)
    harness.started(stream, f"{place}/rows", f"{place}/checkpoint", mode).awaitTermination()
    return harness.written(spark, stream.schema, f"{place}/rows")


def _shown_rates(rows: DataFrame) -> DataFrame:
    rates = [F.round(F.get("rates", F.lit(i)), 6).alias(f"rate_{p.lower()}") for i, p in enumerate(harness.PRINCIPLES)]
    adapts = harness.adapting(F.col("rates"))
    return rows.select("key", "request_id", "requests", "retries", "retry_success_rate", *rates, F.array_join(adapts, ",").alias("adapts"), F.length(harness.suffix(adapts)).cast("long").alias("suffix_chars"))


def g2_harness(spark: SparkSession, d: str) -> DataFrame:
    """Failure rates of a harness over each source's last 50 responses, retries, and the reminders that they call for."""
    return _shown_rates(harness.rates_batch(_harness_records(spark.read.parquet(f"{d}/documents.parquet"))))


def g2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with keyed state."""
    return _shown_rates(_run(harness.rates_stream(_harness_records(_stream(spark, f"{d}/documents.parquet"))), "rates"))


def _shown_requests(rows: DataFrame) -> DataFrame:
    tools = F.array_join(F.transform(F.array_sort(F.map_entries("tools")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return rows.select("key", "total", "ok", "error", "p50", "p95", "p99", "tokens", "tokens_per_request", tools.alias("tools"))


def g4_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A server's metrics since its last reset, by kind of event."""
    return _shown_requests(harness.requests_batch(_request_records(spark.read.parquet(f"{d}/events.parquet"))))


def g4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with keyed state: each key's last metrics."""
    rows = _run(harness.requests_stream(_request_records(_stream(spark, f"{d}/events.parquet"))), "requests", "update")
    return _shown_requests(harness.latest(rows, "key"))


def g10_applied(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of every document, applied once each by a stream that can be stopped and started again; those that fail say so."""
    place = shared_folder(spark, "applied")
    docs = _stream(spark, f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("item_id"), "n_chars", "lang")
    failed = F.col("n_chars") % 11 == 0
    judge = lambda rows: rows.select("item_id", F.when(~failed, F.col("n_chars") % 10 / 10).alias("score"), F.when(failed, "no verdict").alias("error"))
    applied.started(docs, judge, f"{place}/results", f"{place}/checkpoint").awaitTermination()
    return applied.results(spark, f"{place}/results").select("item_id", "score", "passed", "reason", "judge_failed")


QUERIES = {f.__name__: f for f in (g2_harness, g2_stream, g4_metrics, g4_stream, g10_applied)}

_BITS = ", ".join(f"list_contains(vs, '{p}')::INT AS f{i}" for i, p in enumerate(harness.PRINCIPLES))
_RATES = ", ".join(f"avg(f{i}) OVER last AS v{i}" for i in range(len(harness.PRINCIPLES)))
_WEAK = ", ".join(f"CASE WHEN v{i} >= {harness.THRESHOLD} THEN '{p}' END" for i, p in enumerate(harness.PRINCIPLES))
_LENGTH = "CASE p " + " ".join(f"WHEN '{p}' THEN {len(t)}" for p, t in harness.REMINDERS.items()) + f" ELSE length(p) + {len('**: Review the constitution.**')} END"
_G2 = f"""WITH broken AS ({q_scoring.SQL["f10_harness"]}),
    records AS (SELECT source AS key, doc_id, string_split(violations, ',') AS vs, {", ".join(f"{e} AS {n}" for n, e in FLAGS.items())} FROM broken JOIN documents USING (doc_id)),
    epochs AS (SELECT *, sum(reset::INT) OVER (PARTITION BY key ORDER BY doc_id) AS epoch, {_BITS} FROM records),
    rated AS (SELECT key, doc_id, row_number() OVER own AS requests, sum(retried::INT) OVER own AS retries, sum(cleared::INT) OVER own AS mended, {_RATES} FROM epochs WHERE NOT reset
        WINDOW own AS (PARTITION BY key, epoch ORDER BY doc_id), last AS (PARTITION BY key, epoch ORDER BY doc_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    weak AS (SELECT *, list_filter([{_WEAK}], lambda p: p IS NOT NULL) AS ps FROM rated)
    SELECT key, doc_id AS request_id, requests, retries::BIGINT AS retries, round(mended / nullif(retries, 0), 3) AS retry_success_rate, {", ".join(f"round(v{i}, 6) AS rate_{p.lower()}" for i, p in enumerate(harness.PRINCIPLES))},
        array_to_string(ps, ',') AS adapts, CASE WHEN len(ps) = 0 THEN 0 ELSE {len(harness.REMINDERS_HEAD) + 1} + list_sum(list_transform(ps, lambda p: 1 + {_LENGTH})) END::BIGINT AS suffix_chars FROM weak"""
_AT = ", ".join(f"coalesce(list_sort(list(ms) FILTER (ok))[greatest(1, least(count(*) FILTER (ok) * {p} // 100 + 1, count(*) FILTER (ok)))] / 1000.0, 0)::DOUBLE AS p{p}" for p in harness.PERCENTILES)
_G4 = f"""WITH r AS (SELECT event_type AS key, ts, event_id, {", ".join(f"{e} AS {n}" for n, e in REQUEST.items())},
        CASE event_id % 3 WHEN 0 THEN [('web_search', 2), ('read_url', 1)] WHEN 1 THEN [('python_execute', 1)] ELSE [] END AS tools FROM events),
    ends AS (SELECT key, max(struct_pack(ts := ts, id := event_id)) FILTER (reset) AS since FROM r GROUP BY key),
    live AS (SELECT r.*, round(latency * 1000)::BIGINT AS ms FROM r JOIN ends USING (key) WHERE NOT reset AND (since IS NULL OR struct_pack(ts := ts, id := event_id) > since)),
    sums AS (SELECT key, count(*) AS total, count(*) FILTER (ok) AS ok, {_AT}, coalesce(sum(tokens) FILTER (ok), 0)::BIGINT AS tokens FROM live GROUP BY key),
    calls AS (SELECT key, t[1] AS tool, sum(t[2]) AS n FROM (SELECT key, unnest(tools) AS t FROM live WHERE ok) GROUP BY ALL),
    said AS (SELECT key, string_agg(concat(tool, ':', n::BIGINT), ',' ORDER BY tool) AS tools FROM calls GROUP BY key)
    SELECT key, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, coalesce(total - ok, 0) AS error, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99, coalesce(tokens, 0) AS tokens,
        coalesce(round(tokens / nullif(ok, 0), 1), 0)::DOUBLE AS tokens_per_request, coalesce(tools, '') AS tools FROM ends LEFT JOIN sums USING (key) LEFT JOIN said USING (key)"""
SQL = {
    "g2_harness": _G2,
    "g2_stream": _G2,
    "g4_metrics": _G4,
    "g4_stream": _G4,
    "g10_applied": """SELECT doc_id::VARCHAR AS item_id, CASE WHEN n_chars % 11 <> 0 THEN n_chars % 10 / 10.0 END::DOUBLE AS score, coalesce(n_chars % 11 <> 0 AND n_chars % 10 / 10.0 >= 0.5, false) AS passed,
        CASE WHEN n_chars % 11 = 0 THEN 'judge_error: no verdict' ELSE '' END AS reason, n_chars % 11 = 0 AS judge_failed FROM documents""",
}
