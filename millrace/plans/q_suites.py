"""Queries over reports of five suites in JSON, and their SQL over the same fields laid flat.

A label's reports hold sixty documents, twelve items a suite; what an item says follows from its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import principles as P
from millrace.operators import suites as R
from millrace.operators.reports import tools_line
from millrace.plans.fixtures import documents

#: Fields of an item, in SQL that both engines read alike: k counts the items of a suite.
ITEM = {
    "label": "concat('m', CAST(floor(doc_id / 60) AS BIGINT))",
    "suite": "CASE doc_id % 5 WHEN 0 THEN 'constitution' WHEN 1 THEN 'categories' WHEN 2 THEN 'drift' WHEN 3 THEN 'adversarial' ELSE 'persona' END",
    "pid": "CASE k % 24 " + " ".join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(P.PRINCIPLES)) + " ELSE 'P99_other' END",
    "idx": "CASE WHEN k % 13 <> 0 THEN k % 4 END",
    "think_length": "CASE WHEN k % 8 <> 3 THEN n_chars % 300 END",
    "think_empty": "CASE WHEN k % 7 = 0 THEN true WHEN k % 7 = 1 THEN false END",
    "answer": "CASE WHEN k % 6 > 2 THEN concat(' ', source, ' ') WHEN k % 6 = 1 THEN '' END",
    "response": "CASE WHEN k % 4 <> 0 THEN concat(source, '!') END",
    "response_type": "CASE WHEN k % 9 = 0 THEN 'ask' ELSE 'answer' END",
    "ask_content": "CASE WHEN k % 10 = 0 THEN ' why? ' WHEN k % 10 = 1 THEN '  ' END",
    "latency": "n_chars / 1000.0",
    "tokens": "CASE WHEN k % 3 > 0 THEN n_chars % 900 END",
    "profile": "CASE WHEN k % 3 = 0 THEN 'no_tools' ELSE 'all_tools' END",
    "passed": "k % 2 = 0",
    "rule": "CASE WHEN k % 11 > 0 THEN n_chars % 11 / 10.0 END",
    "combined": "CASE WHEN k % 5 <> 2 THEN n_chars % 7 / 10.0 END",
    "judged": "CASE WHEN k % 3 = 1 THEN n_chars % 9 / 10.0 END",
    "overall": "CASE WHEN k % 4 <> 3 THEN n_chars % 13 / 13.0 END",
}
#: An answer of several turns, the tools called, those that failed, and broken principles, as JSON.
TURNS = """concat('[{"role": "assistant", "content": "', lang, '"}, "tail"]')"""
TOOLS = """CASE k % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["web_search", "teleport"]' WHEN 2 THEN '["python_execute"]' WHEN 4 THEN '["read_url", "read_url", "x"]' ELSE 'null' END"""
FAILED = """CASE k % 5 WHEN 1 THEN '{"web_search": 2}' WHEN 4 THEN '{"read_url": "timeout", "x": 1}' ELSE '{}' END"""
BROKEN = """CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["P1"]' WHEN 2 THEN '["P1", "P3"]' ELSE '["P1", "P3", {"code": 4}]' END"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumn("k", F.expr("CAST(floor(doc_id / 5) AS BIGINT)"))
    return docs.select("doc_id", "k", "n_chars", "source", "lang", *[F.expr(e).alias(n) for n, e in ITEM.items()])


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """label, suite and report: the items put into their suites' nested JSON."""
    x = _items(spark, d)
    answer = F.when(F.col("k") % 6 == 0, F.expr(TURNS)).otherwise(F.regexp_extract(F.to_json(F.struct(F.coalesce("answer", F.lit("\0")).alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1))
    answer = F.when((F.col("k") % 6 == 0) | F.col("answer").isNotNull(), answer).otherwise("null")
    question = F.when(F.col("k") % 3 == 2, F.concat(F.lit('["q", "'), F.col("doc_id").cast("string"), F.lit('"]'))).otherwise(F.concat(F.lit('"q'), F.col("doc_id").cast("string"), F.lit('"')))
    plain = F.to_json(F.struct(F.col("idx").alias("question_idx"), F.col("doc_id").alias("turn"), "think_length", "think_empty", "response", "response_type", "ask_content", F.lit("thought").alias("think_content"), (F.col("k") % 3).alias("harness_retries"), F.col("profile").alias("tool_profile"), F.col("passed").alias("rule_passed"), F.col("rule").alias("rule_score"), F.col("combined").alias("combined_score"), F.col("judged").alias("llm_score"), F.when(F.col("judged").isNotNull(), "because").alias("llm_reason")))
    metrics = F.concat(F.lit('{"latency_s": '), F.col("latency").cast("double").cast("string"), F.lit(', "tokens_generated": '), F.coalesce(F.col("tokens").cast("string"), F.lit("null")), F.lit(', "tool_failures": '), F.expr(FAILED), F.lit("}"))
    item = F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(', "answer_content": '), answer, F.lit(', "question": '), question, F.lit(', "tools_called": '), F.expr(TOOLS), F.lit(', "harness_violations": '), F.expr(BROKEN), F.lit(', "metrics": '), metrics, F.lit("}"))
    group = lambda name, of: F.concat(F.lit(f'{{"{name}": "'), of, F.lit('", "question_results": ['), F.col("item"), F.lit("]}"))
    attack = F.to_json(F.struct(F.when(F.col("k") % 6 > 0, F.concat(F.lit("adv"), F.col("doc_id").cast("string"))).alias("id"), "passed", F.col("source").alias("question"), F.when(F.col("k") % 5 == 0, 0.25).alias("score")))
    talk = F.to_json(F.struct(F.concat(F.lit("per"), F.col("doc_id").cast("string")).alias("persona_id"), F.col("lang").alias("profile"), F.col("source").alias("goal"), F.lit("said").alias("transcript"), F.struct("overall", F.lit("fine").alias("summary"), F.when(F.col("k") % 9 == 0, True).alias("judge_failed"), F.struct(F.struct(F.col("overall").alias("score")).alias("warmth"), F.when(F.col("k") % 3 > 0, F.struct((F.col("n_chars") % 5 / 5).alias("score"))).alias("depth")).alias("dimensions")).alias("judge")))
    x = x.withColumn("plain", plain).withColumn("item", item)
    x = x.withColumn("entry", F.when(F.col("suite") == "constitution", group("id", F.col("pid"))).when(F.col("suite") == "categories", group("category", F.col("lang"))).when(F.col("suite") == "drift", F.col("item")).when(F.col("suite") == "adversarial", attack).otherwise(talk))
    array = F.when(F.col("suite") == "categories", "category_results").when(F.col("suite") == "drift", "turn_results").when(F.col("suite") == "persona", "persona_results").otherwise("probe_results")
    name = F.when(F.col("suite") == "categories", "category_score").when(F.col("suite") == "drift", "drift_score").when(F.col("suite") == "persona", "persona_score").when(F.col("suite") == "adversarial", "adversarial_score").otherwise("constitution_score")
    # A report is one JSON document; it has the twelve items of its label and suite.
    rows = x.groupBy("label", "suite").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("entries"), F.round(F.avg("combined"), 4).alias("score"), F.min(F.when(F.col("rule") < 0.3, F.col("doc_id"))).alias("drifted"), F.collect_list(F.when(F.col("rule").isNotNull(), F.concat(F.lit('"'), "pid", F.lit('": '), F.col("rule").cast("double").cast("string")))).alias("scores"), F.round(F.avg("overall"), 4).alias("warmth"))
    body = F.concat(F.lit('{"'), array, F.lit('": ['), F.array_join(F.transform("entries", lambda e: e["entry"]), ", "), F.lit('], "run_metadata": {"model_label": "'), F.col("label"), F.lit('"}, "'), name, F.lit('": '), F.coalesce(F.col("score").cast("string"), F.lit("null")), F.lit(', "first_drift_at": '), F.coalesce(F.col("drifted").cast("string"), F.lit("null")), F.lit(', "scores_by_principle": {'), F.array_join("scores", ", "), F.lit('}, "dimension_means": {"warmth": '), F.coalesce(F.col("warmth").cast("string"), F.lit("null")), F.lit("}}"))
    return R.parsed(rows.select("label", "suite", body.alias("json")))


def a2_records(spark: SparkSession, d: str) -> DataFrame:
    """Every answer of probe, category and drift reports with its twenty signals."""
    r = R.records(_reports(spark, d))
    return r.withColumns({"tools": F.array_join("tools", ","), "ext_ratio": F.round("ext_ratio", 6), "latency_s": F.round("latency_s", 6), "rule_score": F.round("rule_score", 6), "combined_score": F.round("combined_score", 6)})


def a6_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The eight vectors by which conditions are compared."""
    return R.vectors(_reports(spark, d)).withColumn("value", F.round("value", 6))


def e1_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every item of the five suites as a cell, under the key that it has in all conditions."""
    return R.cells(_reports(spark, d)).withColumns({"tools": F.array_join("tools", ","), "score": F.round("score", 6)})


def e6_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of each condition that need no judge."""
    return R.bundle(_reports(spark, d)).withColumn("value", F.round("value", 6))


def e24_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of four suites that a report is written from."""
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 4))), ",")
    r = R.summary(_reports(spark, d))
    return r.withColumns({"scores_by_principle": shown("scores_by_principle"), "persona_dimension_means": shown("persona_dimension_means")})


def e22_context(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is told of every item: what is probed, its gold reference, and the tools that were meant to be there."""
    rubrics = P.dimension(spark).filter("tier < 3").select(F.col("principle").alias("group_id"), F.concat(F.lit("be "), "family").alias("rubric"))
    golds = spark.read.parquet(f"{d}/benchmark.parquet").filter(F.col("item_id") < 4 * len(P.PRINCIPLES)).select(F.element_at(F.array(*[F.lit(p[0]) for p in P.PRINCIPLES]), (F.floor(F.col("item_id") / 4) + 1).cast("int")).alias("group_id"), (F.col("item_id") % 4).cast("string").alias("idx"), F.left("text", F.lit(30)).alias("expected"))
    rows = R.judge_context(R.cells(_reports(spark, d)), rubrics, golds)
    return rows.select("suite", "key", "context", tools_line(F.col("profile")).alias("tools"))


QUERIES = {f.__name__: f for f in (a2_records, a6_vectors, e1_cells, e6_bundle, e24_summary, e22_context)}

_X = f"""d AS (SELECT *, CAST(floor(doc_id / 5) AS BIGINT) AS k FROM documents), x AS (SELECT doc_id, k, n_chars, source, lang, {", ".join(f"{e} AS {n}" for n, e in ITEM.items())} FROM d),
    y AS (SELECT *, CASE WHEN k % 6 = 0 THEN lang || ' tail' WHEN coalesce(answer, '') <> '' THEN answer ELSE coalesce(response, '') END AS said, coalesce(think_length, 0) AS think_len,
        CASE k % 5 WHEN 1 THEN ['web_search', 'teleport'] WHEN 2 THEN ['python_execute'] WHEN 4 THEN ['read_url', 'read_url', 'x'] ELSE [] END AS tools FROM x)"""
_REC = f"""{_X}, z AS (SELECT *, length(trim(said)) AS answer_chars FROM y WHERE suite IN ('constitution', 'categories', 'drift')),
    records AS (SELECT label, suite, CASE suite WHEN 'constitution' THEN concat(pid, '::', coalesce(idx::VARCHAR, 'None')) WHEN 'categories' THEN concat('cat::', lang, '::', coalesce(idx::VARCHAR, 'None')) ELSE concat('drift::', doc_id) END AS key,
        CASE suite WHEN 'constitution' THEN pid WHEN 'categories' THEN 'cat::' || lang ELSE 'drift' END AS principle, think_len::INT AS think_len, coalesce(think_empty, think_len = 0) AS think_empty, answer_chars::INT AS answer_chars, round(think_len / nullif(think_len + answer_chars, 0), 6) AS ext_ratio,
        response_type = 'ask' OR trim(coalesce(ask_content, '')) <> '' AS is_ask, tools, len(tools)::INT AS n_tools, len(list_filter(tools, lambda t: t IN ('teleport', 'x')))::INT AS n_decoy, CASE k % 5 WHEN 1 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS n_tool_fail,
        (k % 3)::INT AS retries, (k % 4)::INT AS violations, round(latency, 6)::DOUBLE AS latency_s, tokens::DOUBLE AS tokens_gen, profile AS tool_profile, passed AS rule_passed, round(rule, 6)::DOUBLE AS rule_score, round(combined, 6)::DOUBLE AS combined_score, doc_id FROM z)"""
_DIM = ", ".join(f"('{n}', '{f}', '{g}', {t}, {P.WEIGHTS[t]})" for n, f, g, t in P.PRINCIPLES)
_DEPTH = "avg(think_len) AS think_len_mean, median(think_len) AS think_len_median, avg(think_empty::INT) AS think_empty_rate, avg(answer_chars) AS answer_chars_mean, avg(think_len / nullif(think_len + answer_chars, 0)) AS ext_ratio_mean, avg(is_ask::INT) AS clarification_rate, avg((rule_passed AND answer_chars = 0)::INT) AS hollow_pass_rate, count(*)::DOUBLE AS n_responses"
_TOOL = "avg(n_tools) AS tool_calls_per_resp, sum(n_tools)::DOUBLE AS tool_calls_total, coalesce(sum(n_tool_fail) / nullif(sum(n_tools), 0), 0)::DOUBLE AS tool_fail_rate, avg((n_decoy > 0)::INT) AS decoy_bait_rate, sum(n_decoy)::DOUBLE AS decoy_calls_total, avg((n_tools > 0)::INT) FILTER (tool_profile = 'no_tools') AS unnecessary_tool_rate"
_COST = "avg(latency_s) AS latency_s_mean, avg(tokens_gen)::DOUBLE AS tokens_gen_mean"
SQL = {
    "a2_records": f"WITH {_REC} SELECT * EXCLUDE (doc_id) REPLACE (array_to_string(tools, ',') AS tools) FROM records",
    "a6_vectors": f"""WITH {_REC}, c AS (SELECT * FROM records WHERE suite = 'constitution')
        SELECT label, 'think_len' AS vector, key, think_len::DOUBLE AS value FROM c UNION ALL SELECT label, 'ext_ratio', key, ext_ratio FROM c WHERE ext_ratio IS NOT NULL UNION ALL SELECT label, 'clarification', key, is_ask::INT FROM c
        UNION ALL SELECT label, 'hollow', key, (rule_passed AND answer_chars = 0)::INT FROM c UNION ALL SELECT label, 'rule', key, rule_passed::INT FROM c UNION ALL SELECT label, 'combined', key, combined_score FROM c WHERE combined_score IS NOT NULL
        UNION ALL SELECT label, 'adversarial', CASE WHEN k % 6 > 0 THEN concat('adv', doc_id) ELSE (row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1)::VARCHAR END, passed::INT FROM x WHERE suite = 'adversarial'
        UNION ALL SELECT label, 'persona', concat('per', doc_id), round(overall, 6) FROM x WHERE suite = 'persona' AND overall IS NOT NULL""",
    "e1_cells": f"""WITH {_X} SELECT label, suite, CASE suite WHEN 'constitution' THEN concat(pid, '::', coalesce(idx::VARCHAR, 'None')) WHEN 'categories' THEN concat(lang, '::', coalesce(idx::VARCHAR, 'None')) WHEN 'drift' THEN concat('turn', doc_id) WHEN 'adversarial' THEN CASE WHEN k % 6 > 0 THEN concat('adv', doc_id) ELSE '' END ELSE concat('per', doc_id) END AS key,
          CASE suite WHEN 'adversarial' THEN source WHEN 'persona' THEN concat(lang, ' — goal: ', source) ELSE CASE WHEN k % 3 = 2 THEN concat('q  |  ', doc_id) ELSE concat('q', doc_id) END END AS question,
          CASE WHEN suite IN ('adversarial', 'persona') THEN '' ELSE 'thought' END AS think, CASE WHEN suite IN ('adversarial', 'persona') THEN '' WHEN k % 6 = 0 THEN lang || ' tail' ELSE coalesce(answer, '') END AS answer,
          CASE suite WHEN 'adversarial' THEN '' WHEN 'persona' THEN 'said' ELSE coalesce(response, '') END AS response, CASE WHEN suite IN ('adversarial', 'persona') THEN '' ELSE array_to_string(tools, ',') END AS tools,
          CASE WHEN suite IN ('adversarial', 'persona') THEN '' ELSE response_type END AS response_type, CASE WHEN suite NOT IN ('adversarial', 'persona') THEN profile END AS tool_profile,
          round(CASE suite WHEN 'adversarial' THEN CASE WHEN k % 5 = 0 THEN 0.25 ELSE passed::INT END WHEN 'persona' THEN overall ELSE coalesce(combined, judged, passed::INT) END::DOUBLE, 6) AS score,
          CASE suite WHEN 'adversarial' THEN '' WHEN 'persona' THEN 'fine' ELSE CASE WHEN judged IS NOT NULL THEN 'because' ELSE '' END END AS judge_reason FROM y""",
    "e22_context": f"""WITH {_X}, i AS (SELECT label, suite, CASE suite WHEN 'constitution' THEN pid WHEN 'categories' THEN lang END AS gid, coalesce(idx::VARCHAR, 'None') AS idx,
          CASE suite WHEN 'constitution' THEN concat(pid, '::', coalesce(idx::VARCHAR, 'None')) WHEN 'categories' THEN concat(lang, '::', coalesce(idx::VARCHAR, 'None')) WHEN 'drift' THEN concat('turn', doc_id) WHEN 'adversarial' THEN CASE WHEN k % 6 > 0 THEN concat('adv', doc_id) ELSE '' END ELSE concat('per', doc_id) END AS key,
          CASE WHEN suite NOT IN ('adversarial', 'persona') THEN profile END AS profile FROM x),
        g AS (SELECT suite, key, any_value(gid) AS gid, any_value(idx) AS idx, arg_min(profile, struct_pack(l := label, p := profile)) FILTER (profile IS NOT NULL) AS profile FROM i GROUP BY suite, key),
        dim(principle, family, tier) AS (VALUES {", ".join(f"('{n}', '{f}', {t})" for n, f, _, t in P.PRINCIPLES)}), b AS (SELECT {[p[0] for p in P.PRINCIPLES]}[item_id // 4 + 1] AS gid, (item_id % 4)::VARCHAR AS idx, left(text, 30) AS expected FROM benchmark WHERE item_id < {4 * len(P.PRINCIPLES)}),
        c AS (SELECT g.*, CASE WHEN tier < 3 THEN 'be ' || family END AS rubric, 'Gold reference for THIS question: ' || expected AS gold FROM g LEFT JOIN dim ON principle = gid AND suite = 'constitution' LEFT JOIN b ON b.gid = g.gid AND b.idx = g.idx AND suite = 'constitution')
        SELECT suite, key, CASE suite WHEN 'constitution' THEN CASE WHEN rubric IS NULL AND gold IS NULL THEN 'Principle probed: ' || gid ELSE concat('[', gid, '] ', concat_ws(' ', rubric, gold)) END WHEN 'categories' THEN 'Category probed: ' || gid WHEN 'drift' THEN '{R.DRIFT}' WHEN 'persona' THEN '{R.PERSONA.replace(chr(39), chr(39) * 2)}' ELSE '' END AS context,
          CASE profile WHEN 'all_tools' THEN 'get_datetime, python_execute, read_url, web_search' WHEN 'no_tools' THEN 'none (knowledge/reasoning only — no external tools intended for this question)' ELSE 'unknown (a standard tool set may have been available)' END AS tools FROM c""",
    "e6_bundle": f"""WITH {_REC}, c AS (SELECT * FROM records WHERE suite = 'constitution'), dim(principle, family, framing, tier, weight) AS (VALUES {_DIM}),
        p AS (SELECT label, principle, avg(rule_score) AS score FROM c GROUP BY ALL HAVING score IS NOT NULL), j AS (SELECT p.*, family, coalesce(framing, 'unknown') AS framing, coalesce(tier, 3) AS tier, coalesce(weight, 1.0) AS weight FROM p LEFT JOIN dim USING (principle)),
        g AS (SELECT label, {_DEPTH}, {_TOOL}, {_COST} FROM c GROUP BY label), u AS (UNPIVOT g ON COLUMNS(* EXCLUDE (label)) INTO NAME name VALUE value),
        s AS (SELECT label, suite, round(avg(combined), 4) AS score, min(doc_id) FILTER (rule < 0.3) AS drifted FROM x WHERE suite IN ('categories', 'adversarial', 'drift') GROUP BY ALL)
        SELECT label, metric, name, round(value::DOUBLE, 6) AS value FROM (
          SELECT label, 'constitution' AS metric, 'overall_rule' AS name, avg(score) AS value FROM j GROUP BY label UNION ALL SELECT label, 'constitution', 'overall_weighted', sum(weight * score) / sum(weight) FROM j GROUP BY label
          UNION ALL SELECT label, 'principle', principle, score FROM j UNION ALL SELECT label, 'family', family, round(avg(score), 4) FROM j WHERE family IS NOT NULL GROUP BY label, family
          UNION ALL SELECT label, 'framing', framing, round(avg(score), 4) FROM j GROUP BY label, framing UNION ALL SELECT label, 'tier', tier::VARCHAR, round(avg(score), 4) FROM j GROUP BY label, tier
          UNION ALL SELECT label, CASE WHEN name IN ('latency_s_mean', 'tokens_gen_mean') THEN 'cost' WHEN name LIKE '%tool%' OR name LIKE 'decoy%' THEN 'tool' ELSE 'depth' END, name, value FROM u
          UNION ALL SELECT label, 'tool', 'distinct_tools', count(DISTINCT t) FROM (SELECT label, unnest(tools) AS t FROM c) GROUP BY label
          UNION ALL SELECT label, suite, 'overall', score FROM s UNION ALL SELECT label, 'drift', 'first_drift_at', drifted FROM s WHERE suite = 'drift') WHERE value IS NOT NULL""",
    "e24_summary": f"""WITH {_X}, s AS (SELECT label, suite, round(avg(combined), 4)::DOUBLE AS score, min(doc_id) FILTER (rule < 0.3)::INT AS drifted, round(avg(overall), 4) AS warmth,
          string_agg(concat(pid, '=', format('{{:.4f}}', rule)), ',' ORDER BY pid) FILTER (rule IS NOT NULL) AS scores FROM x GROUP BY ALL)
        SELECT label, max(score) FILTER (suite = 'constitution') AS constitution_score, CASE WHEN bool_or(suite = 'constitution') THEN coalesce(max(scores) FILTER (suite = 'constitution'), '') END AS scores_by_principle, max(score) FILTER (suite = 'categories') AS category_score, max(score) FILTER (suite = 'drift') AS drift_score,
          max(drifted) FILTER (suite = 'drift') AS first_drift_at, max(score) FILTER (suite = 'persona') AS persona_score, max(CASE WHEN warmth IS NOT NULL THEN concat('warmth=', format('{{:.4f}}', warmth)) END) FILTER (suite = 'persona') AS persona_dimension_means FROM s GROUP BY label""",
}
