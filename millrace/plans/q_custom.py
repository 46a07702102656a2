"""Operators beyond SQL expressions, and the batch twins of the stream monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.udfs import code_problem_udf, first_object_udf, repaired_udf, rouge_l_udf, similarity_udf, xml_call_udf
from millrace.operators.projection import PROMPT, thinker_view
from millrace.plans.fixtures import TRAJECTORIES, documents, trajectories
from millrace.streaming.monitors import Limits, dependency_batch


def f5_p19_code(spark: SparkSession, d: str) -> DataFrame:
    """Safety of code, and repair of code that was escaped twice."""
    code = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('import math\\\\nprint(', doc_id, ')') WHEN 1 THEN 'import os' WHEN 2 THEN concat('eval(', doc_id, ')') WHEN 3 THEN concat('x = ', doc_id, ' +') ELSE concat('print(', doc_id, ')') END")
    rows = documents(spark, d).select("doc_id", code.alias("code"))
    return rows.select("doc_id", code_problem_udf("code").alias("problem"), code_problem_udf(repaired_udf("code")).alias("after_repair"))


def p12_p21_parsers(spark: SparkSession, d: str) -> DataFrame:
    """XML calls with all forms of arguments, and objects within noise."""
    call = F.concat(F.lit('web_search(query="'), F.replace("source", F.lit('"'), F.lit("")), F.lit('", n='), F.col("doc_id").cast("string"), F.lit(")"))
    noisy = F.concat(F.lit("Sure: ```json\n{\"id\": "), F.col("doc_id").cast("string"), F.lit(", \"t\": {\"a\": \"}\"}}\n``` "), "text")
    rows = documents(spark, d).select("doc_id", xml_call_udf(call).alias("c"), first_object_udf(noisy).alias("o"))
    return rows.select("doc_id", "c.name", "c.arguments", "o.found", F.length("o.rest").cast("long").alias("rest_chars"))


def m4_t16_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Longest-common-subsequence ROUGE of benchmark items against the next, and of code against its copy."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.round(rouge_l_udf("text", "other"), 6).alias("rouge_l"), F.round(similarity_udf("text", "other"), 6).alias("ratio"))


def x19_thinker(spark: SparkSession, d: str) -> DataFrame:
    """The thinker's view of every trajectory that passes its gates."""
    return thinker_view(trajectories(spark, d))


def g1_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Disclosures per session, with limits that the events reach."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return dependency_batch(e, Limits(per_hour=3, gap=600.0, bursts=2))


#: Bodies of calls: raw line breaks and tabs, arguments as a string, no JSON, another call behind, missing arguments.
CALLS = """CASE doc_id % 5
 WHEN 0 THEN concat('<tool_call>{"name": "python_execute", "arguments": {"code": "a = ', doc_id, chr(10), chr(9), 'print(a)"}}</tool_call>')
 WHEN 1 THEN concat('<tool_call> {"name": "python_execute", "arguments": "{', chr(92), '"code', chr(92), '": ', chr(92), '"b = ', doc_id, chr(92), '"}"} </tool_call>')
 WHEN 2 THEN concat('<tool_call>{"name": python}</tool_call>', source)
 WHEN 3 THEN concat(source, '<tool_call>{"name": "', source, '", "arguments": {"code": "x"}}</tool_call><tool_call>{"name": "other"}</tool_call>')
 ELSE '<tool_call>{"name": "get_datetime"}</tool_call>' END"""


def p15_lax_calls(spark: SparkSession, d: str) -> DataFrame:
    """The first native call: its name, and its code with the line breaks that its JSON has raw."""
    body = F.get(T.call_bodies(F.expr(CALLS)), F.lit(0))
    return documents(spark, d).select("doc_id", T.call_name(body).alias("name"), T.call_argument(body, "code").alias("code"))


QUERIES = {f.__name__: f for f in (f5_p19_code, p12_p21_parsers, m4_t16_similarity, x19_thinker, g1_dependency, p15_lax_calls)}


def _tag(tag: str, text: str = "content") -> str:
    return rf"regexp_replace(regexp_extract({text}, '(?is)<{tag}>(.*?)</{tag}>', 1), '^\s+|\s+$', '', 'g')"


def _gist(printed: str, result: str) -> str:
    trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    lines = f"list_filter(list_transform(string_split(coalesce({result}, ''), chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"
    bare = r"trim(regexp_replace(replace(x, '*', ''), '\s*\(https?://.*$', ''), ' *[]#–-')"
    first = f"coalesce(list_filter(list_transform({lines}, lambda x: {bare}), lambda x: length(x) > 8)[1], {trim(result)}, '')"
    line = rf"regexp_replace({trim(f'CASE WHEN {printed} THEN coalesce({lines}[-1], $$$$) ELSE {first} END')}, '\s+', ' ', 'g')"
    return rf"CASE WHEN length({line}) > 80 THEN regexp_replace(left({line}, 80), ' [^ ]*$', '') ELSE {line} END"


_X19 = rf"""WITH {TRAJECTORIES},
 m AS (SELECT conv_id, pos, role, content, lead(role) OVER o AS next_role, lead(content) OVER o AS next_text,
         replace(regexp_extract(content, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), chr(10), '\n') AS body FROM trajectories WINDOW o AS (PARTITION BY conv_id ORDER BY pos, role)),
 j AS (SELECT *, CASE WHEN role = 'assistant' AND body <> '' THEN json_extract_string(body, '$.name') END AS tool,
         CASE WHEN body <> '' THEN json_extract_string(body, '$.arguments') END AS args, {_tag('think')} AS thought,
         CASE WHEN regexp_matches(content, '(?is)<answer>.*?</answer>') THEN {_tag('answer')} END AS answer FROM m),
 a AS (SELECT *, CASE tool WHEN 'web_search' THEN nullif('Use web_search to find: ' || trim(json_extract_string(args, '$.query')), 'Use web_search to find: ')
           WHEN 'python_execute' THEN 'Use python_execute to run this code:' || chr(10) || json_extract_string(args, '$.code')
           WHEN 'read_url' THEN 'Use read_url to fetch ' || json_extract_string(args, '$.url') || ' and extract: ' || json_extract_string(args, '$.prompt') END AS told,
         CASE WHEN tool IS NOT NULL AND next_role = 'tool' THEN CASE WHEN contains(next_text, '[TOOL_RESULT: ') THEN regexp_extract(next_text, '(?s)\[TOOL_RESULT: [^\]]*\]\s*(.*?)\s*\[/TOOL_RESULT\]', 1)
           ELSE regexp_replace(next_text, '^\s+|\s+$', '', 'g') END END AS result FROM j),
 k AS (SELECT *, CASE WHEN role <> 'assistant' THEN NULL WHEN told IS NOT NULL THEN 'act' WHEN tool IN ('web_search', 'python_execute', 'read_url') THEN 'kept' WHEN answer IS NOT NULL THEN 'answer' ELSE 'kept' END AS kind FROM a),
 n AS (SELECT *, count(*) FILTER (kind IN ('act', 'answer')) OVER (PARTITION BY conv_id ORDER BY pos, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM k),
 e AS (SELECT * FROM n WHERE kind IN ('act', 'answer')),
 r AS (SELECT e.conv_id, e.turn, string_agg(n.thought, chr(10) || chr(10) ORDER BY n.pos) FILTER (n.role = 'assistant' AND n.thought <> '') AS reasoning FROM e JOIN n ON n.conv_id = e.conv_id AND n.turn = e.turn AND n.pos <= e.pos GROUP BY ALL),
 s AS (SELECT e.*, coalesce(r.reasoning, '') AS reasoning, (SELECT max_by(p.result, p.pos) FROM e p WHERE p.conv_id = e.conv_id AND p.pos < e.pos AND p.kind = 'act' AND p.result IS NOT NULL) AS seen,
         (SELECT max_by(p.tool, p.pos) FROM e p WHERE p.conv_id = e.conv_id AND p.pos < e.pos AND p.kind = 'act') AS seen_of FROM e JOIN r USING (conv_id, turn)),
 g AS (SELECT *, turn > 0 AND reasoning = '' AS made_up, {_gist("kind = 'answer' AND seen_of = 'python_execute'", "seen")} AS quoted FROM s),
 t AS (SELECT *, CASE WHEN NOT made_up THEN reasoning WHEN kind = 'act' THEN CASE WHEN quoted <> '' THEN concat('So far: ', quoted, '. ') ELSE '' END || concat('Next I need to ', lower(trim(string_split(told, ':')[1])), '; step ', turn, '.')
         ELSE concat('The ', CASE seen_of WHEN 'web_search' THEN 'search' WHEN 'python_execute' THEN 'computation' WHEN 'read_url' THEN 'page' ELSE 'step' END, ' gave ', CASE WHEN quoted <> '' THEN quoted ELSE 'what was needed' END, '; I can answer now.') END AS said_thought FROM g),
 u AS (SELECT *, CASE WHEN said_thought <> '' THEN concat('<think>', chr(10), said_thought, chr(10), '</think>', chr(10)) ELSE '' END || CASE kind WHEN 'act' THEN concat('<act>', told, '</act>') ELSE concat('<answer>', answer, '</answer>') END AS said FROM t),
 shown AS (SELECT conv_id, pos, 1 AS part, 'assistant' AS role, said AS content FROM u
   UNION ALL SELECT conv_id, pos, 2, 'tool', concat('[TOOL_RESULT: ', tool, ']', chr(10), regexp_replace(result, '{T.INJECTION}', '[FILTERED]', 'g'), chr(10), '[/TOOL_RESULT]') FROM u WHERE kind = 'act' AND result IS NOT NULL
   UNION ALL SELECT conv_id, pos, 0, 'user', content FROM n WHERE role = 'user'),
 ok AS (SELECT conv_id, max_by(role, pos * 3 + part) = 'assistant' AND contains(max_by(content, pos * 3 + part), '<answer>') AND bool_or(part = 1 AND contains(content, '</answer>')) AND NOT bool_or(role = 'assistant' AND (contains(content, '<tool>') OR regexp_matches(content, '(?s)<tool_call>.*</tool_call>'))) AS fine,
          min(pos) FILTER (part = 0) AS first_user FROM shown GROUP BY 1),
 v AS (SELECT conv_id, bool_or(kind = 'act') AS has_act, count(*) FILTER (made_up)::INT AS synth_think, max(length(reasoning)) FILTER (turn = 0) AS opening FROM u GROUP BY 1),
 y AS (SELECT conv_id, max_by(result, pos) AS memory FROM n WHERE kind = 'kept' AND tool = 'user_memory_read' AND result <> '' AND NOT contains(lower(result), 'not available') GROUP BY 1),
 every AS (SELECT conv_id, pos, part, role, CASE WHEN part = 0 AND pos = first_user THEN concat('[USER MEMORY]', chr(10), coalesce(memory, '(no profile stored)'), chr(10), '[/USER MEMORY]', chr(10), chr(10), content) ELSE content END AS content, has_act, synth_think
   FROM shown JOIN ok USING (conv_id) JOIN v USING (conv_id) LEFT JOIN y USING (conv_id) WHERE fine AND opening >= 150
   UNION ALL SELECT conv_id, -1, 0, 'system', '{PROMPT}', has_act, synth_think FROM ok JOIN v USING (conv_id) WHERE fine AND opening >= 150)
 SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos, part) - 1)::INT AS pos, role, content, has_act, synth_think FROM every"""

SQL: dict[str, str] = {
    "x19_thinker": _X19.replace("$$$$", "''"),
    "p15_lax_calls": rf"""WITH c AS (SELECT doc_id, replace(replace(regexp_extract({CALLS}, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), chr(10), '\n'), chr(9), '\t') AS body FROM documents),
        a AS (SELECT doc_id, CASE WHEN json_valid(body) THEN body END AS body FROM c)
        SELECT doc_id, json_extract_string(body, '$.name') AS name, json_extract_string(json_extract_string(body, '$.arguments'), '$.code') AS code FROM a""",
}
