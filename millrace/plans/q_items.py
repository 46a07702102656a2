"""Queries over report shapes, seeds, and what models and judges are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.functions import tools as G
from millrace.functions.hashing import digest
from millrace.operators import conversion as V
from millrace.operators import projection as P
from millrace.operators import reports as R
from millrace.plans.fixtures import RESPONSES_SQL, TRAJECTORIES, XML, documents, responses, trajectories, xml_turns
from millrace.plans.q_parse import STRIP, USER, body
from millrace.plans.q_sources import PATH

#: Answers as reports have them: suite, group, question and verdict follow from the id.
ANSWER = {
    "label": "source",
    "suite": "CASE doc_id % 3 WHEN 0 THEN 'constitution' WHEN 1 THEN 'categories' ELSE 'drift' END",
    "grp": "concat('P', doc_id % 9)",
    "judge_principle": "CASE WHEN doc_id % 4 = 0 THEN lang END",
    "question_idx": "CAST(doc_id % 5 AS INT)",
    "question": "concat('q', doc_id)",
    "response": "r",
    "rule_passed": "doc_id % 2 = 0",
}


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in ANSWER.items()])


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """One row per label and suite, with the nested arrays that its reports have."""
    a = _answers(spark, d)
    q = F.collect_list(F.struct("question", "response", "judge_principle", "question_idx", "rule_passed"))
    groups = a.filter("suite <> 'drift'").groupBy("label", "suite", "grp").agg(q.alias("question_results"))
    probes = groups.filter("suite = 'constitution'").groupBy("label", "suite").agg(F.collect_list(F.struct(F.col("grp").alias("id"), F.concat(F.lit("principle "), "grp").alias("principle"), "question_results")).alias("probe_results"))
    categories = groups.filter("suite = 'categories'").groupBy("label", "suite").agg(F.collect_list(F.struct(F.col("grp").alias("category"), "question_results")).alias("category_results"))
    turns = a.filter("suite = 'drift'").groupBy("label", "suite").agg(F.collect_list(F.struct("question", "response", "judge_principle", F.concat(F.lit("principle "), "grp").alias("principle"))).alias("turn_results"))
    return probes.unionByName(categories, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)


def e2_judged_items(spark: SparkSession, d: str) -> DataFrame:
    """Every judged answer of three suites' nested reports."""
    return R.judged_items(_reports(spark, d)).select("label", "suite", "group_id", "principle", "question", F.md5("response").alias("response_md5"))


def a6_item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per answer of the probe reports, from which conditions are compared."""
    rows = _answers(spark, d).filter("suite = 'constitution'").withColumnRenamed("grp", "group_id")
    v = R.item_vectors(rows.withColumn("group_id", F.concat_ws("/", "group_id", "question")))
    return v.select("label", "key", "think_len", F.round("ext_ratio", 6).alias("ext_ratio"), "is_ask", "hollow")


def a18_think_stats(spark: SparkSession, d: str) -> DataFrame:
    """Answers, mean characters of reasoning and share of empty reasoning by label, to one place."""
    n = T.think_length(F.col("response"))
    rows = _answers(spark, d).filter("suite = 'constitution'").select("label", n.alias("n_think"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("n_think"), 1).alias("mean_think_chars"), F.round(100 * F.avg((F.col("n_think") < 10).cast("double")), 1).alias("pct_empty"))


def e24_e6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Suites' scores side by side, one row per label: nulls where a suite wasn't run."""
    a = _answers(spark, d).filter("NOT (label = 'src1' AND suite = 'categories')")
    wide = a.groupBy("label").pivot("suite", ["constitution", "categories", "drift"]).agg(F.avg(F.col("rule_passed").cast("double")))
    names = {"constitution": "constitution_score", "categories": "category_score", "drift": "drift_score"}
    return wide.select("label", *[F.round(c, 6).alias(n) for c, n in names.items()])


def s7_newest_reports(spark: SparkSession, d: str) -> DataFrame:
    """The newest report of each folder and suite, superseded and derived ones left out."""
    return R.newest_reports(documents(spark, d).select(F.expr(PATH.replace("VARCHAR(8)", "STRING")).alias("path")))


def s16_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A seeded draw of 40 executor rows with the call that is right; rows whose call can't be read are left out."""
    rows = P.executor_rows(trajectories(spark, d)).withColumn("target", F.when(F.col("conv_id") % 6 == 1, F.lit("<tool_call>{</tool_call>")).otherwise(F.col("target")))
    drawn = rows.orderBy(digest("holdout", F.col("conv_id"), F.col("pos"), F.col("k")), "conv_id", "pos", "k").limit(40)
    call = T.call_fields(F.get(T.call_bodies(F.col("target")), F.lit(0)))
    out = drawn.withColumn("call", call).filter(F.coalesce("call.name", F.lit("")) != "").withColumn("arguments", F.from_json("call.arguments", "map<string,string>", T.LAX))
    salient = F.coalesce(*[F.when(F.col("call.name") == n, F.try_element_at("arguments", F.lit(a))) for n, a in P.SALIENT.items()])
    return out.select("conv_id", "pos", "k", "instruction", F.col("call.name").alias("gold_name"), salient.alias("gold_arg"))


def s11_numeric(spark: SparkSession, d: str) -> DataFrame:
    """A seeded draw of 50 questions whose answer is a number after '####'."""
    rows = documents(spark, d).select("doc_id", T.strip(F.col("text")).alias("question"), F.concat(F.lit("so it is "), F.when(F.col("doc_id") % 4 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("#### "), F.format_number("n_chars", 0)))).alias("answer"))
    rows = rows.withColumn("expected_answer", T.hash_answer(F.col("answer"))).filter("expected_answer <> ''")
    drawn = rows.orderBy(digest("gsm", F.col("doc_id")), "doc_id").limit(50)
    return drawn.select("doc_id", F.md5("question").alias("question_md5"), "expected_answer", F.lit("word_problems").alias("question_type"), F.lit(1).alias("level"))


def s14_appraisal_questions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled utterances as question rows with their appraisal as one field."""
    rows = documents(spark, d).select("doc_id", F.col("text").alias("utterance"), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("emotion"), F.array("lang", "source").alias("top3"), F.when(F.col("doc_id") % 2 == 0, F.lit(0.25)).alias("valence"))
    meta = F.struct(F.coalesce("emotion", F.lit("")).alias("emotion"), F.array_join("top3", "|").alias("top3"), F.coalesce("valence", F.lit(0.5)).alias("valence"))
    return rows.select("doc_id", F.md5("utterance").alias("question_md5"), F.lit("appraisal_empathy").alias("format"), F.to_json(meta).alias("appraisal_meta"))


def e17_failure_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is told after a failed call, by the tools of its profile."""
    r = responses(spark, d)
    tool = F.when(F.col("doc_id") % 2 == 0, "web_search").otherwise("python_execute")
    return r.select("doc_id", F.md5(R.failure_prompt(tool, F.concat(F.lit(" bad "), "source", F.lit("\n")), S.tools_of(F.col("profile")), F.col("doc_id") % 5 == 0)).alias("prompt_md5"))


SLOTS = {"WHO": "Person", "WHERE": "Place", "WHEN": "Time"}
RAW = """CASE doc_id % 4 WHEN 0 THEN concat('{"entities": [{"slot": "who", "name": " ', source, ' ", "description": "a source"}, {"slot": "why", "name": "x", "description": ""}, {"slot": "what", "name": "', lang, '", "description": "a language", "label": "Topic"}]}')
 WHEN 1 THEN '{"entities": [{"name": "n", "description": "d"}, {"slot": "When", "description": "no name"}]}' WHEN 2 THEN 'no json' ELSE '{"other": 1}' END"""


def e13_entities(spark: SparkSession, d: str) -> DataFrame:
    """Typed entities of a model's JSON, one row each."""
    rows = documents(spark, d).select("doc_id", F.posexplode(R.entities(F.expr(RAW), SLOTS)).alias("k", "e"))
    return rows.select("doc_id", "k", "e.slot", "e.label", "e.name", "e.description")


def e26_memory(spark: SparkSession, d: str) -> DataFrame:
    """A profile after updates, as it is read."""
    base = F.create_map(F.lit("goals"), F.col("source"), F.lit("role"), F.col("lang"))
    updates = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("role"), F.lit("new"), F.lit("notes"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    return documents(spark, d).select("doc_id", R.merged_memory(base, updates).alias("memory"))


def x26_e27_read(spark: SparkSession, d: str) -> DataFrame:
    """A read of a page by a prompt: its lines of more than 60 characters as paragraphs, the best five of them."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), T.strip), lambda p: F.length(p) > 60)
    prompt = F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.lit("The of")).when(F.col("doc_id") % 4 == 2, F.lit("zzz zzzz")).otherwise(F.lit("What is the latest? Find thon tion ander les que erst und thand now"))
    content = F.array_join(R.top_paragraphs(lines, prompt), "\n\n")
    shown = F.when(F.length(content) > 2000, F.concat(F.left(content, F.lit(2000)), F.lit(T.CUT))).otherwise(content)
    head = F.concat(F.lit("[Fetched: http://x/"), F.col("doc_id").cast("string"), F.lit("]"), F.when(prompt != "", F.concat(F.lit("\nPrompt: "), prompt)).otherwise(""))
    return documents(spark, d).select("doc_id", F.md5(F.concat(head, F.lit("\n\n"), shown)).alias("read_md5"))


def f22_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many seeds each filter skips first, and how many are left: category, branch, skipped categories, empty or done."""
    r = responses(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    why = F.when(F.col("category") == "general", "category").when(~F.col("category").isin(*S.GREEDY, *S.MATH), "branch").when(F.col("category") == "math_arithmetic", "skipped").when((T.strip(F.col("r")) == "") | F.coalesce("done", F.lit(False)), "empty_or_done").otherwise("kept")
    return r.groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def r10_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of claims by what their query found."""
    i = F.col("doc_id")
    claim = R.claim_confidence(i % 7 != 0, F.when(i % 5 != 0, F.col("text")), F.when(i % 3 == 0, i % 2), i % 4 == 1)
    return documents(spark, d).select("doc_id", claim.alias("c")).select("doc_id", "c.verified", "c.confidence", "c.method")


def p13_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Name and arguments of every XML call, null where the tool is unknown or lacks one that it needs."""
    rows = xml_turns(spark, d).filter("role = 'assistant'").select("conv_id", "pos", F.posexplode(F.regexp_extract_all("content", F.lit(V.SPAN), 1)).alias("k", "call"))
    return rows.withColumn("f", V.xml_arguments(F.col("call"))).select("conv_id", "pos", "k", "f.name", "f.arguments")


def e22_tools_line(spark: SparkSession, d: str) -> DataFrame:
    """The judge's line on the tools that a question was meant to have."""
    profile = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 9 == 1, F.lit("custom")).otherwise(F.col("profile"))
    return responses(spark, d).select("doc_id", R.tools_line(profile).alias("line"))


def u1_calls(spark: SparkSession, d: str) -> DataFrame:
    """The result of every trajectory's first call in a message by the registry, for the session's tools."""
    tools = G.builtins(printed=F.lit("42"), found=F.concat(F.lit("found by "), F.col("conv_id").cast("string")), now=F.lit("2026-01-01 00:00:00 UTC"), memory=F.when(F.col("conv_id") % 2 == 0, F.lit("likes tea")))
    tools.deregister("read_url")
    rows = trajectories(spark, d).filter("role = 'assistant'").withColumn("call", T.first_call(F.col("content"))).filter("call IS NOT NULL")
    profile = F.when(F.col("conv_id") % 3 == 0, "all_tools").otherwise("compute_only")
    result = tools.call(F.col("call.name"), F.col("call.arguments"), S.tools_of(profile))
    return rows.select("conv_id", "pos", F.col("call.name").alias("name"), result.alias("result"))


QUERIES = {
    f.__name__: f
    for f in (e2_judged_items, a6_item_vectors, a18_think_stats, e24_e6_summary, s7_newest_reports, s16_holdout, s11_numeric, s14_appraisal_questions, e17_failure_prompts, e13_entities, e26_memory, x26_e27_read, f22_filters, r10_confidence, p13_arguments, e22_tools_line, u1_calls)
}

_A = f"WITH {RESPONSES_SQL}, a AS (SELECT {", ".join(f"{e} AS {n}" for n, e in ANSWER.items())} FROM responses)"
_THINK = f"length({STRIP.format(body('think', 'response'))})"
SQL = {
    "e2_judged_items": f"""{_A} SELECT label, suite, CASE suite WHEN 'constitution' THEN grp WHEN 'categories' THEN 'cat::' || grp ELSE 'drift' END AS group_id,
        coalesce(judge_principle, CASE suite WHEN 'categories' THEN 'Category: ' || grp ELSE 'principle ' || grp END) AS principle, question, md5(response) AS response_md5 FROM a""",
    "a6_item_vectors": f"""{_A}, v AS (SELECT label, concat(grp, '/', question, '::', question_idx) AS key, {_THINK}::DOUBLE AS think_len, length({USER}) AS chars, (regexp_matches(r, '(?is)<ask>.*?</ask>') AND NOT regexp_matches(r, '(?is)<answer>.*?</answer>')) OR {STRIP.format(body('ask', 'r'))} <> '' AS ask, rule_passed
          FROM (SELECT *, response AS r FROM a) WHERE suite = 'constitution')
        SELECT label, key, think_len, round(think_len / nullif(chars + think_len, 0), 6) AS ext_ratio, ask::INT::DOUBLE AS is_ask, (rule_passed AND chars = 0)::INT::DOUBLE AS hollow FROM v""",
    "a18_think_stats": f"""{_A}, v AS (SELECT label, {_THINK} AS t FROM a WHERE suite = 'constitution')
        SELECT label, count(*) AS n, round(avg(t), 1) AS mean_think_chars, round(100 * avg((t < 10)::INT), 1) AS pct_empty FROM v GROUP BY label""",
    "e24_e6_summary": f"""{_A}, s AS (SELECT label, suite, avg(rule_passed::INT) AS v FROM a WHERE NOT (label = 'src1' AND suite = 'categories') GROUP BY ALL)
        SELECT label, round(max(v) FILTER (suite = 'constitution'), 6) AS constitution_score, round(max(v) FILTER (suite = 'categories'), 6) AS category_score, round(max(v) FILTER (suite = 'drift'), 6) AS drift_score FROM s GROUP BY label""",
    "s7_newest_reports": rf"""WITH f AS (SELECT {PATH} AS path FROM documents), n AS (SELECT path, string_split(path, '/')[-1] AS name, regexp_replace(path, '/[^/]*$', '') AS folder FROM f),
        s AS (SELECT *, regexp_extract(name, '^(constitution|category|drift|adversarial|persona)_report.*\d{{8}}_\d{{6}}\.json$', 1) AS suite FROM n WHERE NOT regexp_matches(name, '_rescored\.json$'))
        SELECT path, folder, suite FROM s WHERE suite <> '' QUALIFY row_number() OVER (PARTITION BY folder, suite ORDER BY name DESC) = 1""",
    "s16_holdout": rf"""WITH {TRAJECTORIES}, g AS (SELECT conv_id, pos, replace(regexp_extract(content, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), chr(10), '\n') AS b FROM trajectories WHERE role = 'assistant' AND contains(content, '<tool_call>')),
        e AS (SELECT conv_id, pos, json_extract_string(b, '$.name') AS name, json_extract_string(b, '$.arguments') AS args FROM g),
        i AS (SELECT *, CASE name WHEN 'web_search' THEN json_extract_string(args, '$.query') WHEN 'python_execute' THEN json_extract_string(args, '$.code') WHEN 'read_url' THEN json_extract_string(args, '$.url') END AS arg FROM e),
        o AS (SELECT *, row_number() OVER (ORDER BY md5(concat('holdout|', conv_id, '|', pos, '|', 0)), conv_id, pos) AS nth FROM i WHERE trim(arg) <> '')
        SELECT conv_id, pos, 0 AS k, CASE name WHEN 'web_search' THEN 'Use web_search to find: ' || trim(arg) WHEN 'python_execute' THEN 'Use python_execute to run this code:' || chr(10) || arg ELSE 'Use read_url to fetch ' || arg || ' and extract: prices' END AS instruction,
          name AS gold_name, arg AS gold_arg FROM o WHERE nth <= 40 AND conv_id % 6 <> 1""",
    "s11_numeric": r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS question_md5, n_chars::VARCHAR AS expected_answer, 'word_problems' AS question_type, 1 AS level
        FROM documents WHERE doc_id % 4 <> 0 QUALIFY row_number() OVER (ORDER BY md5(concat('gsm|', doc_id)), doc_id) <= 50""",
    "s14_appraisal_questions": """SELECT doc_id, md5(text) AS question_md5, 'appraisal_empathy' AS format,
        concat('{"emotion":"', CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, '","top3":"', lang, '|', source, '","valence":', CASE WHEN doc_id % 2 = 0 THEN '0.25' ELSE '0.5' END, '}') AS appraisal_meta FROM documents""",
    "e17_failure_prompts": f"""WITH {RESPONSES_SQL}, t AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'web_search' ELSE 'python_execute' END AS tool, doc_id % 5 = 0 AS final,
          CASE profile WHEN 'all_tools' THEN ['get_datetime', 'python_execute', 'read_url', 'web_search'] WHEN 'compute_only' THEN ['python_execute'] WHEN 'compute_and_search' THEN ['python_execute', 'read_url', 'web_search'] ELSE [] END AS tools FROM responses),
        o AS (SELECT *, list_filter(tools, lambda x: x <> tool) AS others FROM t)
        SELECT doc_id, md5(concat('[TOOL_FAILURE] The previous tool call failed.', chr(10), 'Tool: ', tool, chr(10), 'Error: bad ', source, chr(10), 'Available alternatives: ', CASE WHEN len(others) > 0 THEN array_to_string(others, ', ') ELSE 'none' END, '.', chr(10),
          CASE WHEN len(others) > 0 THEN 'Do not call this tool again in this response. If another tool is available and relevant, use it now. ' ELSE 'Do not call any tools again in this response. Provide the best possible answer without tools. ' END,
          'If the tool failure blocks a reliable answer, say so clearly.', CASE WHEN final THEN ' The failure is non-retryable due to safety or configuration constraints.' ELSE '' END)) AS prompt_md5 FROM o""",
    "e13_entities": """SELECT doc_id, 0 AS k, 'WHO' AS slot, 'Person' AS label, source AS name, 'a source' AS description FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 1, 'WHAT', 'Topic', lang, 'a language' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 0, '', 'Task', 'n', 'd' FROM documents WHERE doc_id % 4 = 1""",
    "e26_memory": """SELECT doc_id, concat('[GOALS] ', source, chr(10), '[ROLE] ', CASE WHEN doc_id % 3 = 0 THEN concat('new', chr(10), '[NOTES] ', source) ELSE lang END) AS memory FROM documents""",
    "x26_e27_read": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: length(x) > 60) AS ps,
            CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'The of' WHEN 2 THEN 'zzz zzzz' ELSE 'What is the latest? Find thon tion ander les que erst und thand now' END AS prompt FROM documents),
        w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(prompt), '\w+')), lambda x: NOT list_contains(string_split('{' '.join(T.PAGE_STOP_WORDS)}', ' '), x)) AS asked FROM p),
        s AS (SELECT doc_id, i, ps[i] AS x, len(list_intersect(asked, regexp_extract_all(lower(ps[i]), '[\w\p{{L}}\p{{N}}]+'))) AS score FROM w, unnest(range(1, len(ps) + 1)) AS u(i)),
        b AS (SELECT doc_id, list(x ORDER BY score DESC, i) AS best FROM (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 5) GROUP BY 1),
        c AS (SELECT w.doc_id, prompt, array_to_string(CASE WHEN len(asked) = 0 THEN ps[1:8] WHEN best IS NOT NULL THEN best ELSE ps[1:3] END, chr(10) || chr(10)) AS t FROM w LEFT JOIN b USING (doc_id))
        SELECT doc_id, md5(concat('[Fetched: http://x/', doc_id, ']', CASE WHEN prompt <> '' THEN concat(chr(10), 'Prompt: ', prompt) ELSE '' END, chr(10), chr(10), CASE WHEN length(t) > 2000 THEN left(t, 2000) || '{T.CUT}' ELSE t END)) AS read_md5 FROM c""",
    "f22_filters": rf"""WITH {RESPONSES_SQL}, l AS (SELECT DISTINCT doc_id FROM labels), w AS (SELECT CASE WHEN category = 'general' THEN 'category' WHEN category NOT IN ('user_context_behavioral', 'subjective_tradeoffs', 'math_arithmetic', 'math_algebra') THEN 'branch'
          WHEN category = 'math_arithmetic' THEN 'skipped' WHEN trim(r) = '' OR l.doc_id IS NOT NULL THEN 'empty_or_done' ELSE 'kept' END AS outcome FROM responses x LEFT JOIN l ON l.doc_id = x.doc_id) SELECT outcome, count(*) AS n FROM w GROUP BY 1""",
    "r10_confidence": """SELECT doc_id, (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND ((doc_id % 3 = 0 AND doc_id % 2 = 1) OR doc_id % 4 = 1)) AS verified,
        (CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 0.5 WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 0.9 WHEN doc_id % 4 = 1 THEN 0.8 ELSE 0.2 END)::DOUBLE AS confidence,
        CASE WHEN doc_id % 7 = 0 THEN 'graph_unavailable' WHEN doc_id % 5 = 0 THEN 'unverifiable' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'sparql_select_match' WHEN doc_id % 4 = 1 THEN 'sparql_ask_match' ELSE 'sparql_no_match' END AS method FROM documents""",
    "p13_arguments": rf"""WITH m AS ({XML}), c AS (SELECT conv_id, pos, regexp_extract_all(content, '(?s)<tool>(.*?)</tool>', 1) AS cs FROM m WHERE role = 'assistant'),
        e AS (SELECT conv_id, pos, (k - 1)::INT AS k, trim(cs[k]) AS b, trim(string_split(trim(cs[k]), '(')[1]) AS tool FROM c, unnest(range(1, len(cs) + 1)) AS u(k)),
        a AS (SELECT *, CASE tool WHEN 'python_execute' THEN json_object('code', coalesce(nullif(regexp_extract(b, '(?s)code="{{3}}(.*?)"{{3}}', 1), ''), regexp_extract(b, 'code="([^"]*)"', 1)))::VARCHAR WHEN 'web_search' THEN json_object('query', regexp_extract(b, 'query="(.*?)"', 1))::VARCHAR
          WHEN 'read_url' THEN json_object('url', regexp_extract(b, 'url="(.*?)"', 1), 'prompt', 'prices of tea')::VARCHAR WHEN 'get_datetime' THEN '{{}}' WHEN 'scratchpad_update' THEN json_object('section', 'todo', 'content', 'buy tea')::VARCHAR END AS arguments FROM e)
        SELECT conv_id, pos, k, CASE WHEN arguments IS NOT NULL THEN tool END AS name, arguments FROM a""",
    "e22_tools_line": f"""WITH {RESPONSES_SQL} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown (a standard tool set may have been available)' WHEN doc_id % 9 = 1 THEN 'custom' WHEN profile = 'all_tools' THEN 'get_datetime, python_execute, read_url, web_search'
        WHEN profile = 'compute_only' THEN 'python_execute' WHEN profile = 'compute_and_search' THEN 'python_execute, read_url, web_search' ELSE 'none (knowledge/reasoning only — no external tools intended for this question)' END AS line FROM responses""",
    "u1_calls": rf"""WITH {TRAJECTORIES}, g AS (SELECT conv_id, pos, json_extract_string(replace(regexp_extract(content, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), chr(10), '\n'), '$.name') AS name
            FROM trajectories WHERE role = 'assistant' AND contains(content, '<tool_call>')
          UNION ALL SELECT conv_id, pos, 'x' FROM trajectories WHERE role = 'assistant' AND NOT contains(content, '<tool_call>') AND regexp_matches(content, '(?s)<tool>\s*\w+\s*\('))
        SELECT conv_id, pos, name, CASE name WHEN 'web_search' THEN CASE WHEN conv_id % 3 = 0 THEN concat('found by ', conv_id) ELSE 'Error: tool ''web_search'' is not available in this session.' END WHEN 'python_execute' THEN '42'
          WHEN 'user_memory_read' THEN CASE WHEN conv_id % 2 = 0 THEN 'likes tea' ELSE '{G.NO_MEMORY}' END ELSE concat('Error: unknown tool ''', name, ''' — only registered tools are callable.') END AS result FROM g""",
}
