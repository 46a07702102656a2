"""Curation queries over trajectories made from conversations, and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import digest, pick, uniform
from millrace.operators import conversion as V
from millrace.operators import curation as C
from millrace.operators import projection as P
from millrace.operators.ranks import numbered
from millrace.plans.fixtures import MESSAGES_SQL, RESPONSES_SQL, TRAJECTORIES, XML, documents, messages, responses, trajectories, xml_turns


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return C.trajectories(messages(spark, d))


def f1_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first broken rule of every trajectory."""
    return _rows(spark, d).select("conv_id", C.gate_reason(F.col("messages")).alias("reason"))


def f1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule broke first."""
    return f1_gate(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def p1_p6_messages(spark: SparkSession, d: str) -> DataFrame:
    """First reasoning, system text and first user text."""
    m = F.col("messages")
    return _rows(spark, d).select("conv_id", F.md5(C.first_think(m)).alias("think_md5"), C.system_text(m).alias("system"), F.md5(C.user_key(m)).alias("key_md5"))


def m1_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their text's first occurrence kept."""
    return C.keep_first(documents(spark, d).select("doc_id", "text", "source"), T.strip(F.col("text")), ["doc_id"]).select("doc_id", "source", F.md5("text").alias("md5"))


def m3_m7_samples(spark: SparkSession, d: str) -> DataFrame:
    """Caps per category, draws, splits, picks: all by keyed hashes."""
    docs = documents(spark, d).select("doc_id", "lang")
    kept = C.capped(docs, "lang", 100, "cap", "doc_id").select("doc_id", F.lit(True).alias("capped_in"))
    u = uniform("m16", F.col("doc_id"))
    profile = F.when(u < 0.5, "all_tools").when(u < 0.7, "compute_only").when(u < 0.9, "compute_and_search").otherwise("no_tools")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(digest("m6", F.col("doc_id"))))
    # Filtered by itself, so that tasks pass on twenty rows of a language at most.
    first = docs.withColumn("nth", order).filter("nth <= 20").select("doc_id", F.lit(True).alias("first"))
    return docs.join(kept, "doc_id", "left").join(first, "doc_id", "left").select(
        "doc_id", F.coalesce("capped_in", F.lit(False)).alias("capped_in"), (uniform("m5", F.col("doc_id")) < 0.3).alias("drawn"), (uniform("m7", F.col("doc_id")) < 0.1).alias("is_eval"),
        profile.alias("profile"), pick(5, "m17", F.col("doc_id")).alias("phrase"), F.coalesce("first", F.lit(False)).alias("stratified"))


def m8_stages(spark: SparkSession, d: str) -> DataFrame:
    """Curriculum stages: short rows without tools, all rows, all rows and a replay of the first stage."""
    m = messages(spark, d)
    per = m.groupBy("conv_id").agg(F.max((F.contains("content", F.lit("<tool>"))).cast("int")).alias("tool"), F.sum(F.when(F.col("role") == "assistant", F.length("content") + 1).otherwise(0)).alias("chars"))
    short = (F.col("tool") == 0) & (F.coalesce("chars", F.lit(0)) - 1 < C.SHORT)
    one = per.filter(short).select("conv_id")
    sizes = per.agg(F.count("*").alias("n"), F.count_if(short).alias("s"))
    hashed = one.withColumn("h", F.conv(F.substring(digest("replay", F.col("conv_id")), 1, 15), 16, 10).cast("long"))
    # One row of two counts.
    replay = numbered(hashed, "h", "conv_id").join(F.broadcast(sizes), F.col("number") < F.least("s", F.greatest(F.lit(1), F.expr("n div 5")))).select("conv_id")
    stages = [one.select("conv_id", F.lit(1).alias("stage")), per.select("conv_id", F.lit(2).alias("stage")), per.select("conv_id", F.lit(3).alias("stage")), replay.select("conv_id", F.lit(3).alias("stage"))]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out.groupBy("stage", "conv_id").agg(F.count("*").alias("copies"))


def m9_interleave(spark: SparkSession, d: str) -> DataFrame:
    """The place of one French or German document after every five others."""
    docs = documents(spark, d).select("doc_id", "lang")
    rows = C.interleaved(docs.filter("lang IN ('en', 'es')"), docs.filter("lang IN ('fr', 'de')"), 5, "doc_id", "doc_id")
    return rows.select("doc_id", F.col("place").cast("long").alias("place"))


def x4_x6_routes(spark: SparkSession, d: str) -> DataFrame:
    """How a trajectory is converted: split status, and the route to native calls."""
    m = F.col("messages")
    said = F.transform(C.of_role(m, "assistant"), lambda x: x["content"])
    after = F.transform(said, lambda c: F.regexp_replace(c, r"(?is)^.*?</think\s*>", ""))
    calls = F.aggregate(after, F.lit(0), lambda s, c: s + F.regexp_count(c, F.lit(r"(?s)<tool>.*?</tool>")).cast("int"))
    last = F.element_at(m, -1)
    open_end = (last["role"] == "assistant") & F.element_at(after, -1).rlike(r"(?s)<tool>.*?</tool>") & ~F.regexp_replace(F.element_at(after, -1), r"(?s)^.*</tool>", "").rlike("(?is)<answer>.*?</answer>")
    status = F.when(calls == 0, "unchanged").when(open_end, "dropped_no_answer").when(calls > C.MOST_CALLS, "dropped_too_many").otherwise("transformed")
    native = F.exists(said, lambda c: F.contains(c, F.lit("<tool_call>")))
    stray = F.exists(said, lambda c: F.contains(c, F.lit("<tool>")) | F.contains(c, F.lit("</tool>")))
    route = F.when(native & stray, "mixed").when(native, "native").when(stray, "xml").otherwise("no_tool")
    rows = _rows(spark, d).filter(F.size(C.of_role(m, "assistant")) > 0)
    return rows.select("conv_id", calls.cast("long").alias("calls"), status.alias("status"), route.alias("route"))


#: What code printed, and the time that a replay tells.
PRINTED, NOW = "concat('printed ', CAST(conv_id AS STRING))", "2026-01-01 00:00:00 UTC"


def x4_split(spark: SparkSession, d: str) -> DataFrame:
    """Messages of trajectories after each XML call got a turn of its own; dropped ones have their status only."""
    rows = V.split(C.trajectories(xml_turns(spark, d)), F.expr(PRINTED), F.lit(NOW))
    kept = F.when(F.startswith("status", F.lit("dropped")), F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")))).otherwise(F.col("messages"))
    return rows.select("conv_id", "status", "tool_format", F.posexplode(kept).alias("pos", "m")).select("conv_id", "status", "tool_format", "pos", "m.role", "m.content")


def x5_x6_native(spark: SparkSession, d: str) -> DataFrame:
    """Messages of trajectories in native form, with calls and their ids; dropped ones are left out."""
    rows = V.native(C.trajectories(xml_turns(spark, d)), "conv_id", F.expr(PRINTED), F.lit(NOW)).filter("route <> 'dropped'")
    return rows.select("conv_id", "route", F.posexplode("messages").alias("pos", "m")).select("conv_id", "route", "pos", "m.role", "m.content", "m.name", "m.arguments", "m.call_id")


def x8_x9_prompts(spark: SparkSession, d: str) -> DataFrame:
    """System prompts restamped, and robustness variants of a share of rows."""
    out = C.variants(_rows(spark, d), {"minimal": 0.2, "brief": 0.3, "none": 0.1}, "variants", "conv_id", F.lit("You are"))
    return out.select("conv_id", "level", F.array_join(F.transform(C.of_role(F.col("messages"), "system"), lambda m: m["content"]), "|").alias("system"), F.size("messages").cast("long").alias("n"))


def x16_x23_roles(spark: SparkSession, d: str) -> DataFrame:
    """Long form and back: results said as user become tool turns, prompts of system and user turns, the last user turn."""
    m = F.col("messages")
    swapped = F.transform(m, lambda x: F.when((x["role"] == "user") & (x["pos"] >= 2), F.lit("tool")).otherwise(x["role"]))
    prompt = F.filter(m, lambda x: x["role"].isin("system", "user"))
    last = F.try_element_at(C.of_role(m, "user"), F.lit(-1))["content"]
    return _rows(spark, d).select("conv_id", F.array_join(swapped, ",").alias("roles"), F.size(prompt).cast("long").alias("n_prompt"), F.md5(last).alias("question_md5"))


def j11_w8_next(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the one after it, and calls per tool within a cap."""
    w = Window.partitionBy("conv_id").orderBy("pos", "role")
    rows = messages(spark, d).withColumn("next_role", F.lead("role").over(w)).withColumn("next_md5", F.md5(F.lead("content").over(w)))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("pos"))
    return rows.select("conv_id", "pos", "role", "next_role", "next_md5", (nth <= 3).alias("within_cap"))


def a1_a33_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, mean characters (floor) and tool rows by language, by source and in all."""
    r = responses(spark, d).select("lang", "source", F.length("text").alias("chars"), F.contains("r", F.lit("<tool>")).alias("tool"))
    return r.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.expr("sum(chars) div count(*)").alias("mean_chars"), F.count_if("tool").alias("tool_rows"))


def x21_f8_executor(spark: SparkSession, d: str) -> DataFrame:
    """One row per call of an owned tool: instruction, target, and the broken terms of the executor's contract, some of them broken on purpose."""
    rows = P.executor_rows(trajectories(spark, d))
    broken = lambda n, of, bad, good: F.when(F.col("conv_id") % n == of, bad).otherwise(F.col(good))
    rows = rows.withColumns({
        "system": broken(7, 3, F.lit("Another prompt."), "system"),
        "target": broken(11, 2, F.concat("target", "target"), "target"),
        "native_tools": broken(5, 1, F.lit("[]"), "native_tools"),
        "instruction": broken(3, 0, F.left("instruction", F.lit(24)), "instruction"),
    })
    codes = P.executor_faults(F.col("system"), F.col("instruction"), F.col("target"), F.col("native_tools"))
    return rows.select("conv_id", "pos", "k", "tool", "instruction", F.md5("target").alias("target_md5"), F.array_join(codes, ",").alias("violations"))


def f7_f9_contract(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the thinker's contract, tallied by code."""
    m = F.col("messages")
    said = C.of_role(m, "assistant")
    last = F.element_at(m, -1)
    opening = F.coalesce(F.length(C.first_think(m)), F.lit(0))
    think = lambda x: F.length(T.strip(T.tag_body(x["content"], "think")))
    first_user = F.coalesce(F.try_element_at(C.of_role(m, "user"), F.lit(1))["content"], F.lit(""))
    ends = (last["role"] == "assistant") & (F.contains(last["content"], F.lit("<answer>")) | F.contains(last["content"], F.lit("<ask>")))
    tests = {
        "T1": (F.element_at(m, 1)["role"] != "system") | (F.element_at(m, 1)["content"] != "You are helpful."),
        "T2_end": ~ends,
        "T2_think": opening < C.MIN_THINK,
        "T3": F.exists(said, lambda x: F.contains(x["content"], F.lit("<tool>"))),
        "T5": ~F.contains(first_user, F.lit("[USER MEMORY")),
        "T6": F.exists(said, lambda x: think(x) == 0),
    }
    codes = F.array_compact(F.array(*[F.when(bad, code) for code, bad in tests.items()]))
    return _rows(spark, d).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def j6_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label covers yet, and labels that still have a document."""
    docs, done = documents(spark, d).select("doc_id", "source"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id")
    todo = docs.join(done, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("todo"))
    seen = docs.join(done, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("seen"))
    return todo.join(seen, "source", "full").select("source", F.coalesce("todo", F.lit(0)).alias("todo"), F.coalesce("seen", F.lit(0)).alias("seen"), F.greatest(F.lit(0), 30 - F.coalesce("seen", F.lit(0))).alias("m18_missing"))


QUERIES = {
    f.__name__: f
    for f in (f1_gate, f1_reasons, p1_p6_messages, m1_dedup, m3_m7_samples, m8_stages, m9_interleave, x4_x6_routes, x4_split, x5_x6_native, x8_x9_prompts, x16_x23_roles, j11_w8_next, a1_a33_stats, x21_f8_executor, f7_f9_contract, j6_resume)
}

_T = f"WITH {MESSAGES_SQL}"
_SYS = "min_by(content, pos) FILTER (role = 'system')"
_FIRST, _LAST = "min_by(content, pos) FILTER (role = 'assistant')", "max_by(content, pos) FILTER (role = 'assistant')"
_BANNED = "|".join(p.replace("+", r"\+") for p in C.BANNED)
_LEAK = "|".join(p.replace("(", r"\(") for p in C.LEAKS)
_GATE = rf"""g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS na, count(*) FILTER (role = 'system') AS ns, {_SYS} AS sys, {_FIRST} AS f, {_LAST} AS l,
    bool_or(role = 'assistant' AND len(list_filter(regexp_extract_all(lower(content), '(?s)<think>(.*?)</think>', 1), lambda t: regexp_matches(t, '{_BANNED}'))) > 0) AS banned FROM messages GROUP BY conv_id),
  h AS (SELECT *, regexp_matches(f, '(?is)<think>.*?</think>') AS ht, regexp_replace(regexp_extract(f, '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g') AS th FROM g),
  gate AS (SELECT conv_id, CASE WHEN n < 3 THEN 'too_few_messages' WHEN na = 0 THEN 'no_assistant_message' WHEN ns = 0 THEN 'no_system_message' WHEN regexp_matches(lower(sys), '{_LEAK}') THEN 'teacher_constitution_leaked'
    WHEN length(f) < 80 THEN 'response_too_short' WHEN NOT contains(l, '<answer>') AND NOT contains(l, '</answer>') THEN 'missing_tag_answer' WHEN NOT ht THEN 'missing_think_block' WHEN length(th) < 150 THEN 'think_too_short'
    WHEN banned THEN 'banned_think_phrase' ELSE 'ok' END AS reason FROM h)"""


def _u(seed: str, *parts: str) -> str:
    joined = ", '|', ".join(parts)
    return f"(('0x' || substr(md5(concat('{seed}|', {joined})), 1, 8))::BIGINT / 4294967296.0)"


#: The calls of every message, their results when replayed, and the message's parts.
_CALLS = rf"""m AS ({XML}),
    a AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY pos, role, content) - 1)::INT AS i, count(*) FILTER (role = 'tool') OVER (PARTITION BY conv_id) > 0 AS tools FROM m),
    p AS (SELECT *, regexp_replace(content, '(?is)^.*?</think\s*>', '') AS post FROM a),
    s AS (SELECT *, CASE WHEN role = 'assistant' THEN regexp_extract_all(post, '(?s)<tool>(.*?)</tool>', 1) ELSE [] END AS calls, left(content, length(content) - length(post)) AS head,
            regexp_extract(string_split(post, '</tool>')[-1], '(?is)<answer>.*?</answer>') AS answer FROM p),
    c AS (SELECT s.*, k, calls[k + 1] AS call, trim(calls[k + 1]) AS bare FROM s, unnest(range(0, len(calls))) AS u(k)),
    r AS (SELECT *, trim(string_split(bare, '(')[1]) AS tool, replace(replace(coalesce(nullif(regexp_extract(bare, '(?s)code="{{3}}(.*?)"{{3}}', 1), ''), regexp_extract(bare, 'code="([^"]*)"', 1)), '\n', chr(10)), '\t', chr(9)) AS code,
            regexp_extract(bare, 'query="(.*?)"', 1) AS query, regexp_extract(bare, 'url="(.*?)"', 1) AS url FROM c),
    t AS (SELECT *, CASE tool WHEN 'python_execute' THEN concat('printed ', conv_id) WHEN 'web_search' THEN concat('[Search results for: ', query, ']', chr(10), '{V.SEARCHED}')
            WHEN 'read_url' THEN concat('[Page content from: ', url, ']', chr(10), '{V.READ}') WHEN 'get_datetime' THEN '{NOW}' ELSE '{V.NO_RESULT}' END AS replay FROM r)"""

SQL = {
    "x4_split": rf"""WITH {_CALLS},
        parts AS (SELECT conv_id, i, 0 AS k, 0 AS part, role, content, false AS split FROM s WHERE tools OR len(calls) = 0
          UNION ALL SELECT conv_id, i, k, 1, 'assistant', CASE WHEN k = 0 AND regexp_replace(head || string_split(post, '<tool>')[1], '\s+$', '') <> ''
              THEN regexp_replace(regexp_replace(head || string_split(post, '<tool>')[1], '\s+$', '') || chr(10) || '<tool>' || call || '</tool>', '^\s+|\s+$', '', 'g') ELSE concat('<tool>', call, '</tool>') END, true FROM t WHERE NOT tools
          UNION ALL SELECT conv_id, i, k, 2, 'tool', concat('[TOOL_RESULT: ', tool, ']', chr(10), replay, chr(10), '[/TOOL_RESULT]'), true FROM t WHERE NOT tools
          UNION ALL SELECT conv_id, i, 1000, 3, 'assistant', answer, true FROM s WHERE NOT tools AND len(calls) > 0 AND answer <> ''),
        g AS (SELECT conv_id, CASE WHEN NOT bool_or(split) THEN 'unchanged' WHEN max_by(role, i * 10000 + k * 4 + part) = 'tool' THEN 'dropped_no_answer' WHEN count(*) FILTER (role = 'tool') > 5 THEN 'dropped_too_many' ELSE 'transformed' END AS status FROM parts GROUP BY 1)
        SELECT conv_id, status, CASE WHEN status = 'transformed' THEN 'v3_multi_turn' END AS tool_format, (row_number() OVER (PARTITION BY conv_id ORDER BY i, k, part) - 1)::INT AS pos, role, content FROM parts JOIN g USING (conv_id) WHERE NOT starts_with(status, 'dropped')
        UNION ALL SELECT conv_id, status, NULL, 0, NULL, NULL FROM g WHERE starts_with(status, 'dropped')""",
    "x5_x6_native": rf"""WITH {_CALLS},
        known AS (SELECT *, CASE tool WHEN 'python_execute' THEN json_object('code', code)::VARCHAR WHEN 'web_search' THEN json_object('query', query)::VARCHAR WHEN 'read_url' THEN json_object('url', url, 'prompt', 'prices of tea')::VARCHAR
            WHEN 'get_datetime' THEN '{{}}' WHEN 'scratchpad_update' THEN json_object('section', 'todo', 'content', 'buy tea')::VARCHAR END AS args FROM t),
        g AS (SELECT s.conv_id, bool_or(tools) AS tools, bool_or(role = 'assistant' AND contains(content, '<tool_call>')) AS nat, bool_or(role = 'assistant' AND (contains(content, '<tool>') OR contains(content, '</tool>'))) AS stray,
              sum(len(calls)) AS n, (SELECT count(*) FROM known x WHERE x.conv_id = s.conv_id AND args IS NULL) AS bad FROM s GROUP BY s.conv_id),
        w AS (SELECT conv_id, CASE WHEN NOT tools THEN 'no_tool' WHEN nat THEN CASE WHEN stray THEN 'dropped' ELSE 'already_native' END WHEN n = 0 OR bad > 0 THEN 'dropped' ELSE 'converted' END AS route FROM g),
        res AS (SELECT conv_id, i, CASE WHEN contains(content, '[TOOL_RESULT') THEN regexp_extract(content, '(?s)\[TOOL_RESULT: [^\]]*\]\s*(.*?)\s*\[/TOOL_RESULT\]', 1) ELSE trim(content) END AS result, pos % 10 AS nth FROM s WHERE role = 'tool'),
        parts AS (SELECT conv_id, i, 0 AS k, 0 AS part, role, content, NULL AS name, NULL AS arguments, NULL AS call_id FROM s JOIN w USING (conv_id) WHERE route <> 'converted' OR (len(calls) = 0 AND role <> 'tool')
          UNION ALL SELECT conv_id, i, k, 1, 'assistant', CASE WHEN k = 0 THEN regexp_replace(head, '\s+$', '') ELSE '' END, tool, args, 'call_' || substr(md5(concat(conv_id, '|', i, '|', k)), 1, 8) FROM known JOIN w USING (conv_id) WHERE route = 'converted'
          UNION ALL SELECT x.conv_id, x.i, k, 2, 'tool', coalesce(res.result, replay), NULL, NULL, 'call_' || substr(md5(concat(x.conv_id, '|', x.i, '|', k)), 1, 8) FROM known x JOIN w USING (conv_id)
              LEFT JOIN res ON res.conv_id = x.conv_id AND res.i = x.i + 1 + k AND res.nth = k + 1 WHERE route = 'converted'
          UNION ALL SELECT conv_id, i, 1000, 3, 'assistant', answer, NULL, NULL, NULL FROM s JOIN w USING (conv_id) WHERE route = 'converted' AND len(calls) > 0 AND answer <> '')
        SELECT conv_id, route, (row_number() OVER (PARTITION BY conv_id ORDER BY i, k, part) - 1)::INT AS pos, role, content, name, arguments, call_id FROM parts JOIN w USING (conv_id) WHERE route <> 'dropped'""",
    "f1_gate": f"{_T}, {_GATE} SELECT conv_id, reason FROM gate",
    "f1_reasons": f"{_T}, {_GATE} SELECT reason, count(*) AS n FROM gate GROUP BY reason",
    "p1_p6_messages": rf"""{_T}, {_GATE}, u AS (SELECT conv_id, min_by(content, pos) FILTER (role = 'user') AS u FROM messages GROUP BY 1)
        SELECT conv_id, CASE WHEN ht THEN md5(th) END AS think_md5, coalesce(sys, '') AS system, md5(regexp_replace(coalesce(u, ''), '^\s+|\s+$', '', 'g')) AS key_md5 FROM h JOIN u USING (conv_id)""",
    "m1_dedup": r"""WITH k AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS k FROM documents)
        SELECT doc_id, source, md5(text) AS md5 FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""",
    "m3_m7_samples": f"""WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('cap|', doc_id)), doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('m6|', doc_id))) AS b, {_u("m16", "doc_id")} AS u FROM documents)
        SELECT doc_id, a <= 100 AS capped_in, {_u("m5", "doc_id")} < 0.3 AS drawn, {_u("m7", "doc_id")} < 0.1 AS is_eval,
          CASE WHEN u < 0.5 THEN 'all_tools' WHEN u < 0.7 THEN 'compute_only' WHEN u < 0.9 THEN 'compute_and_search' ELSE 'no_tools' END AS profile,
          ('0x' || substr(md5(concat('m17|', doc_id)), 1, 8))::BIGINT % 5 AS phrase, b <= 20 AS stratified FROM x""",
    "m8_stages": f"""{_T}, p AS (SELECT conv_id, bool_or(contains(content, '<tool>')) AS tool, length(coalesce(string_agg(content, ' ') FILTER (role = 'assistant'), '')) AS chars FROM messages GROUP BY 1),
        s AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat('replay|', conv_id)), conv_id) AS k FROM p WHERE NOT tool AND chars < 600),
        n AS (SELECT least((SELECT count(*) FROM s), greatest(1, (SELECT count(*) FROM p) // 5)) AS replay),
        a AS (SELECT 1 AS stage, conv_id FROM s UNION ALL SELECT 2, conv_id FROM p UNION ALL SELECT 3, conv_id FROM p UNION ALL SELECT 3, conv_id FROM s, n WHERE k <= replay)
        SELECT stage, conv_id, count(*) AS copies FROM a GROUP BY ALL""",
    "m9_interleave": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang IN ('en', 'es')),
        b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS j FROM documents WHERE lang IN ('fr', 'de')), n AS (SELECT count(*) AS n FROM a)
        SELECT doc_id, i + least((i - 1) // 5, (SELECT count(*) FROM b)) AS place FROM a
        UNION ALL SELECT doc_id, CASE WHEN j * 5 <= n THEN j * 5 + j ELSE n + j END FROM b, n""",
    "x4_x6_routes": rf"""{_T}, s AS (SELECT conv_id, pos, role, content, regexp_replace(content, '(?is)^.*?</think\s*>', '') AS post, max(pos) OVER (PARTITION BY conv_id) AS top FROM messages),
        g AS (SELECT conv_id, sum(len(regexp_extract_all(post, '(?s)<tool>.*?</tool>'))) FILTER (role = 'assistant')::BIGINT AS calls,
              bool_or(pos = top AND role = 'assistant' AND regexp_matches(post, '(?s)<tool>.*?</tool>') AND NOT regexp_matches(regexp_replace(post, '(?s)^.*</tool>', ''), '(?is)<answer>.*?</answer>')) AS open_end,
              bool_or(role = 'assistant' AND contains(content, '<tool_call>')) AS native, bool_or(role = 'assistant' AND (contains(content, '<tool>') OR contains(content, '</tool>'))) AS stray, count(*) FILTER (role = 'assistant') AS na FROM s GROUP BY 1)
        SELECT conv_id, calls, CASE WHEN calls = 0 THEN 'unchanged' WHEN open_end THEN 'dropped_no_answer' WHEN calls > 5 THEN 'dropped_too_many' ELSE 'transformed' END AS status,
          CASE WHEN native AND stray THEN 'mixed' WHEN native THEN 'native' WHEN stray THEN 'xml' ELSE 'no_tool' END AS route FROM g WHERE na > 0""",
    "x8_x9_prompts": f"""{_T}, c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s FROM messages GROUP BY 1), v(level, share) AS (VALUES ('minimal', 0.2), ('brief', 0.3), ('none', 0.1))
        SELECT conv_id, level, array_to_string(list_transform(range(0, s), lambda i: 'You are ' || level), '|') AS system, n FROM c, v WHERE {_u("variants", "level", "conv_id")} < share""",
    "x16_x23_roles": f"""{_T} SELECT conv_id, string_agg(CASE WHEN role = 'user' AND pos >= 2 THEN 'tool' ELSE role END, ',' ORDER BY pos, role, content) AS roles, count(*) FILTER (role IN ('system', 'user')) AS n_prompt,
        md5(max_by(content, pos) FILTER (role = 'user')) AS question_md5 FROM messages GROUP BY conv_id""",
    "j11_w8_next": f"""{_T} SELECT conv_id, pos, role, lead(role) OVER w AS next_role, md5(lead(content) OVER w) AS next_md5, row_number() OVER (PARTITION BY conv_id, role ORDER BY pos) <= 3 AS within_cap
        FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY pos, role)""",
    "a1_a33_stats": f"""WITH {RESPONSES_SQL}, x AS (SELECT lang, source, length(text) AS c, contains(r, '<tool>') AS t FROM responses)
        SELECT lang, source, count(*) AS n, (sum(c) // count(*))::BIGINT AS mean_chars, count(*) FILTER (t) AS tool_rows FROM x GROUP BY GROUPING SETS ((), (lang), (source))""",
    "x21_f8_executor": rf"""WITH {TRAJECTORIES}, g AS (SELECT conv_id, pos, regexp_extract_all(content, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) AS cs FROM trajectories WHERE role = 'assistant'),
        b AS (SELECT conv_id, pos, (k - 1)::INT AS k, cs[k] AS body, replace(cs[k], chr(10), '\n') AS strict FROM g, unnest(range(1, len(cs) + 1)) AS u(k)),
        a AS (SELECT *, json_extract_string(strict, '$.name') AS tool, json_extract_string(strict, '$.arguments') AS args FROM b),
        i AS (SELECT *, CASE tool WHEN 'web_search' THEN nullif('Use web_search to find: ' || trim(json_extract_string(args, '$.query')), 'Use web_search to find: ') WHEN 'python_execute' THEN 'Use python_execute to run this code:' || chr(10) || json_extract_string(args, '$.code')
              WHEN 'read_url' THEN 'Use read_url to fetch ' || json_extract_string(args, '$.url') || ' and extract: ' || json_extract_string(args, '$.prompt') END AS told,
              CASE tool WHEN 'web_search' THEN trim(json_extract_string(args, '$.query')) WHEN 'python_execute' THEN json_extract_string(args, '$.code') ELSE json_extract_string(args, '$.url') END AS salient FROM a),
        f AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN left(told, 24) ELSE told END AS instruction, concat('<tool_call>', chr(10), body, chr(10), '</tool_call>') AS call, conv_id % 11 = 2 AS twice FROM i WHERE told IS NOT NULL)
        SELECT conv_id, pos, k, tool, instruction, md5(CASE WHEN twice THEN call || call ELSE call END) AS target_md5,
          array_to_string(list_filter([CASE WHEN conv_id % 7 = 3 THEN 'E1' END, CASE WHEN twice THEN 'E2' END, CASE WHEN conv_id % 5 = 1 AND NOT twice THEN 'E3' END, CASE WHEN NOT twice AND NOT contains(instruction, salient) THEN 'E4' END], lambda x: x IS NOT NULL), ',') AS violations FROM f""",
    "f7_f9_contract": rf"""{_T}, {_GATE}, m AS (SELECT conv_id, min_by(role, pos) AS r1, min_by(content, pos) AS c1, max_by(role, pos) AS rl, max_by(content, pos) AS cl, min_by(content, pos) FILTER (role = 'user') AS u,
            bool_or(role = 'assistant' AND contains(content, '<tool>')) AS tool, bool_or(role = 'assistant' AND regexp_replace(regexp_extract(content, '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g') = '') AS empty FROM messages GROUP BY 1),
        a AS (SELECT unnest(list_filter([CASE WHEN r1 <> 'system' OR c1 <> 'You are helpful.' THEN 'T1' END, CASE WHEN NOT (rl = 'assistant' AND (contains(cl, '<answer>') OR contains(cl, '<ask>'))) THEN 'T2_end' END,
            CASE WHEN NOT coalesce(ht, false) OR length(th) < 150 THEN 'T2_think' END, CASE WHEN tool THEN 'T3' END, CASE WHEN NOT contains(coalesce(u, ''), '[USER MEMORY') THEN 'T5' END, CASE WHEN empty THEN 'T6' END], lambda x: x IS NOT NULL)) AS code
            FROM m JOIN h USING (conv_id)) SELECT code, count(*) AS n FROM a GROUP BY 1""",
    "j6_resume": """SELECT source, count(*) FILTER (l.doc_id IS NULL) AS todo, count(*) FILTER (l.doc_id IS NOT NULL) AS seen, greatest(0, 30 - count(*) FILTER (l.doc_id IS NOT NULL)) AS m18_missing
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
}
