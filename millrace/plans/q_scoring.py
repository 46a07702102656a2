"""Scores of responses: rewards, harness, rule tables, appraisal, loop metrics, memory and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.plans.fixtures import RESPONSES_SQL, documents, responses
from millrace.plans.q_parse import USER, body, has, s

OUTPUT = "CASE WHEN doc_id % 2 = 0 THEN '42' ELSE 'the result is 41.9 and 1234' END"


def r1_r6_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Reward components and their two composites."""
    r, category = F.col("r"), F.col("category")
    rows = responses(spark, d).withColumns({"active": S.tools_of(F.col("profile")), "called": T.called_tools(r), "output": F.expr(OUTPUT)})
    called, active = F.col("called"), F.col("active")
    parts = {
        "format": S.format_reward(r),
        "accuracy": S.accuracy_reward(r, F.col("expected"), category, F.col("output")),
        "tool_integrity": S.integrity_reward(called, active),
        "tool_quality": S.quality_reward(r, called, active, category),
        "constitution": S.structure_reward(r),
        "greedy_followup": S.followup_reward(r, category),
    }
    rows = rows.select("doc_id", *[c.cast("double").alias(n) for n, c in parts.items()])
    named = {n: F.col(n) for n in parts}
    return rows.select("*", F.round(S.composite(named), 6).alias("reward_d"), F.round(S.composite(named, ("format", "accuracy")), 6).alias("reward_c"))


def f25_groups(spark: SparkSession, d: str) -> DataFrame:
    """Prompt groups whose rewards vary at all; the others teach nothing."""
    rows = responses(spark, d).select("source", S.format_reward(F.col("r")).cast("double").alias("reward"))
    varied = rows.groupBy("source").agg(F.var_samp("reward").alias("v"), F.count("*").alias("n"), F.avg("reward").alias("mean"))
    return varied.filter("v > 0").select("source", "n", F.round("mean", 6).alias("mean"))


def violations_of() -> Column:
    """Principles that responses (doc_id, r, profile) violate."""
    question = F.when(F.col("doc_id") % 2 == 0, "How many are there in total?").otherwise("Why?")
    pad = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 2)
    return S.harness_violations(F.concat("r", F.when(F.col("doc_id") % 20 == 6, "<tool>x(</tool><tool>y(</tool>").otherwise("")), question, S.tools_of(F.col("profile")), pad)


def f10_harness(spark: SparkSession, d: str) -> DataFrame:
    """Violated principles of every response."""
    rows = responses(spark, d)
    return rows.select("doc_id", F.array_join(violations_of(), ",").alias("violations"))


RULES = [
    ("think", 0, "length(regexp_extract(r, '(?is)<think>(.*?)</think>', 1)) > 80"),
    ("think", 1, "r rlike '(?i)<answer>'"),
    ("tools", 0, "NOT r rlike '<tool>'"),
    ("tools", 1, "r rlike 'web_search|get_datetime'"),
    ("words", 0, "lower(r) rlike '(depends|may|cannot)'"),
]


def f12_rules(spark: SparkSession, d: str) -> DataFrame:
    """Pass rates of a rule table: saved verdict where no rule is, replicated else; drift flagged."""
    rows = responses(spark, d).withColumns({"grp": F.expr("element_at(array('think', 'tools', 'words', 'other'), CAST(doc_id % 4 AS INT) + 1)"), "idx": F.expr("CAST(doc_id div 4 % 2 AS INT)")})
    verdict = S.rule_case(RULES, F.col("grp"), F.col("idx"))
    rows = rows.select("grp", "idx", verdict.alias("rule"), (F.col("doc_id") % 3 != 0).alias("saved"))
    out = rows.groupBy("grp").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("saved").cast("double")), 6).alias("saved_rate"), F.round(F.avg(F.coalesce("rule", "saved").cast("double")), 6).alias("replicated"),
        F.count_if(F.col("rule").isNull()).alias("fell_back"))
    return out.withColumn("drifts", F.abs(F.col("replicated") - F.col("saved_rate")) > 0.05)


def f15_f21_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """What a principle expects under a profile, and the tools it may use."""
    rows = responses(spark, d)
    pid = F.expr("element_at(array('P8_impossibility', 'P5_realtime_honesty', 'P4_math_code', 'P11_tool_avoidance', 'other'), CAST(doc_id % 5 AS INT) + 1)")
    web = F.array_contains(S.tools_of(F.col("profile")), "web_search")
    expected = F.when(pid == "P8_impossibility", "abstain").when(pid == "P5_realtime_honesty", F.when(web, "answer_tool").otherwise("abstain")).when(pid == "P4_math_code", "answer_tool").when(pid == "P11_tool_avoidance", "answer_knowledge")
    tools = S.tools_of(F.col("profile"), "all_tools")
    return rows.select("doc_id", expected.alias("expects"), F.array_join(tools, ",").alias("tools"), F.array_join(F.array_sort(F.array_except(S.strings(S.KNOWN), tools)), ",").alias("others"))


def x27_f6_appraisal(spark: SparkSession, d: str) -> DataFrame:
    """Appraisal vectors: valence, the three most extreme dimensions, a narrative, and whether they matter."""
    names = ["pleasantness", "unpleasantness", "goal_relevance", "coping_potential", "self_control", "urgency", "novelty"]
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    value = F.transform(F.slice("embedding", 1, len(names)), lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x.cast("double") * 1.5 + 0.5))), 4))
    rows = e.select("vec_id", F.map_from_arrays(S.strings(names), value).alias("m"), value.alias("v"))
    at = {n: F.col("m")[n] for n in names}
    placed = F.transform("v", lambda x, i: F.struct((-F.round(F.abs(x - 0.5), 4)).alias("far"), i.alias("i")))
    top = F.transform(F.slice(F.array_sort(placed), 1, 3), lambda t: F.get(S.strings(names), t["i"]))
    # Values have four decimals, so twice the valence is a whole number of ten-thousandths.
    tenths = lambda c: F.round(c * 10000).cast("long")
    valence = (tenths(at["pleasantness"]) + 10000 - tenths(at["unpleasantness"])) / 20000.0
    p, u, goal, cope, control = (at[n] for n in ("pleasantness", "unpleasantness", "goal_relevance", "coping_potential", "self_control"))
    story = (
        F.when((p > 0.7) & (goal > 0.6), "positive").when((u > 0.7) & (cope < 0.4), "distress").when((goal > 0.7) & (control < 0.4), "high_stakes").when((u > 0.6) & (control > 0.6), "capable").when((p < 0.4) & (goal > 0.6), "disappointed").otherwise("attentive")
    )
    return rows.select("vec_id", valence.cast("double").alias("valence"), F.array_join(top, ",").alias("top3"), story.alias("story"), ((F.abs(valence - 0.5) > 0.15) | (cope < 0.35) | (goal > 0.65)).alias("significant"))


def a21_loop(spark: SparkSession, d: str) -> DataFrame:
    """Completion, asking, steps, parsing, copy fidelity and accuracy of logged loops, by category."""
    r = F.col("r")
    rows = responses(spark, d).select("category", "expected", T.turn_kind(r).alias("kind"), F.size(T.call_bodies(r)).alias("acts"), F.size(F.filter(T.call_bodies(r), lambda b: F.get_json_object(T.call_arguments(b), "$.code").isNotNull())).alias("parsed"), T.last_number(T.user_facing(r)).alias("number"))
    math = F.col("category").isin(*S.MATH) & (F.col("expected") != "n/a")
    right = F.coalesce(T.numbers_match(F.col("number"), F.col("expected")), F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("category").agg(
        F.count("*").alias("n"), rate(F.coalesce(F.col("kind") == "answer", F.lit(False))).alias("completed"), rate(F.coalesce(F.col("kind") == "ask", F.lit(False))).alias("asked"), F.round(F.avg("acts"), 6).alias("steps"),
        F.round(F.sum("parsed") / F.greatest(F.sum("acts"), F.lit(1)), 6).alias("parse_rate"), F.count_if(math).alias("math_rows"), F.round(F.avg(F.when(math, right.cast("double"))), 6).alias("math_right"))


def x29_answer_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Answers per question under letters, in an order that a hash of question and condition fixes."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.expr("concat('q', user_id)").alias("question"), F.col("event_type").alias("label"), "value").groupBy("question", "label").agg(F.max("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.md5(F.concat_ws("|", "question", "label"))))
    sheet = e.withColumn("letter", F.char(F.lit(64) + place))
    return sheet.groupBy("question").agg(F.array_join(F.array_sort(F.collect_list(F.concat("letter", F.lit("="), "label"))), ",").alias("sheet"))


def e16_e19_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Critique verdicts, chosen candidates, structure flags, and inner calls kept when an answer tag is removed."""
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN 'VERDICT: pass' WHEN 1 THEN concat('verdict: FAIL', chr(10), 'issue: too short ', source) WHEN 2 THEN 'VERDICT: fail ISSUE: none' ELSE 'no idea' END")
    verdict = F.regexp_extract(raw, r"(?i)VERDICT:\s*(pass|fail)", 1)
    issue = T.strip(F.regexp_extract(raw, r"(?i)ISSUE:\s*(.+)", 1))
    found = F.when((F.lower(verdict) == "fail") & (issue != "") & (F.lower(issue) != "none"), issue)
    letter = F.expr("element_at(array('A', 'c', 'Z', ''), CAST(doc_id % 4 AS INT) + 1)")
    choice = F.when(letter == "", 1).otherwise(F.least(F.greatest(F.ascii(F.upper(letter)) - 64, F.lit(1)), F.lit(3)))
    r = F.col("r")
    bare = F.when(T.has_tag(r, "answer"), F.regexp_replace(r, r"(?is)</?answer>", "")).otherwise(r)
    return responses(spark, d).select("doc_id", found.alias("issue"), F.element_at(F.array("source", "lang", "profile"), choice.cast("int")).alias("picked"), T.opens(r, "think").alias("has_think"), T.opens(r, "answer").alias("has_answer"), F.md5(bare).alias("bare_md5"))


def e18_e21_replays(spark: SparkSession, d: str) -> DataFrame:
    """Empty reasoning and tool use per step of training, and the share of calls to known tools."""
    r = F.col("r")
    rows = responses(spark, d).select(F.expr("doc_id div 100").alias("step"), (T.think_length(r) < 10).alias("empty"), T.called_tools(r).alias("tools"))
    known = F.size(F.filter("tools", lambda t: F.array_contains(S.strings(S.KNOWN), t)))
    return rows.groupBy("step").agg(F.round(F.avg(F.col("empty").cast("double")), 6).alias("empty_rate"), F.round(F.avg(F.size("tools")), 6).alias("mean_calls"), F.sum(F.size("tools")).alias("calls"), F.sum(known).alias("known_calls"))


def g5_g6_latest(spark: SparkSession, d: str) -> DataFrame:
    """Sections of pads and memories: the latest write that no later reset undoes; aliases resolved, others refused."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    section = F.when(F.col("event_type") == "view", "notes").when(F.col("event_type") == "click", "tasks").when(F.col("event_type") == "signup", "5wh_state")
    last = e.filter("event_type = 'error' AND event_id % 10 = 0").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("reset"))
    writes = e.withColumn("section", section).filter("section IS NOT NULL").join(last, "user_id", "left")
    kept = writes.filter(F.col("reset").isNull() | (F.struct("ts", "event_id") > F.col("reset")))
    return kept.groupBy("user_id", "section").agg(F.max(F.struct("ts", "event_id", "value")).alias("w"), F.count("*").alias("writes")).select("user_id", "section", "w.event_id", "w.value", "writes")


def m10_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The three sections of a memory that a prompt touches most; identity always counts a little."""
    docs = documents(spark, d).select("doc_id", (F.col("doc_id") % 50).alias("user_id"), F.expr("concat('s', doc_id % 7)").alias("section"), "text")
    latest = docs.groupBy("user_id", "section").agg(F.max_by("text", "doc_id").alias("content"))
    prompts = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("user_id"), F.col("text").alias("prompt"))
    scored = latest.join(prompts, "user_id").withColumn("score", F.round(T.relevance(F.col("prompt"), F.col("content")), 6))
    scored = scored.withColumn("score", F.when(F.col("section") == "s0", F.greatest("score", F.lit(0.1))).otherwise(F.col("score")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "section"))
    return scored.withColumn("place", place).filter("place <= 3").select("user_id", "section", "score", F.col("place").cast("long").alias("place"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Belief nodes: one per customer, a few of each name, in sessions by segment."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("session"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'SKILL' ELSE 'GOAL' END").alias("label"), F.expr("concat('n', c_custkey div 30)").alias("name"),
        F.expr("concat(CASE WHEN c_custkey % 4 = 0 THEN 'likes long walks in ' ELSE 'likes short ' END, c_mktsegment, ' ', c_nationkey % 2)").alias("description"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'novice' WHEN c_custkey % 5 = 1 THEN 'Expert' ELSE '' END").alias("level"),
        F.expr("c_custkey % 17 = 0").alias("deprecated"), F.expr("c_custkey % 23 = 0").alias("contested"))


def j8_j9_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one session, label and name that contradict each other: another level, or few words in common."""
    n = _nodes(spark, d)
    old = n.filter("NOT deprecated").select("session", "label", "name", F.col("node_id").alias("old_id"), F.col("description").alias("old_text"), F.col("level").alias("old_level"))
    met = n.join(old, ["session", "label", "name"]).filter("node_id <> old_id")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    shared = F.size(F.array_intersect(words("description"), words("old_text"))) / F.size(F.array_union(words("description"), words("old_text")))
    reason = F.when((F.col("level") != "") & (F.col("old_level") != "") & (F.lower("level") != F.lower("old_level")), "level").when(shared < 0.4, "description")
    return met.select("node_id", "old_id", reason.alias("reason"), F.round(shared, 6).alias("overlap")).filter("reason IS NOT NULL")


def j10_g8_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between known nodes of the current view (neither deprecated nor contested), without loops."""
    now = _nodes(spark, d).filter("NOT deprecated AND NOT contested").select("node_id")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("a"), F.expr("o_orderkey % 1500").alias("b"), F.col("o_orderstatus").alias("kind")).filter("a <> b").distinct()
    edges = o.join(now.withColumnRenamed("node_id", "a"), "a", "left_semi").join(now.withColumnRenamed("node_id", "b"), "b", "left_semi")
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("a").alias("sources"), F.countDistinct("b").alias("targets"))


def m11_slots(spark: SparkSession, d: str) -> DataFrame:
    """Nodes for a prompt: slots in their order, ten in all per session."""
    n = _nodes(spark, d).filter("NOT deprecated AND NOT contested")
    slot = F.when(F.col("label") == "SKILL", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("session").orderBy(slot, "node_id"))
    return n.withColumn("place", place).filter("place <= 10").select("session", "label", "node_id", F.col("place").cast("long").alias("place"))


def j13_triples(spark: SparkSession, d: str) -> DataFrame:
    """A basic graph pattern as joins: customers of a nation, in a region, with an urgent order."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    n = spark.read.parquet(f"{d}/nation.parquet")
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = lambda df, s_, p, o_: df.select(F.expr(s_).alias("s"), F.lit(p).alias("p"), F.expr(o_).alias("o"))
    triples = t(c, "concat('c', c_custkey)", "from", "concat('n', c_nationkey)").unionByName(t(n, "concat('n', n_nationkey)", "in", "concat('r', n_regionkey)")).unionByName(t(o, "concat('c', o_custkey)", "ordered", "o_orderpriority")).distinct()
    of = lambda p, s_, o_: triples.filter(F.col("p") == p).select(F.col("s").alias(s_), F.col("o").alias(o_))
    found = of("from", "c", "n").join(of("in", "n", "r"), "n").join(of("ordered", "c", "priority").filter("priority = '1-URGENT'"), "c")
    return found.groupBy("r").agg(F.countDistinct("c").alias("customers"))


def j14_mock_search(spark: SparkSession, d: str) -> DataFrame:
    """A fixed corpus of a few entries by keyword: the first whose keyword the query has."""
    corpus = [("or", "hit one"), ("der", "hit two"), ("que", "hit three")]
    hit = F.lit("no results")
    for word, text in reversed(corpus):
        hit = F.when(F.contains(F.lower("text"), F.lit(word)), text).otherwise(hit)
    return documents(spark, d).groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        r1_r6_rewards, f25_groups, f10_harness, f12_rules, f15_f21_dimensions, x27_f6_appraisal, a21_loop, x29_answer_sheets, e16_e19_verdicts, e18_e21_replays,
        g5_g6_latest, m10_relevance, j8_j9_conflicts, j10_g8_graph, m11_slots, j13_triples, j14_mock_search,
    )
}

_CALLS = r"regexp_extract_all(r, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1)"
_TOOLS = rf"list_distinct(list_transform({_CALLS}, lambda c: json_extract_string(c, '$.name')) || regexp_extract_all(r, '<tool>(\w+)\(', 1))"
_ACTIVE = "CASE profile WHEN 'all_tools' THEN ['python_execute', 'web_search', 'read_url', 'get_datetime'] WHEN 'compute_only' THEN ['python_execute'] WHEN 'compute_and_search' THEN ['python_execute', 'web_search', 'read_url'] ELSE []::VARCHAR[] END"
_KNOWN = "[" + ", ".join(f"'{k}'" for k in S.KNOWN) + "]"
_MATH = "(" + ", ".join(f"'{k}'" for k in S.MATH) + ")"
_LAST = rf"coalesce(list_filter(list_transform(string_split(regexp_replace({s(body('answer'))}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {s('p')}), lambda p: p <> '')[-1], '')"
_GREEDY = "(" + ", ".join(f"'{k}'" for k in S.GREEDY) + ")"


def _match(number: str, expected: str = "expected") -> str:
    return f"coalesce(CASE WHEN try_cast({number} AS DOUBLE) IS NULL OR try_cast({expected} AS DOUBLE) IS NULL THEN {number} = {expected} ELSE abs(try_cast({number} AS DOUBLE) - try_cast({expected} AS DOUBLE)) / abs(try_cast({expected} AS DOUBLE)) < 0.01 END, false)"


def _number(of: str) -> str:
    return rf"regexp_extract_all(replace({of}, ',', ''), '[-+]?\d[\d,]*\.?\d*')[-1]"


_NODES = """nodes AS (SELECT c_custkey AS node_id, c_mktsegment AS session, CASE WHEN c_custkey % 3 = 0 THEN 'SKILL' ELSE 'GOAL' END AS label, concat('n', c_custkey // 30) AS name,
    concat(CASE WHEN c_custkey % 4 = 0 THEN 'likes long walks in ' ELSE 'likes short ' END, c_mktsegment, ' ', c_nationkey % 2) AS description, CASE WHEN c_custkey % 5 = 0 THEN 'novice' WHEN c_custkey % 5 = 1 THEN 'Expert' ELSE '' END AS level,
    c_custkey % 17 = 0 AS deprecated, c_custkey % 23 = 0 AS contested FROM customer)"""
_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"

SQL = {
    "r1_r6_rewards": rf"""WITH {RESPONSES_SQL},
        x AS (SELECT *, length({s(body('think'))}) AS n, regexp_matches(r, '(?i)<think>') AS ot, regexp_matches(r, '(?i)<answer>') AS oa, {_TOOLS} AS called, {_ACTIVE} AS active, {OUTPUT} AS output, {_LAST} AS last,
              regexp_extract_all(r, '(?s)code\s*=\s*"([^"]*)"\s*\)', 1) AS code, len(code) AS codes, len(list_filter(code, lambda c: length(trim(c)) < 5)) > 0 AS hollow,
              len(list_filter(regexp_extract_all(r, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), lambda b: json_extract_string(b, '$.name') = 'python_execute' AND length(trim(json_extract_string(b, '$.arguments.code'))) < 5)) > 0 AS hollow_call FROM responses),
        p AS (SELECT doc_id, (CASE WHEN NOT (ot AND oa) THEN 0 WHEN n = 0 THEN 0.15 WHEN n < 40 THEN 0.4 WHEN contains(r, 'CAPABILITY_CHECK') THEN 0.6 WHEN n < 100 THEN 0.75 ELSE 1 END)::DOUBLE AS format,
          (CASE WHEN category NOT IN {_MATH} THEN 0.5 WHEN codes = 0 THEN CASE WHEN {has('answer')} AND {_match(_number(body('answer')))} THEN 0.3 ELSE 0 END WHEN hollow THEN 0 WHEN {_match(_number('output'))} THEN 1 ELSE 0 END)::DOUBLE AS accuracy,
          (CASE WHEN len(list_filter(called, lambda t: NOT list_contains({_KNOWN}, t))) > 0 OR len(list_filter(called, lambda t: t IN ('python_execute', 'web_search', 'read_url', 'get_datetime') AND NOT list_contains(active, t))) > 0 THEN 0 ELSE 1 END)::DOUBLE AS tool_integrity,
          (CASE WHEN hollow OR hollow_call THEN 0 ELSE 1 END * (CASE WHEN category = 'real_time_data' AND len(list_intersect(active, ['get_datetime', 'web_search'])) > 0 AND len(list_intersect(called, list_intersect(active, ['get_datetime', 'web_search']))) = 0 THEN 0.1 ELSE 1 END)
            * (CASE WHEN category = 'user_context_behavioral' THEN 0.4 ELSE 1 END) * (CASE WHEN category = 'entity_facts_web_search' AND list_contains(active, 'web_search') AND NOT list_contains(called, 'web_search') THEN 0.05 ELSE 1 END)
            * (CASE WHEN category IN {_MATH} AND list_contains(active, 'python_execute') AND NOT list_contains(called, 'python_execute') THEN 0.2 ELSE 1 END))::DOUBLE AS tool_quality,
          (ot::INT + oa::INT) / 2.0::DOUBLE AS constitution,
          (CASE WHEN category NOT IN {_GREEDY} THEN 0.5 WHEN NOT {has('answer')} THEN 0 WHEN NOT ends_with(last, '?') THEN CASE WHEN contains({s(body('answer'))}, '?') THEN 0.3 ELSE 0 END
            WHEN regexp_matches(last, '{S.AXES}') OR regexp_matches(last, '{S.ABOUT_USER}') THEN 1 ELSE 0.7 END)::DOUBLE AS greedy_followup FROM x)
        SELECT *, round(0.2 * format + 0.35 * accuracy + 0.1 * tool_integrity + 0.15 * tool_quality + 0.1 * constitution + 0.1 * greedy_followup, 6)::DOUBLE AS reward_d, round((0.2 * format + 0.35 * accuracy) / 0.55, 6)::DOUBLE AS reward_c FROM p""",
    "f25_groups": rf"""WITH {RESPONSES_SQL}, x AS (SELECT source, length({s(body('think'))}) AS n, regexp_matches(r, '(?i)<think>') AND regexp_matches(r, '(?i)<answer>') AS ok, r FROM responses),
        y AS (SELECT source, (CASE WHEN NOT ok THEN 0 WHEN n = 0 THEN 0.15 WHEN n < 40 THEN 0.4 WHEN contains(r, 'CAPABILITY_CHECK') THEN 0.6 WHEN n < 100 THEN 0.75 ELSE 1 END)::DOUBLE AS v FROM x)
        SELECT source, count(*) AS n, round(avg(v), 6) AS mean FROM y GROUP BY 1 HAVING count(DISTINCT v) > 1""",
    "f10_harness": rf"""WITH {RESPONSES_SQL}, x AS (SELECT doc_id, {_ACTIVE} AS active, doc_id % 2 = 0 AS math, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 END AS pad, r || CASE WHEN doc_id % 20 = 6 THEN '<tool>x(</tool><tool>y(</tool>' ELSE '' END AS r FROM responses),
        y AS (SELECT *, regexp_extract_all(r, '<tool>(\w+)\(', 1) || regexp_extract_all(r, '"name"\s*:\s*"(\w+)"', 1) AS called, regexp_extract(r, '(?is)<think\b.*?</think>') AS think, {_LAST} AS last FROM x)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(r, '(?i)<think\b') THEN 'P1' END, CASE WHEN len(list_filter(called, lambda t: NOT list_contains({_KNOWN}, t))) > 0 THEN 'P3' END,
          CASE WHEN len(list_filter(called, lambda t: list_contains({_KNOWN}, t) AND NOT list_contains(active, t) AND regexp_matches(lower(think), t || '\s+not\s+available'))) > 0 THEN 'P3_unavailable' END,
          CASE WHEN list_contains(active, 'python_execute') AND math AND NOT regexp_matches(r, '<tool>\s*python_execute|"name"\s*:\s*"python_execute"') AND regexp_matches(r, '(?s)<answer>.*\d[\d,.]+.*</answer>') THEN 'P4' END,
          CASE WHEN NOT regexp_matches(r, '(?i)<answer\b') THEN 'P18' END, CASE WHEN length(think) >= 20 AND NOT regexp_matches(think, '{S.FIRST_PRINCIPLES}') THEN 'P20' END,
          CASE WHEN {has('answer')} AND NOT (ends_with(last, '?') AND (regexp_matches(last, '{S.AXES}') OR regexp_matches(last, '{S.ABOUT_USER}'))) THEN 'P21' END,
          CASE WHEN pad IS NOT NULL AND len(regexp_extract_all(r, '<tool>')) - len(regexp_extract_all(r, '<tool>scratchpad_')) >= 3 AND NOT regexp_matches(r, '<tool>\s*scratchpad_read') THEN 'P24a' END,
          CASE WHEN pad > 0 AND regexp_matches(r, '(?i)<answer\b') THEN 'P24b' END], lambda v: v IS NOT NULL), ',') AS violations FROM y""",
    "f12_rules": rf"""WITH {RESPONSES_SQL}, x AS (SELECT ['think', 'tools', 'words', 'other'][doc_id % 4 + 1] AS grp, doc_id // 4 % 2 AS idx, doc_id % 3 <> 0 AS saved, r FROM responses),
        y AS (SELECT grp, saved, CASE WHEN grp = 'think' AND idx = 0 THEN length({body('think')}) > 80 WHEN grp = 'think' THEN regexp_matches(r, '(?i)<answer>') WHEN grp = 'tools' AND idx = 0 THEN NOT contains(r, '<tool>')
          WHEN grp = 'tools' THEN regexp_matches(r, 'web_search|get_datetime') WHEN grp = 'words' AND idx = 0 THEN regexp_matches(lower(r), '(depends|may|cannot)') END AS rule FROM x),
        z AS (SELECT grp, count(*) AS n, round(avg(saved::INT), 6) AS saved_rate, round(avg(coalesce(rule, saved)::INT), 6) AS replicated, count(*) FILTER (rule IS NULL) AS fell_back FROM y GROUP BY 1) SELECT *, abs(replicated - saved_rate) > 0.05 AS drifts FROM z""",
    "f15_f21_dimensions": f"""WITH {RESPONSES_SQL}, x AS (SELECT doc_id, profile, {_ACTIVE} AS t FROM responses)
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN CASE WHEN profile IN ('all_tools', 'compute_and_search') THEN 'answer_tool' ELSE 'abstain' END WHEN 2 THEN 'answer_tool' WHEN 3 THEN 'answer_knowledge' END AS expects,
          array_to_string(t, ',') AS tools, array_to_string(list_sort(list_filter({_KNOWN}, lambda k: NOT list_contains(t, k))), ',') AS others FROM x""",
    "x27_f6_appraisal": """WITH v AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, x::DOUBLE * 1.5 + 0.5)), 4)) AS v FROM embeddings),
        n AS (SELECT vec_id, i, ['pleasantness', 'unpleasantness', 'goal_relevance', 'coping_potential', 'self_control', 'urgency', 'novelty'][i] AS name, v[i] AS x FROM v, unnest(range(1, 8)) AS u(i)),
        t AS (SELECT vec_id, string_agg(name, ',' ORDER BY k) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(x - 0.5), 4) DESC, i) AS k FROM n) WHERE k <= 3 GROUP BY 1),
        w AS (SELECT vec_id, v[1] AS p, v[2] AS u, v[3] AS g, v[4] AS c, v[5] AS s, (round(v[1] * 10000)::BIGINT + 10000 - round(v[2] * 10000)::BIGINT) / 20000.0::DOUBLE AS valence FROM v)
        SELECT vec_id, valence, top3, CASE WHEN p > 0.7 AND g > 0.6 THEN 'positive' WHEN u > 0.7 AND c < 0.4 THEN 'distress' WHEN g > 0.7 AND s < 0.4 THEN 'high_stakes' WHEN u > 0.6 AND s > 0.6 THEN 'capable' WHEN p < 0.4 AND g > 0.6 THEN 'disappointed' ELSE 'attentive' END AS story,
          (abs(valence - 0.5) > 0.15 OR c < 0.35 OR g > 0.65) AS significant FROM w JOIN t USING (vec_id)""",
    "a21_loop": rf"""WITH {RESPONSES_SQL}, x AS (SELECT *, {_CALLS} AS calls, {USER} AS a, CASE WHEN {has('ask')} THEN length(regexp_extract(r, '(?is)^(.*?)<ask>.*?</ask>', 1)) END AS p1, CASE WHEN {has('act')} THEN length(regexp_extract(r, '(?is)^(.*?)<act>.*?</act>', 1)) END AS p2,
            CASE WHEN {has('answer')} THEN length(regexp_extract(r, '(?is)^(.*?)<answer>.*?</answer>', 1)) END AS p3 FROM responses),
        y AS (SELECT *, category IN {_MATH} AND expected <> 'n/a' AS math, {_match(_number('a'))} AS ok, len(list_filter(calls, lambda c: json_extract_string(c, '$.arguments.code') IS NOT NULL)) AS parsed FROM x)
        SELECT category, count(*) AS n, round(avg(coalesce(p3 = least(p1, p2, p3), false)::INT), 6) AS completed, round(avg(coalesce(p1 = least(p1, p2, p3), false)::INT), 6) AS asked, round(avg(len(calls)), 6) AS steps,
          round((sum(parsed) / greatest(sum(len(calls)), 1))::DOUBLE, 6) AS parse_rate, count(*) FILTER (math) AS math_rows, round(avg(ok::INT) FILTER (math), 6) AS math_right FROM y GROUP BY 1""",
    "x29_answer_sheets": """WITH l AS (SELECT DISTINCT concat('q', user_id) AS question, event_type AS label FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY md5(concat(question, '|', label))) AS k FROM l)
        SELECT question, string_agg(concat(chr((64 + k)::INT), '=', label), ',' ORDER BY k) AS sheet FROM o GROUP BY 1""",
    "e16_e19_verdicts": rf"""WITH {RESPONSES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN concat('too short ', source) END AS issue, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN profile WHEN 2 THEN profile ELSE source END AS picked,
        regexp_matches(r, '(?i)<think>') AS has_think, regexp_matches(r, '(?i)<answer>') AS has_answer, md5(CASE WHEN {has('answer')} THEN regexp_replace(r, '(?i)</?answer>', '', 'g') ELSE r END) AS bare_md5 FROM responses""",
    "e18_e21_replays": rf"""WITH {RESPONSES_SQL}, x AS (SELECT doc_id // 100 AS step, length({s(body('think'))}) < 10 AS empty, {_TOOLS} AS t FROM responses)
        SELECT step, round(avg(empty::INT), 6) AS empty_rate, round(avg(len(t)), 6) AS mean_calls, sum(len(t))::BIGINT AS calls, sum(len(list_filter(t, lambda k: list_contains({_KNOWN}, k))))::BIGINT AS known_calls FROM x GROUP BY 1""",
    "g5_g6_latest": """WITH z AS (SELECT user_id, max(row(ts, event_id)) AS reset FROM events WHERE event_type = 'error' AND event_id % 10 = 0 GROUP BY 1),
        w AS (SELECT e.*, CASE event_type WHEN 'view' THEN 'notes' WHEN 'click' THEN 'tasks' WHEN 'signup' THEN '5wh_state' END AS section FROM events e LEFT JOIN z USING (user_id) WHERE event_type IN ('view', 'click', 'signup') AND (reset IS NULL OR row(ts, event_id) > reset))
        SELECT user_id, section, event_id, value, count(*) OVER (PARTITION BY user_id, section) AS writes FROM w QUALIFY row_number() OVER (PARTITION BY user_id, section ORDER BY ts DESC, event_id DESC) = 1""",
    "m10_relevance": rf"""WITH l AS (SELECT doc_id % 50 AS user_id, concat('s', doc_id % 7) AS section, max_by(text, doc_id) AS content FROM documents GROUP BY 1, 2),
        w AS (SELECT user_id, section, list_distinct(list_filter(regexp_extract_all(lower(b.text), '\w+'), lambda x: NOT list_contains({_STOPS}, x))) AS a, list_distinct(regexp_extract_all(lower(content), '\w+')) AS c FROM l JOIN benchmark b ON b.item_id = user_id),
        q AS (SELECT user_id, section, round(CASE WHEN len(a) = 0 THEN 0.5 ELSE len(list_intersect(a, c)) / len(a) END, 6) AS score FROM w),
        z AS (SELECT user_id, section, CASE WHEN section = 's0' THEN greatest(score, 0.1) ELSE score END::DOUBLE AS score FROM q)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, section) AS place FROM z QUALIFY place <= 3""",
    "j8_j9_conflicts": rf"""WITH {_NODES}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(description), '\S+')) AS ws FROM nodes),
        m AS (SELECT a.node_id, b.node_id AS old_id, a.level AS l1, b.level AS l2, len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) AS o FROM w a JOIN w b USING (session, label, name) WHERE a.node_id <> b.node_id AND NOT b.deprecated),
        r AS (SELECT node_id, old_id, CASE WHEN l1 <> '' AND l2 <> '' AND lower(l1) <> lower(l2) THEN 'level' WHEN o < 0.4 THEN 'description' END AS reason, round(o, 6) AS overlap FROM m) SELECT * FROM r WHERE reason IS NOT NULL""",
    "j10_g8_graph": f"""WITH {_NODES}, n AS (SELECT node_id FROM nodes WHERE NOT deprecated AND NOT contested), e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 1500 AS b, o_orderstatus AS kind FROM orders)
        SELECT kind, count(*) AS edges, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e WHERE a <> b AND a IN (SELECT node_id FROM n) AND b IN (SELECT node_id FROM n) GROUP BY 1""",
    "m11_slots": f"""WITH {_NODES} SELECT session, label, node_id, row_number() OVER (PARTITION BY session ORDER BY label = 'GOAL', node_id) AS place FROM nodes WHERE NOT deprecated AND NOT contested QUALIFY place <= 10""",
    "j13_triples": """SELECT concat('r', n_regionkey) AS r, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1""",
    "j14_mock_search": """SELECT CASE WHEN contains(lower(text), 'or') THEN 'hit one' WHEN contains(lower(text), 'der') THEN 'hit two' WHEN contains(lower(text), 'que') THEN 'hit three' ELSE 'no results' END AS hit, count(*) AS n FROM documents GROUP BY 1""",
}
