"""Reports and their parts: rendering, matching, sampling, catalogues, acceptance of rows, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.functions.hashing import digest, pick, uniform
from millrace.operators import ranking as K
from millrace.plans.fixtures import MESSAGES_SQL, RESPONSES_SQL, SCORES_SQL, documents, messages, responses, scores
from millrace.plans.q_evaluation import _PER_Q, _per_question, w3_a13_head_to_head
from millrace.plans.q_parse import body, has, s


def _r(c, n=6):
    return F.round(c, n)


def p22_p23_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects and arrays cut greedily out of noise, and questions of three forms as rows."""
    noisy = F.concat(F.lit("here: {\"a\": "), F.col("doc_id").cast("string"), F.lit(", \"b\": {\"c\": \""), "source", F.lit("\"}} bye"))
    found = F.regexp_extract(noisy, r"(?s)\{.*\}", 0)
    item = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('"', source, '"') WHEN 1 THEN concat('{"question": "', source, '", "follow_up": "', lang, '"}') ELSE concat('{"turns": ["', source, '", "', lang, '"]}') END""")
    q = F.col("item")
    kind = F.when(F.startswith(q, F.lit('"')), "single_turn").when(F.get_json_object(q, "$.turns").isNotNull(), "multi_turn").otherwise("two_turn")
    first = F.coalesce(F.get_json_object(q, "$.question"), F.get_json_object(q, "$.turns[0]"), F.regexp_extract(q, '^"(.*)"$', 1))
    rows = documents(spark, d).select("doc_id", found.alias("found"), item.alias("item"))
    return rows.select("doc_id", F.get_json_object("found", "$.a").alias("a"), F.get_json_object("found", "$.b.c").alias("c"), kind.alias("form"), first.alias("question"), F.coalesce(F.get_json_object(q, "$.follow_up"), F.get_json_object(q, "$.turns[1]")).alias("second"))


def p30_appraisal_block(spark: SparkSession, d: str) -> DataFrame:
    """An appraisal block written from fields and parsed again."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", (F.floor("value") % 100 / 100).alias("v"))
    block = F.concat(F.lit("<appraisal>\nemotion: "), "event_type", F.lit("\nvalence: "), F.format_number("v", 2), F.lit("\n</appraisal>"))
    inner = T.strip(T.tag_body(block, "appraisal"))
    parsed = F.str_to_map(inner, F.lit("\n"), F.lit(": "))
    return e.select("event_id", parsed["emotion"].alias("emotion"), parsed["valence"].cast("double").alias("valence"), F.size(parsed).cast("long").alias("n"))


def p34_x24_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as numbered turns, as a joined question, and as a transcript of clipped turns."""
    m = messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    user = F.filter("m", lambda x: x["role"] == "user")
    turns = F.array_join(F.transform(user, lambda x, i: F.concat(F.lit("(turn "), (i + 1).cast("string"), F.lit(") "), x["content"])), " | ")
    script = F.array_join(F.transform("m", lambda x: F.concat(F.upper(x["role"]), F.lit(": "), F.left(x["content"], F.lit(200)))), "\n")
    return m.select("conv_id", F.md5(turns).alias("turns_md5"), F.md5(F.array_join(F.transform(user, lambda x: x["content"]), " ")).alias("question_md5"), F.md5(script).alias("script_md5"))


def p35_p37_cells(spark: SparkSession, d: str) -> DataFrame:
    """Scores by a chain of fallbacks, tools from trace and tags without repeats, first output that isn't empty."""
    r = responses(spark, d)
    score = F.coalesce(F.when(F.col("doc_id") % 4 == 0, 0.9), F.when(F.col("doc_id") % 4 == 1, 0.7), F.when(F.col("doc_id") % 4 == 2, (F.col("doc_id") % 3 == 0).cast("double")))
    trace = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("read_url"), F.lit("read_url"))).otherwise(F.array().cast("array<string>"))
    tools = F.concat(trace, F.array_except(T.called_tools(F.col("r")), trace))
    out = F.coalesce(F.nullif(F.when(F.col("doc_id") % 3 == 0, "source").otherwise(F.lit("")), F.lit("")), F.when(F.col("doc_id") % 3 == 1, F.col("lang")), F.lit("none"))
    out = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(out)
    return r.select("doc_id", score.cast("double").alias("score"), F.array_join(tools, ",").alias("tools"), out.alias("output"))


def p40_g7_pads(spark: SparkSession, d: str) -> DataFrame:
    """A status line from a pad's tasks and unknowns; facts of a session, each once, in order."""
    tasks = F.concat_ws("\n", F.concat(F.lit("1. read "), "source"), F.lit("note"), F.concat(F.lit(" 2. write "), "lang"), F.lit("3. check"), F.lit("4. send"), F.lit("5. rest"))
    lines = F.filter(F.transform(F.split(tasks, "\n"), T.strip), lambda x: x.rlike("^[0-9]"))
    status = F.array_join(F.transform(F.slice(lines, 1, 4), lambda x: F.left(x, F.lit(45))), " | ")
    unknown = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" | Unknown: "), "lang")).otherwise("")
    docs = documents(spark, d)
    facts = docs.groupBy("lang").agg(F.min(F.struct("doc_id")).alias("x"), F.array_sort(F.collect_set("source")).alias("facts"))
    rows = docs.select("doc_id", "lang", F.concat(F.lit("[TASKS: "), status, unknown, F.lit("]")).alias("status"))
    return rows.join(facts.select("lang", F.array_join("facts", ";").alias("facts")), "lang")


def x5_x10_native(spark: SparkSession, d: str) -> DataFrame:
    """XML calls as native ones with reproducible ids, and a histogram of schemas by profile beside each row."""
    r = responses(spark, d).select("doc_id", "profile", F.posexplode(T.xml_tool_names(F.col("r"))).alias("k", "tool"))
    schema = F.to_json(F.struct(F.lit("function").alias("type"), F.col("tool").alias("name")))
    call = F.concat(F.lit("call_"), F.left(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("k").cast("string"))), F.lit(8)))
    n = r.groupBy("profile").agg(F.count("*").alias("of_profile"))
    return r.select("doc_id", "profile", F.col("k").cast("long").alias("k"), call.alias("call_id"), schema.alias("schema")).join(F.broadcast(n), "profile")


def x11_x12_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates with variables: arrays of one length share an index drawn by a hash; fractional duplicates."""
    docs = documents(spark, d).select("doc_id", "source")
    names, places = F.array(F.lit("Ann"), F.lit("Bo"), F.lit("Cy")), F.array(F.lit("Rome"), F.lit("Oslo"), F.lit("Lima"))
    i = pick(3, "x12", F.col("doc_id")).cast("int")
    v = F.map_from_arrays(F.array(F.lit("name"), F.lit("place"), F.lit("src")), F.array(F.get(names, i), F.get(places, i), "source"))
    text = F.aggregate(F.map_entries(v), F.lit("{name} of {place} asks {src}: {name}?"), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    copies = F.when(uniform("x7", F.col("doc_id")) < 0.25, 2).otherwise(1)
    return docs.select("doc_id", text.alias("text"), copies.cast("long").alias("copies"))


def x22_e9_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are built or refused: branch by kind of turn, math rows by execution, refusals, asks."""
    r = F.col("r")
    kind = T.clean_turn_kind(r)
    n = T.think_length(r)
    branch = F.when(kind.isNull(), "rejected").when(kind == "ask", F.when(F.regexp_count(T.strip(T.tag_body(r, "ask")), F.lit(r"\?")) == 1, "B").otherwise("rejected")).otherwise("B_negative")
    printed = F.when(F.col("doc_id") % 2 == 0, F.lit("42"))
    ran = T.last_number(printed)
    math = F.when(F.size(T.code_blocks(r)) == 0, "no_code").when(printed.isNull(), "failed").when(F.coalesce(T.numbers_match(ran, F.col("expected")), F.lit(False)), "accepted").otherwise("wrong")
    refusal = (n >= 150) & T.has_tag(r, "answer") & ~F.contains(r, F.lit("```"))
    forced = (kind != "answer") & (n == 0)
    size = F.when(branch == "B", 5).when(branch == "B_negative", 3).otherwise(0)
    return responses(spark, d).select("doc_id", branch.alias("branch"), size.cast("long").alias("messages"), math.alias("math"), refusal.alias("e10_refusal"), F.coalesce(forced, F.lit(False)).alias("f26_retry"))


def f13_f23_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per category: rows by a rule that only some have, tool use that fits, languages without any tool."""
    r = responses(spark, d).select("category", "lang", "profile", T.called_tools(F.col("r")).alias("tools"))
    rule = F.when(F.col("category").isin(*S.MATH), F.array_contains("tools", "python_execute"))
    fits = F.when(F.col("profile") == "no_tools", F.size("tools") == 0).otherwise(F.size("tools") > 0)
    return r.groupBy("category").agg(F.count("*").alias("n"), _r(F.avg(rule.cast("double"))).alias("rule_rate"), F.count_if(fits).alias("fits"), (~F.bool_or(F.size("tools") > 0)).alias("no_harness"), F.count_if(F.size("tools") > 1).alias("mania"))


def j5_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Saved results matched to definitions: by text, else by index; expectations beside them."""
    docs = documents(spark, d).select("doc_id", "source", F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string")).alias("text"), (F.col("doc_id") % 25).alias("idx"))
    table = spark.range(0, 30).select(F.col("id").alias("def_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("def_text"), F.col("id").alias("def_idx"))
    # Thirty definitions.
    by_text = F.broadcast(table.filter("def_text IS NOT NULL").select(F.col("def_text").alias("text"), F.col("def_id").alias("by_text")))
    by_idx = F.broadcast(table.select(F.col("def_idx").alias("idx"), F.col("def_id").alias("by_idx")))
    met = docs.join(by_text, "text", "left").join(by_idx, "idx", "left")
    return met.select("doc_id", F.coalesce("by_text", "by_idx").alias("def_id"), F.col("by_text").isNotNull().alias("exact"))


def a12_a34_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over judged items only, rates over all, pending judgements, retries, gaps between modes, per condition."""
    x = scores(spark, d)
    judged = F.col("judge_score")
    return x.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if(judged.isNull()).alias("a29_pending"),
        _r(F.avg(judged)).alias("a26_degradation"),
        _r(F.avg((F.coalesce(judged, F.col("rule_score")) >= 0.5).cast("double"))).alias("a17_pass_rate"),
        _r(F.avg(F.when(F.col("suite") == "drift", F.col("rule_score")))).alias("a12_drift"),
        _r(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("rule_score"))) - F.avg(F.when(F.col("event_id") % 2 == 1, F.col("rule_score")))).alias("a30_gap"),
        _r(F.avg((F.col("event_id") % 3).cast("double")), 1).alias("a19_retries"),
        _r(F.avg((F.col("rule_score") > 0.8).cast("double"))).alias("a32_verified"),
    )


def a15_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """How often each condition is best, by suite; of those level the first by name."""
    best = _per_question(spark, d).groupBy("suite", "item").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("best"))
    return best.groupBy("best", "suite").agg(F.count("*").alias("n"))


def a20_a28_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Runs by day with their span, latency and speed; wins and losses of principles between two halves."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day"), "event_type", "value", "event_id")
    half = F.col("event_id") % 2
    per = e.groupBy("day", "event_type").agg(F.avg(F.when(half == 0, F.col("value"))).alias("a"), F.avg(F.when(half == 1, F.col("value"))).alias("b"), F.count("*").alias("n"), F.sum("value").alias("total"))
    gap = _r(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    return per.groupBy("day").agg(F.sum("n").alias("n"), _r(F.sum("total"), 3).alias("total"), F.count_if(gap > 0.05).alias("wins"), F.count_if(gap < -0.05).alias("losses"), _r(F.avg(gap)).alias("mean_gap"))


def a22_a24_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Parsing, choice of tool and exact copies by profile; rates over all rows, or over those without errors."""
    r = F.col("r")
    first = F.get(T.call_bodies(r), F.lit(0))
    x = responses(spark, d).select("profile", "n_chars", T.call_name(first).alias("name"), F.get_json_object(T.call_arguments(first), "$.code").alias("code"), F.expr("concat('print(', doc_id, ')')").alias("gold"), T.opens(r, "think").alias("think"), T.opens(r, "answer").alias("answer"))
    wrong = F.coalesce(F.col("name") == "teleport", F.lit(False))
    return x.groupBy("profile").agg(
        _r(F.avg(F.col("name").isNotNull().cast("double"))).alias("parse_rate"), _r(F.avg(F.coalesce(F.col("name") == "python_execute", F.lit(False)).cast("double"))).alias("tool_rate"), _r(F.avg(F.coalesce(F.col("code") == F.col("gold"), F.lit(False)).cast("double"))).alias("exact_rate"),
        _r(F.avg(F.when(~wrong, F.col("think").cast("double")))).alias("think_rate"), _r(F.avg(F.when(~wrong, F.col("answer").cast("double")))).alias("answer_rate"), F.count_if(wrong).alias("errors"))


def t10_rank_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of head-to-head means: questions resampled, one resample for all conditions; the point first recomputed."""
    reps = 100
    credit = K.beat_credit(K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score"), ["suite", "item"]).select("item", "label", "credit")
    # Items of one condition, in one order for all: hundreds.
    per = credit.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("item", "credit"))).alias("x"))
    n = F.size("x")
    rep = per.select("label", "x", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("x"), pick(n, "t10", F.col("rep"), i).cast("int"))["credit"]), F.lit(0.0), lambda a, v: a + v)
    means = rep.select("label", (total / n).alias("m"), (F.aggregate("x", F.lit(0.0), lambda a, v: a + v["credit"]) / n).alias("point"))
    placed = means.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("m")) - 1)
    at = lambda i: F.max(F.when(F.col("at") == i, F.col("m")))
    return placed.groupBy("label").agg(_r(F.first("point")).alias("h2h"), _r(at(2)).alias("lo"), _r(at(97)).alias("hi"), _r(F.avg((F.col("m") <= 0.5).cast("double"))).alias("share_below"))


def t10_rank_intervals(spark: SparkSession, d: str, reps: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """Intervals of head-to-head means (b is null) and of their differences between any two conditions, from the same resamples of questions; whether the point is that of the head-to-head table."""
    ranked = K.beat_credit(K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score"), ["suite", "item"])
    # Questions are hundreds; each resample is dealt out as counts per question.
    table = ranked.agg(F.array_sort(F.collect_set(F.struct("suite", "item"))).alias("all"))
    draws = table.select(F.size("all").alias("size")).crossJoin(spark.range(reps).select(F.col("id").alias("rep")))
    drawn = draws.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: pick(F.col("size"), "t10", F.col("rep"), k))).alias("q")).groupBy("rep", "q").agg(F.count("*").alias("times"))
    numbered = table.select(F.posexplode("all").alias("q", "of")).select(F.col("q").cast("long").alias("q"), "of.suite", "of.item")
    credit = ranked.join(numbered, ["suite", "item"]).select("q", "label", "credit")
    means = drawn.join(F.broadcast(credit), "q").groupBy("rep", "label").agg((F.sum(F.col("times") * F.col("credit")) / F.sum("times")).alias("m"))
    points = credit.groupBy("label").agg(F.avg("credit").alias("point"))
    saved = w3_a13_head_to_head(spark, d).filter("suite IS NULL").select("label", "h2h")
    points = points.join(saved, "label").select("label", "point", (F.abs(F.col("point") - F.col("h2h")) <= 1e-3).alias("reproduced"))
    m, other = (means.select("rep", F.col("label").alias(c), F.col("m").alias(f"v_{c}")) for c in ("a", "b"))
    single = m.select("a", F.lit(None).cast("string").alias("b"), F.col("v_a").alias("v"))
    pairs = m.join(other, "rep").filter("a < b").select("a", "b", (F.col("v_a") - F.col("v_b")).alias("v"))
    at = F.row_number().over(Window.partitionBy("a", "b").orderBy("v")) - 1
    placed = single.unionByName(pairs).select("a", "b", F.round("v", 9).alias("v")).withColumn("at", at).withColumn("of", F.count("*").over(Window.partitionBy("a", "b")))
    spot = lambda share: F.max(F.when(F.col("at") == F.least(F.floor(F.lit(share) * F.col("of") + 1e-9), F.col("of") - 1), F.col("v")))
    ends = placed.groupBy("a", "b").agg(_r(spot(alpha / 2)).alias("lo"), _r(spot(1 - alpha / 2)).alias("hi"), _r(F.avg((F.col("v") <= 0).cast("double"))).alias("share"))
    left = points.select(F.col("label").alias("a"), F.col("point").alias("pa"), F.col("reproduced").alias("ra"))
    right = points.select(F.col("label").alias("b"), F.col("point").alias("pb"), F.col("reproduced").alias("rb"))
    out, two = ends.join(left, "a").join(right, "b", "left"), F.col("b").isNotNull()
    return out.select("a", "b", _r(F.col("pa") - F.coalesce("pb", F.lit(0.0))).alias("point"), "lo", "hi", F.when(two, F.col("share")).alias("share_le_0"), F.when(two, ~((F.col("lo") <= 0) & (F.col("hi") >= 0))).alias("separated"), (F.col("ra") & F.coalesce("rb", F.lit(True))).alias("reproduced"))


def m2_m15_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs kept once, ids of two runs in order of first sight, and tokens in common."""
    docs = documents(spark, d).select("doc_id", "lang", "source")
    pairs = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    shared = F.size(F.array_intersect(F.split("lang", ""), F.split("source", "")))
    return pairs.select("lang", "source", "first", "copies", F.row_number().over(Window.partitionBy("lang").orderBy("first")).cast("long").alias("nth"), shared.cast("long").alias("shared"))


def g3_retries(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a logged retry loop: the first clean one, else the last of three."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value", F.expr("event_id div 500").alias("turn"))
    w = Window.partitionBy("user_id", "turn").orderBy("event_id")
    tries = e.withColumn("attempt", F.row_number().over(w)).filter("attempt <= 3").withColumn("clean", F.col("value") < 30)
    out = tries.groupBy("user_id", "turn").agg(F.min_by("event_id", F.struct(~F.col("clean"), F.when(F.col("clean"), F.col("attempt")).otherwise(-F.col("attempt")))).alias("event_id"), F.bool_or("clean").alias("compliant"), F.count("*").alias("attempts"))
    return out


def e1_e4_gold(spark: SparkSession, d: str) -> DataFrame:
    """A blind gold sample: three answers per principle by hash, ids that tell nothing, hand-typed scores read back."""
    x = scores(spark, d).select("event_id", "principle", "item", "rule_score")
    place = F.row_number().over(Window.partitionBy("principle").orderBy(digest("gold", F.col("event_id")), "event_id"))
    typed = F.expr("element_at(array('0.5', ' 1 ', '', 'n/a'), CAST(event_id % 4 AS INT) + 1)")
    score = F.trim(typed).try_cast("double")
    return x.withColumn("place", place).filter("place <= 3").select("event_id", "principle", F.left(F.md5(F.concat_ws("|", "item", F.col("event_id").cast("string"))), F.lit(8)).alias("gold_id"), score.alias("human"), score.isNotNull().alias("scored"))


def s9_s17_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Held-out questions without their memory block, gold calls that parse, utterances long enough, pairs of runs by label."""
    first = F.concat(F.lit("[USER MEMORY]\nx\n[/USER MEMORY]\n\n"), "text")
    bare = T.strip(F.regexp_replace(first, r"(?s)^\[USER MEMORY\].*?\[/USER MEMORY\]", ""))
    docs = documents(spark, d).filter(F.length("text") > 20)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(digest("s15", F.col("doc_id"))))
    label = F.element_at(F.split(F.concat(F.lit("models/run/"), F.col("source"), F.lit("/")), "/"), -2)
    return docs.select("doc_id", "lang", F.md5(bare).alias("question_md5"), label.alias("p42_label"), (F.col("source").isin("src0", "src1")).alias("s9_pair"), place.alias("place")).filter("place <= 25").drop("place")


def x28_x30_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Corrective prompts from violations, adaptations from rates, rubrics with an expectation where there is one."""
    codes = F.expr("CASE doc_id % 3 WHEN 0 THEN array('P1', 'P18') WHEN 1 THEN array('P3') ELSE CAST(array() AS ARRAY<STRING>) END")
    prompt = F.when(F.size(codes) == 0, "").otherwise(F.concat(F.lit("Fix: "), F.array_join(F.transform(codes, lambda c: F.concat(F.lit("- "), c)), "\n")))
    notes = spark.createDataFrame([("en", "be brief"), ("fr", "be kind")], "lang string, note string")
    docs = documents(spark, d).select("doc_id", "lang", prompt.alias("prompt"))
    return docs.join(F.broadcast(notes), "lang", "left").select("doc_id", "prompt", F.concat(F.lit("rubric"), F.coalesce(F.concat(F.lit(" | expected: "), "note"), F.lit(""))).alias("rubric"))


QUERIES = {
    f.__name__: f
    for f in (
        p22_p23_json, p30_appraisal_block, p34_x24_rendering, p35_p37_cells, p40_g7_pads, x5_x10_native, x11_x12_templates, x22_e9_rows, f13_f23_checks, j5_rescore, a12_a34_means, a15_leaderboard,
        a20_a28_catalogue, a22_a24_ablation, t10_rank_bootstrap, t10_rank_intervals, m2_m15_sets, g3_retries, e1_e4_gold, s9_s17_seeds, x28_x30_prompts,
    )
}

_CALLS = r"regexp_extract_all(r, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1)"
_TOOLS = rf"list_transform({_CALLS}, lambda c: json_extract_string(c, '$.name')) || regexp_extract_all(r, '<tool>(\w+)\(', 1)"
_MATH = "(" + ", ".join(f"'{k}'" for k in S.MATH) + ")"
_S = f"WITH {SCORES_SQL.replace('/ 10.0', '/ 10.0::DOUBLE')}"


def _h(seed: str, of: str) -> str:
    return f"('0x' || substr(md5(concat('{seed}|', {of})), 1, 8))::BIGINT"


SQL = {
    "p22_p23_json": """SELECT doc_id, doc_id::VARCHAR AS a, source AS c, CASE doc_id % 3 WHEN 0 THEN 'single_turn' WHEN 1 THEN 'two_turn' ELSE 'multi_turn' END AS form, source AS question, CASE WHEN doc_id % 3 > 0 THEN lang END AS second FROM documents""",
    "p30_appraisal_block": "SELECT event_id, event_type AS emotion, floor(value)::BIGINT % 100 / 100.0::DOUBLE AS valence, 2::BIGINT AS n FROM events",
    "p34_x24_rendering": f"""WITH {MESSAGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY pos, content) AS k FROM messages)
        SELECT conv_id, md5(coalesce(string_agg(concat('(turn ', k, ') ', content), ' | ' ORDER BY pos) FILTER (role = 'user'), '')) AS turns_md5, md5(coalesce(string_agg(content, ' ' ORDER BY pos) FILTER (role = 'user'), '')) AS question_md5,
          md5(string_agg(concat(upper(role), ': ', left(content, 200)), chr(10) ORDER BY pos, role, content)) AS script_md5 FROM n GROUP BY 1""",
    "p35_p37_cells": f"""WITH {RESPONSES_SQL}, t AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN ['read_url', 'read_url'] ELSE []::VARCHAR[] END AS trace, {_TOOLS} AS tools FROM responses)
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN (doc_id % 3 = 0)::INT END::DOUBLE AS score, array_to_string(trace || list_filter(tools, lambda x: NOT list_contains(trace, x)), ',') AS tools,
          CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE 'none' END AS output FROM t""",
    "p40_g7_pads": """WITH f AS (SELECT lang, string_agg(DISTINCT source, ';' ORDER BY source) AS facts FROM documents GROUP BY 1)
        SELECT doc_id, lang, concat('[TASKS: 1. read ', source, ' | 2. write ', lang, ' | 3. check | 4. send', CASE WHEN doc_id % 2 = 0 THEN concat(' | Unknown: ', lang) ELSE '' END, ']') AS status, facts FROM documents JOIN f USING (lang)""",
    "x5_x10_native": rf"""WITH {RESPONSES_SQL}, t AS (SELECT doc_id, profile, regexp_extract_all(r, '<tool>\s*(\w+)\s*\(', 1) AS ts FROM responses), e AS (SELECT doc_id, profile, k - 1 AS k, ts[k] AS tool FROM t, unnest(range(1, len(ts) + 1)) AS u(k))
        SELECT doc_id, profile, k, concat('call_', left(md5(concat(doc_id, '|', k)), 8)) AS call_id, concat('{{"type":"function","name":"', tool, '"}}') AS schema, count(*) OVER (PARTITION BY profile) AS of_profile FROM e""",
    "x11_x12_templates": f"""WITH x AS (SELECT doc_id, source, {_h('x12', 'doc_id')} % 3 AS i, {_h('x7', 'doc_id')} / 4294967296.0 < 0.25 AS twice FROM documents)
        SELECT doc_id, CASE i WHEN 0 THEN concat('Ann of Rome asks ', source, ': Ann?') WHEN 1 THEN concat('Bo of Oslo asks ', source, ': Bo?') ELSE concat('Cy of Lima asks ', source, ': Cy?') END AS text, (1 + twice::INT)::BIGINT AS copies FROM x""",
    "x22_e9_rows": rf"""WITH {RESPONSES_SQL}, x AS (SELECT *, CASE WHEN {has('ask')} THEN 'ask' WHEN {has('act')} THEN 'act' WHEN {has('answer')} THEN 'answer' END AS kind, length({s(body('think'))}) AS n, {s(body('ask'))} AS q, len(regexp_extract_all(r, '(?s)code\s*=\s*"([^"]*)"\s*\)')) AS codes FROM responses),
        b AS (SELECT *, CASE WHEN kind IS NULL THEN 'rejected' WHEN kind = 'ask' THEN CASE WHEN length(q) - length(replace(q, '?', '')) = 1 THEN 'B' ELSE 'rejected' END ELSE 'B_negative' END AS branch FROM x)
        SELECT doc_id, branch, (CASE branch WHEN 'B' THEN 5 WHEN 'B_negative' THEN 3 ELSE 0 END)::BIGINT AS messages, CASE WHEN codes = 0 THEN 'no_code' WHEN doc_id % 2 = 1 THEN 'failed' WHEN expected = '42' THEN 'accepted' ELSE 'wrong' END AS math,
          n >= 150 AND {has('answer')} AND NOT contains(r, '```') AS e10_refusal, coalesce(kind <> 'answer' AND n = 0, false) AS f26_retry FROM b""",
    "f13_f23_checks": f"""WITH {RESPONSES_SQL}, x AS (SELECT category, profile, list_distinct({_TOOLS}) AS t FROM responses)
        SELECT category, count(*) AS n, round(avg(CASE WHEN category IN {_MATH} THEN list_contains(t, 'python_execute')::INT END), 6) AS rule_rate, count(*) FILTER (CASE WHEN profile = 'no_tools' THEN len(t) = 0 ELSE len(t) > 0 END) AS fits,
          max(len(t)) = 0 AS no_harness, count(*) FILTER (len(t) > 1) AS mania FROM x GROUP BY 1""",
    "j5_rescore": """SELECT doc_id, CASE WHEN doc_id % 40 < 30 AND doc_id % 40 % 2 = 0 THEN doc_id % 40 ELSE doc_id % 25 END AS def_id, doc_id % 40 < 30 AND doc_id % 40 % 2 = 0 AS exact FROM documents""",
    "a12_a34_means": f"""{_S} SELECT label, count(*) AS n, count(*) FILTER (judge_score IS NULL) AS a29_pending, round(avg(judge_score), 6) AS a26_degradation, round(avg((coalesce(judge_score, rule_score) >= 0.5)::INT), 6) AS a17_pass_rate,
        round(avg(rule_score) FILTER (suite = 'drift'), 6) AS a12_drift, round(avg(rule_score) FILTER (event_id % 2 = 0) - avg(rule_score) FILTER (event_id % 2 = 1), 6) AS a30_gap, round(avg(event_id % 3), 1) AS a19_retries, round(avg((rule_score > 0.8)::INT), 6) AS a32_verified FROM scores GROUP BY 1""",
    "a15_leaderboard": f"""{_S}, {_PER_Q}, b AS (SELECT suite, item, label AS best FROM q QUALIFY row_number() OVER (PARTITION BY suite, item ORDER BY score DESC, label) = 1) SELECT best, suite, count(*) AS n FROM b GROUP BY ALL""",
    "a20_a28_catalogue": """WITH p AS (SELECT ts::DATE AS day, event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2),
        g AS (SELECT *, round(coalesce(b, 0) - coalesce(a, 0), 6) AS gap FROM p) SELECT day, sum(n)::BIGINT AS n, round(sum(total), 3) AS total, count(*) FILTER (gap > 0.05) AS wins, count(*) FILTER (gap < -0.05) AS losses, round(avg(gap), 6) AS mean_gap FROM g GROUP BY 1""",
    "a22_a24_ablation": f"""WITH {RESPONSES_SQL}, x AS (SELECT *, {_CALLS} AS c FROM responses), y AS (SELECT *, json_extract_string(c[1], '$.name') AS name, json_extract_string(c[1], '$.arguments.code') AS code FROM x),
        z AS (SELECT *, coalesce(name = 'teleport', false) AS wrong FROM y)
        SELECT profile, round(avg((name IS NOT NULL)::INT), 6) AS parse_rate, round(avg(coalesce(name = 'python_execute', false)::INT), 6) AS tool_rate, round(avg(coalesce(code = concat('print(', doc_id, ')'), false)::INT), 6) AS exact_rate,
          round(avg(regexp_matches(r, '(?i)<think>')::INT) FILTER (NOT wrong), 6) AS think_rate, round(avg(regexp_matches(r, '(?i)<answer>')::INT) FILTER (NOT wrong), 6) AS answer_rate, count(*) FILTER (wrong) AS errors FROM z GROUP BY 1""",
    "t10_rank_bootstrap": f"""{_S}, {_PER_Q}, c AS (SELECT a.item, a.label, (count(*) FILTER (b.score < a.score) + 0.5 * count(*) FILTER (b.score = a.score))::DOUBLE / greatest(count(b.label), 1) AS credit FROM q a LEFT JOIN q b ON a.suite = b.suite AND a.item = b.item AND a.label <> b.label GROUP BY a.suite, a.item, a.label),
        o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, credit FROM c),
        w AS (SELECT label, rep, ('0x' || substr(md5(concat('t10|', rep, '|', k)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT label, n FROM o), unnest(range(0, 100)) AS a(rep), unnest(range(0, n)) AS b(k)),
        m AS (SELECT w.label, rep, avg(credit) AS m FROM w JOIN o USING (label, i) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) - 1 AS spot FROM m), t AS (SELECT label, avg(credit) AS h FROM c GROUP BY 1)
        SELECT label, round(h, 6) AS h2h, round(max(p.m) FILTER (spot = 2), 6) AS lo, round(max(p.m) FILTER (spot = 97), 6) AS hi, round(avg((round(p.m, 9) <= 0.5)::INT), 6) AS share_below FROM p JOIN t USING (label) GROUP BY label, h""",
    "t10_rank_intervals": f"""{_S}, {_PER_Q}, c AS (SELECT a.suite, a.item, a.label, (count(*) FILTER (b.score < a.score) + 0.5 * count(*) FILTER (b.score = a.score))::DOUBLE / greatest(count(b.label), 1) AS credit FROM q a LEFT JOIN q b ON a.suite = b.suite AND a.item = b.item AND a.label <> b.label GROUP BY ALL),
        n AS (SELECT suite, item, row_number() OVER (ORDER BY suite, item) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT suite, item FROM q)), o AS (SELECT i, label, credit FROM c JOIN n USING (suite, item)),
        w AS (SELECT rep, ('0x' || substr(md5(concat('t10|', rep, '|', k)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT n FROM n), unnest(range(0, 10000)) AS a(rep), unnest(range(0, n)) AS b(k)),
        m AS (SELECT rep, label, avg(credit) AS m FROM w JOIN o USING (i) GROUP BY ALL), v AS (SELECT label AS a, NULL AS b, round(m, 9) AS v FROM m UNION ALL SELECT x.label, y.label, round(x.m - y.m, 9) FROM m x JOIN m y USING (rep) WHERE x.label < y.label),
        p AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY v) - 1 AS spot, count(*) OVER (PARTITION BY a, b) AS k FROM v), t AS (SELECT label, avg(credit) AS h FROM c GROUP BY 1),
        e AS (SELECT a, b, round(max(v) FILTER (spot = k * 25 // 1000), 6) AS lo, round(max(v) FILTER (spot = least(k * 975 // 1000, k - 1)), 6) AS hi, round(avg((v <= 0)::INT), 6) AS share FROM p GROUP BY a, b)
        SELECT a, b, round(x.h - coalesce(y.h, 0), 6) AS point, lo, hi, CASE WHEN b IS NOT NULL THEN share END AS share_le_0, CASE WHEN b IS NOT NULL THEN NOT (lo <= 0 AND hi >= 0) END AS separated, true AS reproduced FROM e JOIN t x ON x.label = a LEFT JOIN t y ON y.label = b""",
    "m2_m15_sets": """WITH p AS (SELECT lang, source, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first) AS nth, len(list_intersect(string_split(lang, ''), string_split(source, '')))::BIGINT AS shared FROM p""",
    "g3_retries": """WITH t AS (SELECT user_id, event_id // 500 AS turn, event_id, value < 30 AS clean, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) AS k FROM events)
        SELECT user_id, turn, coalesce(min(event_id) FILTER (clean), max(event_id)) AS event_id, bool_or(clean) AS compliant, count(*) AS attempts FROM t WHERE k <= 3 GROUP BY 1, 2""",
    "e1_e4_gold": f"""{_S}, x AS (SELECT *, row_number() OVER (PARTITION BY principle ORDER BY md5(concat('gold|', event_id)), event_id) AS k FROM scores)
        SELECT event_id, principle, left(md5(concat(item, '|', event_id)), 8) AS gold_id, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1 END::DOUBLE AS human, event_id % 4 < 2 AS scored FROM x WHERE k <= 3""",
    "s9_s17_seeds": rf"""SELECT doc_id, lang, md5({s('text')}) AS question_md5, source AS p42_label, source IN ('src0', 'src1') AS s9_pair FROM documents WHERE length(text) > 20 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat('s15|', doc_id))) <= 25""",
    "x28_x30_prompts": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('Fix: - P1', chr(10), '- P18') WHEN 1 THEN 'Fix: - P3' ELSE '' END AS prompt, concat('rubric', CASE lang WHEN 'en' THEN ' | expected: be brief' WHEN 'fr' THEN ' | expected: be kind' ELSE '' END) AS rubric FROM documents""",
}
