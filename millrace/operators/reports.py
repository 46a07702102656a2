"""Reports of judged runs: flattening by suite, item vectors, and what is shown to judges and models about tools, memory and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.scoring import ALWAYS_ON, PROFILES, strings

#: Where a suite keeps its answers: the array of groups, a group's name, and what its id starts with.
GROUPS = {"constitution": ("probe_results", "id", ""), "categories": ("category_results", "category", "cat::")}


def judged_items(reports: DataFrame) -> DataFrame:
    """label, suite, group_id, principle, question and response of every judged answer of probe, category and drift reports (one row each, suite said by a column)."""
    out = None
    for suite, (array, name, head) in GROUPS.items():
        group = reports.filter(F.col("suite") == suite).select("label", "suite", F.explode(array).alias("g"))
        each = group.select("label", "suite", F.col(f"g.{name}").alias("name"), F.col("g.principle").alias("principle") if suite == "constitution" else F.concat(F.lit("Category: "), F.col(f"g.{name}")).alias("principle"), F.explode("g.question_results").alias("q"))
        rows = each.select("label", "suite", F.concat(F.lit(head), "name").alias("group_id"), F.coalesce("q.judge_principle", "principle").alias("principle"), "q.question", "q.response")
        out = rows if out is None else out.unionByName(rows)
    turns = reports.filter("suite = 'drift'").select("label", "suite", F.explode("turn_results").alias("t"))
    return out.unionByName(turns.select("label", "suite", F.lit("drift").alias("group_id"), F.coalesce("t.judge_principle", "t.principle").alias("principle"), "t.question", "t.response"))


def item_vectors(answers: DataFrame) -> DataFrame:
    """label, key, think_len, ext_ratio, is_ask and hollow of answers (label, group_id, question_idx, response, rule_passed).

    ext_ratio is the reasoning's share of reasoning and answer, null without either; an answer counts as asking also where a question stands beside it;
    hollow is a pass without an answer.
    """
    r = F.col("response")
    rows = answers.select("label", F.concat_ws("::", "group_id", F.col("question_idx").cast("string")).alias("key"), T.think_length(r).cast("double").alias("think_len"), F.length(T.user_facing(r)).alias("chars"), (T.is_ask(r) | (T.strip(T.tag_body(r, "ask")) != "")).alias("ask"), "rule_passed")
    return rows.select("label", "key", "think_len", F.try_divide(F.col("think_len"), F.col("chars") + F.col("think_len")).alias("ext_ratio"), F.col("ask").cast("double").alias("is_ask"), (F.coalesce("rule_passed", F.lit(False)) & (F.col("chars") == 0)).cast("double").alias("hollow"))


def newest_reports(files: DataFrame, latest_only: bool = True) -> DataFrame:
    """path, folder and suite of reports (path) that can be judged; with latest_only the one of the greatest name of each folder and suite."""
    from millrace.sources.json_files import suite_of

    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select("path", name.alias("name"), folder.alias("folder")).filter(F.col("name").rlike(r"\.json$") & ~F.col("name").rlike(r"(\.prejudge|_rescored|_alignment|\.judged)\.json$|comparison"))
    rows = rows.withColumn("suite", suite_of(F.col("name"))).filter("suite <> ''")
    if latest_only:
        rows = rows.groupBy("folder", "suite").agg(F.max_by("path", "name").alias("path"))
    return rows.select("path", "folder", "suite")


def failure_prompt(tool: Column, error: Column, available: Column, final: Column) -> Column:
    """What a model is told after a failed call: the error, other tools in order, and whether trying again is in vain."""
    others = F.array_sort(F.array_except(available, F.array(tool)))
    any_left = F.size(others) > 0
    guidance = F.when(any_left, "Do not call this tool again in this response. If another tool is available and relevant, use it now. ").otherwise("Do not call any tools again in this response. Provide the best possible answer without tools. ")
    return F.concat(
        F.lit("[TOOL_FAILURE] The previous tool call failed.\nTool: "), tool, F.lit("\nError: "), T.strip(error), F.lit("\nAvailable alternatives: "),
        F.when(any_left, F.array_join(others, ", ")).otherwise("none"), F.lit(".\n"), guidance, F.lit("If the tool failure blocks a reliable answer, say so clearly."),
        F.when(final, " The failure is non-retryable due to safety or configuration constraints.").otherwise(""),
    )


ENTITIES = "entities array<struct<slot:string,label:string,name:string,description:string>>"


def entities(raw: Column, labels: dict[str, str], other: str = "Task") -> Column:
    """slot, label, name and description of the entities in a model's JSON; those without a name or description are left out, the label follows from the slot if it isn't given."""
    slot = lambda e: F.upper(F.coalesce(e["slot"], F.lit("")))

    def label(e: Column) -> Column:
        out = F.lit(other)
        for s, name in labels.items():
            out = F.when(slot(e) == s, name).otherwise(out)
        return F.coalesce(e["label"], out)

    trimmed = lambda c: T.strip(F.coalesce(c, F.lit("")))
    rows = F.transform(F.from_json(raw, ENTITIES)["entities"], lambda e: F.struct(slot(e).alias("slot"), label(e).alias("label"), trimmed(e["name"]).alias("name"), trimmed(e["description"]).alias("description")))
    return F.filter(rows, lambda e: (e["name"] != "") & (e["description"] != ""))


def merged_memory(base: Column, updates: Column) -> Column:
    """A profile's sections after updates (maps of strings): those of the base in order, updated in place, then new ones."""
    keys = F.concat(F.map_keys(base), F.array_except(F.map_keys(updates), F.map_keys(base)))
    value = lambda k: F.coalesce(F.try_element_at(updates, k), F.try_element_at(base, k))
    return F.array_join(F.transform(keys, lambda k: F.concat(F.lit("["), F.upper(k), F.lit("] "), value(k))), "\n")


def top_paragraphs(paragraphs: Column, prompt: Column, most: int = 5) -> Column:
    """The paragraphs that share most of the prompt's words (stop words aside), best first, ties in order; without any the first three, without a prompt the first eight."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), 1))
    asked = F.array_except(words(prompt), strings(T.PAGE_STOP_WORDS))
    scored = F.transform(paragraphs, lambda p, i: F.struct((-F.size(F.array_intersect(asked, words(p)))).alias("less"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["less"] < 0)), 1, most)
    found = F.transform(best, lambda s: s["p"])
    return F.when(F.size(asked) == 0, F.slice(paragraphs, 1, 8)).when(F.size(found) > 0, found).otherwise(F.slice(paragraphs, 1, 3))


def tools_line(profile: Column) -> Column:
    """The tools that a question was meant to have, for a judge."""
    out = F.when(profile.isNull(), "unknown (a standard tool set may have been available)").otherwise(profile)
    for name, tools in PROFILES.items():
        own = sorted(set(tools) - set(ALWAYS_ON))
        out = F.when(profile == name, ", ".join(own) or "none (knowledge/reasoning only — no external tools intended for this question)").otherwise(out)
    return out


def claim_confidence(available: Column, query: Column, rows: Column, asked: Column) -> Column:
    """verified, confidence and method of a claim: what its query found in the knowledge base (rows of a SELECT, the answer of an ASK)."""
    said = lambda verified, confidence, method: F.struct(F.lit(verified).alias("verified"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    return (
        F.when(~available, said(False, 0.5, "graph_unavailable"))
        .when(query.isNull(), said(False, 0.5, "unverifiable"))
        .when(F.coalesce(rows, F.lit(0)) > 0, said(True, 0.9, "sparql_select_match"))
        .when(F.coalesce(asked, F.lit(False)), said(True, 0.8, "sparql_ask_match"))
        .otherwise(said(False, 0.2, "sparql_no_match"))
    )
