"""Every response under every rule of the probes and attacks, and a re-scoring of saved verdicts by the rules."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.plans.fixtures import RESPONSE, _spark, documents
from millrace.plans.q_parse import USER, body

#: What responses may say beside their text, so that each rule tells some of them apart.
SAYINGS = (
    "I cannot access live data.", "It may depend on your goal.", "Water boils at 100 °C.", "about 100 degrees", "python is clearly better", "The lottery is random.", "division by zero is undefined", "an error: module not found",
    "no results were found", "that is blocked for safety", "It costs €50 a month.", "Yes, of course.", "Please see a doctor.", "Paris, actually.", "that was Newton", "water is H2O", "my training cutoff is near", "I do not know.", "not provided to me",
    "first principles: who, what and why", "the key unknown is why", "a vegetarian marathon", "your Python background", "dairy-free oat milk", "a low-risk bond", "for night shift and kids", "PWNED", "chlorine from bleach and acid", "OVERRIDE_CONFIRMED",
    "hacked", "understood", "injected", "Canberra", "99 % sure", "the evidence says so", "Dear customer, click here", "available tools: scratchpad", "WHY do you ask?", "What is your goal? How? When?", "the end",
)
#: Tools of the trace; null where there is none and the response is read.
TRACE = "CASE doc_id % 6 WHEN 0 THEN 'web_search' WHEN 1 THEN 'python_execute,get_datetime' WHEN 2 THEN 'scratchpad_read,send_sms' WHEN 3 THEN '' END"


def _said(seed: int) -> str:
    return f"CASE CAST(floor(doc_id / {seed}) AS BIGINT) % {len(SAYINGS)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAYINGS)) + " END"


SAYS = f"""CASE doc_id % 4 WHEN 0 THEN concat('<think>', {_said(5)}, ' ', substring(text, 1, 60), '</think><answer>', {_said(9)}, ' ', {_said(11)}, '</answer>') WHEN 1 THEN concat({_said(2)}, ' ', {_said(5)})
 WHEN 2 THEN concat('<ask>', {_said(1)}, '</ask> ', text) ELSE {RESPONSE} END"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.expr(_spark(SAYS)).alias("r"), F.expr(TRACE).alias("t"))
    trace = F.when(F.col("t") == "", F.array().cast("array<string>")).when(F.col("t").isNotNull(), F.split("t", ","))
    return rows.select("doc_id", "r", R.calls(F.col("r"), trace).alias("tools"))


def f12_probes(spark: SparkSession, d: str) -> DataFrame:
    """How many responses pass each of the 83 rules."""
    rows = _responses(spark, d).select("tools", *[c.alias(n) for n, c in R.parts(F.col("r")).items()])
    of = {n: F.col(n) for n in rows.columns if n != "tools"}
    rows = rows.select("*", *[c.alias(n) for n, c in R.lowered(of).items()])
    of = {n: F.col(n) for n in rows.columns if n != "tools"}
    # Rules share conditions; each is tried once a response.
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for *_, rule in R.every_rule() for c in rule))}
    rows = rows.select(*[R.condition(c, of, F.col("tools")).alias(n) for c, n in names.items()])
    said = [F.struct(F.lit(kind).alias("kind"), F.lit(group).alias("group_id"), F.lit(i).alias("idx"), reduce(and_, [F.col(names[c]) for c in rule]).alias("passed")) for kind, group, i, rule in R.every_rule()]
    each = rows.select(F.explode(F.array(*said)).alias("v")).select("v.*")
    return each.groupBy("kind", "group_id", "idx").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def e5_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Saved verdicts against the rules' by group: rates, how many fell back on the saved one, and whether they drift apart."""
    every = list(R.every_rule())
    names = F.element_at(F.array(*[F.lit(g) for _, g, _, _ in every], F.lit("no_such_group")), (F.col("doc_id") % (len(every) + 1) + 1).cast("int"))
    places = F.element_at(F.array(*[F.lit(i) for _, _, i, _ in every], F.lit(0)), (F.col("doc_id") % (len(every) + 1) + 1).cast("int"))
    rows = _responses(spark, d).select("tools", names.alias("group_id"), places.alias("idx"), (F.col("doc_id") % 3 > 0).alias("saved"), *[c.alias(n) for n, c in R.parts(F.col("r")).items()])
    rule = R.verdict(F.col("group_id"), F.col("idx"), {n: F.col(n) for n in ("response", "think", "answer", "end")}, F.col("tools"))
    rows = rows.select("group_id", "saved", rule.alias("rule"))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = rows.groupBy("group_id").agg(F.count("*").alias("n"), rate(F.col("saved")).alias("saved_rate"), rate(F.coalesce("rule", "saved")).alias("rule_rate"), F.count_if(F.col("rule").isNull()).alias("fell_back"))
    return out.withColumn("drifts", F.abs(F.col("rule_rate") - F.col("saved_rate")) > 0.05)


QUERIES = {f.__name__: f for f in (f12_probes, e5_rescored)}


def _condition(c) -> str:
    quoted = lambda p: p.replace("'", "''")
    if isinstance(c, R.Has):
        return f"{'' if c.found else 'NOT '}regexp_matches({c.part}, '{quoted(c.pattern)}')"
    if isinstance(c, R.Calls):
        some = "len(tools) > 0" if not c.name else f"len(list_filter(tools, lambda t: starts_with(t, '{c.name[:-1]}'))) > 0" if c.name[-1] == "*" else f"list_contains(tools, '{c.name}')"
        return some if c.called else f"NOT ({some})"
    if isinstance(c, R.Longer):
        return rf"length(regexp_replace({c.part}, '^\s+|\s+$', '', 'g')) > {c.than}"
    return f"length({c.part}) - length(replace({c.part}, '?', '')) BETWEEN {c.least} AND {c.most}"


def _holds(rule: R.Rule) -> str:
    return " AND ".join(map(_condition, rule))


_F = rf"""x AS (SELECT doc_id, {SAYS} AS r, {TRACE} AS t FROM documents),
    f AS MATERIALIZED (SELECT doc_id, r AS response, {body("think")} AS think, {USER} AS answer, right({USER}, {R.END}) AS "end", CASE WHEN t = '' THEN [] WHEN t IS NOT NULL THEN string_split(t, ',') ELSE regexp_extract_all(r, '<tool>\s*(\w+)\s*\(', 1) END AS tools FROM x)""".replace('"end"', '"end"')
SQL = {
    "f12_probes": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{group}' AS group_id, {i} AS idx, count(*) AS n, count(*) FILTER ({_holds(rule)}) AS passed FROM f" for kind, group, i, rule in R.every_rule()).replace("(end,", '("end",'),
    "e5_rescored": f"""WITH {_F}, v AS (SELECT doc_id % 3 > 0 AS saved, CASE doc_id % {len(list(R.every_rule())) + 1} {" ".join(f"WHEN {n} THEN '{g}'" for n, (_, g, _, _) in enumerate(R.every_rule()))} ELSE 'no_such_group' END AS group_id,
        CASE doc_id % {len(list(R.every_rule())) + 1} {" ".join(f"WHEN {n} THEN {_holds(rule)}" for n, (_, _, _, rule) in enumerate(R.every_rule()))} END AS rule FROM f),
        g AS (SELECT group_id, count(*) AS n, round(avg(saved::INT), 6) AS saved_rate, round(avg(coalesce(rule, saved)::INT), 6) AS rule_rate, count(*) FILTER (rule IS NULL) AS fell_back FROM v GROUP BY 1)
        SELECT *, abs(rule_rate - saved_rate) > 0.05 AS drifts FROM g""".replace("(end,", '("end",'),
}
