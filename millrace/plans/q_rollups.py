"""Queries of the summaries of judged runs, over the reports of q_suites and the responses under the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import reports as O
from millrace.operators import rollups as R
from millrace.operators import suites
from millrace.plans import q_rules, q_suites
from millrace.plans.fixtures import SCORES_SQL, documents, scores
from millrace.plans.q_ranks import NAMES


def a12_personas(spark: SparkSession, d: str) -> DataFrame:
    """Means of persona reports, over all and by dimension, of judged conversations."""
    return R.personas(q_suites._reports(spark, d))


def _probe(spark: SparkSession, d: str) -> DataFrame:
    """A response of each document as an answer to a probe, with its trace and a saved verdict; labels by source."""
    every = [*[(g, i) for _, g, i, _ in rules.every_rule()], ("no_such_group", 0)]
    pick = lambda of: F.element_at(F.array(*[F.lit(e[of]) for e in every]), (F.col("doc_id") % len(every) + 1).cast("int"))
    rows = documents(spark, d).select("doc_id", F.col("lang").alias("label"), pick(0).alias("group_id"), pick(1).alias("idx"), F.expr(q_rules._spark(q_rules.SAYS)).alias("response"), F.expr(q_rules.TRACE).alias("t"), (F.col("doc_id") % 3 > 0).alias("passed"))
    return rows.withColumn("trace", F.when(F.col("t") == "", F.array().cast("array<string>")).when(F.col("t").isNotNull(), F.split("t", ",")))


def a17_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Probes scored again by the rules: with calls as the responses write them and as the trace has them."""
    return R.rescored(_probe(spark, d))


def a19_retries(spark: SparkSession, d: str) -> DataFrame:
    """Mean retries by principle of the probe reports."""
    return R.retries(suites.records(q_suites._reports(spark, d).filter("suite = 'constitution'")))


def a20_runs(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of runs."""
    return R.catalogue(q_suites._reports(spark, d))


def a26_degradation(spark: SparkSession, d: str) -> DataFrame:
    """How many turns of the drift reports are right, where the first isn't, and calls without need."""
    rows = q_suites._items(spark, d).filter("suite = 'drift'")
    tools = F.when(F.col("k") % 5 == 0, 0).when(F.col("k") % 5 == 3, 0).otherwise(1)
    return R.degradation(rows.select("label", F.col("doc_id").alias("turn"), (F.col("rule") >= 0.5).alias("correct"), tools.alias("n_tools"), (F.col("k") % 2 == 0).alias("requires_tool")))


def _by_principle(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("item", 2, 9).cast("int")
    rows = scores(spark, d).withColumn("principle", F.element_at(F.array(*map(F.lit, NAMES)), number % len(NAMES) + 1))
    return rows.filter("NOT (label = 'view' AND principle = 'P4_math_code')").groupBy("label", "principle").agg(F.avg("rule_score").alias("score"))


def a27_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Wins and losses of one condition against another, by hypothesis."""
    return R.hypotheses(_by_principle(spark, d), "click", "view")


def a28_harness(spark: SparkSession, d: str) -> DataFrame:
    """What a harness gains, by principle and over all."""
    return R.gains(_by_principle(spark, d), F.col("label") == "click", F.col("label") == "view")


def a30_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by how much of the rules the judge is told, and the gap between all and none."""
    mode = F.when(F.col("user_id") % 3 == 0, "full").when(F.col("user_id") % 3 == 1, "bare").otherwise("none")
    return R.exposure(scores(spark, d).select("label", mode.alias("mode"), F.col("judge_score").alias("score")))


def a32_claims(spark: SparkSession, d: str) -> DataFrame:
    """How far an answer's claims are held up by a graph: those of its lines that say who said them."""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "lang", F.expr("doc_id % 7 > 0").alias("there"), F.explode_outer(F.filter(F.split("text", "\n", -1), lambda line: F.length(line) % 4 == 0)).alias("claim"))
    found = docs.filter("claim IS NOT NULL").select("id", O.claim_confidence(F.col("there"), F.when(F.length("claim") % 3 > 0, F.col("claim")), (F.length("claim") % 5).cast("int") % 2, F.length("claim") % 8 == 0).alias("c"))
    return R.claims(documents(spark, d).select(F.col("doc_id").alias("id")), found.select("id", "c.verified", "c.confidence"))


QUERIES = {f.__name__: f for f in (a12_personas, a17_rescored, a19_retries, a20_runs, a26_degradation, a27_hypotheses, a28_harness, a30_exposure, a32_claims)}

_N = len(list(rules.every_rule())) + 1
_RULE = f"CASE doc_id % {_N} {' '.join(f'WHEN {n} THEN {q_rules._holds(rule)}' for n, (_, _, _, rule) in enumerate(rules.every_rule()))} END".replace("(end,", '("end",')
_GROUP = f"CASE doc_id % {_N} {' '.join(f'''WHEN {n} THEN '{g}' ''' for n, (_, g, _, _) in enumerate(rules.every_rule()))} ELSE 'no_such_group' END"
_P = f"""s AS (SELECT * REPLACE ({[*NAMES]}[substr(item, 2)::INT % {len(NAMES)} + 1] AS principle) FROM scores), p AS (SELECT label, principle, avg(rule_score) AS score FROM s WHERE NOT (label = 'view' AND principle = 'P4_math_code') GROUP BY ALL),
    w AS (SELECT principle, max(score) FILTER (label = 'click') AS a, max(score) FILTER (label = 'view') AS b FROM p WHERE label IN ('click', 'view') GROUP BY 1)"""
_HYPOTHESIS = "CASE " + " ".join(f"WHEN principle IN {own} THEN '{name}'" for name, own in R.HYPOTHESES.items()) + " ELSE 'other' END"
SQL = {
    "a12_personas": f"""WITH {q_suites._X}, p AS (SELECT *, overall IS NOT NULL AND k % 9 > 0 AS valid FROM x WHERE suite = 'persona'), t AS (SELECT label, count(*) AS total FROM p GROUP BY 1),
        m AS (SELECT label, 'warmth' AS dimension, overall AS score FROM p WHERE valid UNION ALL SELECT label, 'depth', n_chars % 5 / 5 FROM p WHERE valid AND k % 3 > 0)
        SELECT label, NULL AS dimension, round(avg(overall) FILTER (valid), 4) AS mean, count(*) FILTER (valid) AS judged, count(*) AS total FROM p GROUP BY label UNION ALL SELECT label, dimension, round(avg(score), 4), count(*), any_value(total) FROM m JOIN t USING (label) GROUP BY label, dimension""",
    "a17_rescored": f"""WITH {q_rules._F}, g AS (SELECT f.*, lang AS label, {_GROUP.strip()} AS group_id, d.doc_id % 3 > 0 AS saved, regexp_extract_all(response, '<tool>\\s*(\\w+)\\s*\\(', 1) AS grepped, CASE WHEN x.t IS NULL THEN [] WHEN x.t = '' THEN [] ELSE string_split(x.t, ',') END AS traced_tools FROM f JOIN x USING (doc_id) JOIN documents d USING (doc_id)),
        a AS (SELECT doc_id, {_RULE} AS replicated FROM (SELECT * REPLACE (grepped AS tools) FROM g)), b AS (SELECT doc_id, {_RULE} AS traced FROM (SELECT * REPLACE (traced_tools AS tools) FROM g)),
        r AS (SELECT label, group_id, saved, coalesce(replicated, saved) AS replicated, coalesce(traced, saved) AS traced, group_id <> 'no_such_group' AS matched FROM g JOIN a USING (doc_id) JOIN b USING (doc_id)),
        p AS (SELECT label, group_id, count(*) AS n, avg(saved::INT) AS saved, avg(replicated::INT) AS replicated, avg(traced::INT) AS traced, bool_or(matched) AS matched FROM r GROUP BY ALL),
        u AS (SELECT * FROM p UNION ALL SELECT label, NULL, count(*), avg((saved >= 0.6)::INT), avg((replicated >= 0.6)::INT), avg((traced >= 0.6)::INT), bool_and(matched) FROM p GROUP BY label)
        SELECT label, group_id, n, round(saved, 4) AS saved, round(replicated, 4) AS replicated, round(traced, 4) AS traced, round(traced - replicated, 4) AS delta, abs(replicated - saved) > 1e-9 AS drifts, matched FROM u""",
    "a19_retries": f"WITH {q_suites._X} SELECT label, pid AS principle, round(avg(k % 3), 2) AS mean_retries FROM x WHERE suite = 'constitution' GROUP BY ALL",
    "a20_runs": f"""WITH {q_suites._X} SELECT label, suite, label AS model, '?' AS said_at, CASE WHEN suite = 'drift' OR round(avg(combined), 4) <> 0 THEN round(avg(combined), 4) END::DOUBLE AS score FROM x WHERE suite <> 'persona' GROUP BY label, suite""",
    "a26_degradation": f"""WITH {q_suites._X}, t AS (SELECT label, doc_id AS turn, rule >= 0.5 AS correct, k % 5 NOT IN (0, 3) AND k % 2 <> 0 AS idle FROM x WHERE suite = 'drift')
        SELECT label, count(correct) AS scored, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 4) AS share, min(turn) FILTER (NOT correct) AS first_failure, count(*) FILTER (idle) AS idle_calls FROM t GROUP BY label""",
    "a27_hypotheses": f"""WITH {SCORES_SQL}, {_P}, d AS (SELECT {_HYPOTHESIS} AS hypothesis, round(coalesce(b, 0) - coalesce(a, 0), 4) AS delta FROM w)
        SELECT hypothesis, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0.05) AS wins, count(*) FILTER (delta < -0.05) AS losses, count(*) AS n FROM d GROUP BY 1""",
    "a28_harness": f"""WITH {SCORES_SQL}, {_P} SELECT principle, round(coalesce(b, 0) - a, 4) AS gain FROM w WHERE a IS NOT NULL UNION ALL SELECT NULL, round(avg(b) - avg(a), 4) FROM w""",
    "a30_exposure": f"""WITH {SCORES_SQL}, m AS (SELECT label, round(avg(judge_score) FILTER (user_id % 3 = 0), 4) AS "full", round(avg(judge_score) FILTER (user_id % 3 = 1), 4) AS bare, round(avg(judge_score) FILTER (user_id % 3 = 2), 4) AS "none" FROM scores GROUP BY label)
        SELECT label, "full", bare, "none", round("full" - "none", 4) AS gap FROM m""",
    "a32_claims": """WITH l AS (SELECT doc_id AS id, doc_id % 7 > 0 AS there, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) % 4 = 0)) AS c FROM documents), n AS (SELECT *, length(c) AS n FROM l),
        v AS (SELECT id, there AND n % 3 > 0 AND (n % 5 % 2 > 0 OR n % 8 = 0) AS verified, CASE WHEN NOT there OR n % 3 = 0 THEN 0.5 WHEN n % 5 % 2 > 0 THEN 0.9 WHEN n % 8 = 0 THEN 0.8 ELSE 0.2 END AS confidence FROM n),
        g AS (SELECT id, round(avg(confidence), 4)::DOUBLE AS score, count(*) AS total, count(*) FILTER (verified) AS verified FROM v GROUP BY id)
        SELECT doc_id AS id, coalesce(score, 1) AS score, coalesce(total, 0) AS total, coalesce(verified, 0) AS verified FROM documents LEFT JOIN g ON id = doc_id""",
}
