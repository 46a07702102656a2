"""Queries over graded verdicts: ranks by grade, rank rows with weights and tiers, families, lineage, and the wide ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import principles as P
from millrace.operators import ladder as L
from millrace.operators import ranking as K
from millrace.plans.fixtures import SCORES_SQL, scores
from millrace.plans.q_evaluation import _per_question, _poisson

LABELS = ["signup", "view", "click", "purchase", "error"]
#: A verdict on an answer from its score: the grade (some that there aren't), and where the judge put it.
GRADE = """CASE WHEN score >= 0.8 THEN 'A+' WHEN score >= 0.6 THEN ' a ' WHEN score >= 0.5 THEN 'B+' WHEN score >= 0.4 THEN 'B' WHEN score >= 0.3 THEN 'c+' WHEN score >= 0.2 THEN 'D' WHEN score >= 0.1 THEN 'F' ELSE 'E' END"""
NAMES = [p[0] for p in P.PRINCIPLES] + ["P99_other"]


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("item", 2, 9).cast("int")
    principle = F.element_at(F.array(*map(F.lit, NAMES)), number % len(NAMES) + 1)
    grade = F.when(number % 11 > 0, F.expr(GRADE))
    return _per_question(spark, d).select("suite", "item", "label", principle.alias("principle"), F.md5(F.concat("label", F.lit("|"), "item")).alias("stated"), grade.alias("grade"))


def _credited(spark: SparkSession, d: str) -> DataFrame:
    return K.beat_credit(K.resolved(_verdicts(spark, d), ["suite", "item"]), ["suite", "item"])


def w3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Places by grade, the order of display, and whether the judge's own order was another."""
    return K.resolved(_verdicts(spark, d), ["suite", "item"]).select("suite", "item", "label", "points", "place", "shown", "disagrees")


def k7_rank_rows(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of ranks: all questions, suites, weighted and by tier."""
    return K.rank_rows(_credited(spark, d), P.dimension(spark))


def a14_families(spark: SparkSession, d: str) -> DataFrame:
    """Head-to-head means by family and by principle, and how often each place and grade was had."""
    rows = _credited(spark, d).filter("suite = 'constitution'").join(F.broadcast(P.dimension(spark).select("principle", "family")), "principle", "left")  # 23 rows
    sets = rows.groupingSets([["label", "family"], ["label", "principle"]], "label", "family", "principle")
    out = sets.agg(F.grouping("principle").alias("of_family"), F.count("*").alias("n"), F.round(F.avg("credit"), 6).alias("h2h"), *[F.count_if(F.col("place") == k).alias(f"place_{k}") for k in range(1, 6)], *[F.count_if(F.upper(F.trim("grade")) == g).alias(f"grade_{g.lower().replace('+', '_plus')}") for g in K.GRADE_POINTS])
    return out.filter("of_family = 0 OR family IS NOT NULL").drop("of_family")


def a14_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in the order that they were built in, each with its step from the one before."""
    return K.lineage(k7_rank_rows(spark, d), ["signup", "click", "none", "error", "view"]).withColumn("delta", F.round("delta", 4))


def w9_wide_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A row for each metric: scores of the conditions, steps between neighbours and their intervals of 2,000 resamples."""
    s = scores(spark, d)
    metrics = F.explode(F.array(F.struct(F.concat("suite", F.lit(" (rule)")).alias("metric"), F.col("rule_score").alias("value")), F.struct(F.concat("suite", F.lit(" (judge)")).alias("metric"), F.col("judge_score").alias("value"))))
    items = s.filter("NOT (suite = 'drift' AND label = 'view')").select("label", F.concat_ws("::", "principle", "item").alias("key"), metrics.alias("m")).select("m.metric", "label", "key", "m.value")
    wide = L.wide(items, LABELS)
    return wide.select("metric", *[F.round(c, 6).alias(c) for c in wide.columns if c != "metric"])


QUERIES = {f.__name__: f for f in (w3_verdicts, k7_rank_rows, a14_families, a14_lineage, w9_wide_ladder)}

_POINTS = "CASE upper(trim(grade)) " + " ".join(f"WHEN '{g}' THEN {p}" for g, p in K.GRADE_POINTS.items()) + " END"
_DIM = ", ".join(f"('{n}', '{f}', {t}, {P.WEIGHTS[t]})" for n, f, _, t in P.PRINCIPLES)
_V = f"""WITH {SCORES_SQL}, q AS (SELECT suite, item, label, floor(sum(round(rule_score * 10)::BIGINT) / count(*)) / 10 AS score FROM scores GROUP BY ALL),
    v AS (SELECT suite, item, label, {[*NAMES]}[substr(item, 2)::INT % {len(NAMES)} + 1] AS principle, md5(concat(label, '|', item)) AS stated, CASE WHEN substr(item, 2)::INT % 11 > 0 THEN {GRADE} END AS grade FROM q),
    p AS (SELECT *, {_POINTS}::DOUBLE AS points FROM v), g AS (SELECT *, count(points) OVER (PARTITION BY suite, item) > 0 AS graded, row_number() OVER (PARTITION BY suite, item ORDER BY stated) AS said FROM p),
    r AS (SELECT *, (CASE WHEN graded THEN rank() OVER (PARTITION BY suite, item ORDER BY coalesce(points, -1) DESC) ELSE said END)::INT AS place, (CASE WHEN graded THEN row_number() OVER (PARTITION BY suite, item ORDER BY coalesce(points, -1) DESC, stated) ELSE said END)::INT AS shown FROM g),
    c AS (SELECT *, count(*) OVER (PARTITION BY suite, item) AS m, count(*) OVER (PARTITION BY suite, item, place) AS tied FROM r),
    b AS (SELECT *, CASE WHEN m > 1 THEN (m - place - (tied - 1) / 2) / (m - 1) ELSE 1 END AS credit, CASE WHEN place = 1 THEN 1 / tied ELSE 0 END AS win FROM c), dim(principle, family, tier, weight) AS (VALUES {_DIM})"""
_ROWS = """k AS (SELECT b.*, coalesce(tier, 3) AS tier, coalesce(weight, 1.0) AS weight FROM b LEFT JOIN dim USING (principle) WHERE suite = 'constitution'),
    rows AS (SELECT label, 'ALL' AS suite, count(*) AS n, round(sum(win), 2) AS wins, round(avg(credit), 4) AS h2h_score, round(avg(points), 4) AS mean_score FROM b GROUP BY label
      UNION ALL SELECT label, suite, count(*), round(sum(win), 2), round(avg(credit), 4), NULL FROM b GROUP BY label, suite
      UNION ALL SELECT label, 'constitution_weighted', (SELECT count(*) FROM b WHERE b.label = k.label), round((sum(weight * win) / sum(weight))::DOUBLE, 4), round((sum(weight * credit) / sum(weight))::DOUBLE, 4), NULL FROM k GROUP BY label
      UNION ALL SELECT label, concat('constitution_tier', tier), count(*), round(sum(win), 2), round(avg(credit), 4), NULL FROM k GROUP BY label, tier)"""
_STEPS = list(zip(LABELS, LABELS[1:]))
SQL = {
    "w3_verdicts": f"{_V} SELECT suite, item, label, points, place, shown, max((shown <> said)::INT) OVER (PARTITION BY suite, item) = 1 AS disagrees FROM r",
    "k7_rank_rows": f"{_V}, {_ROWS} SELECT * FROM rows",
    "a14_families": f"""{_V}, k AS (SELECT b.*, family FROM b LEFT JOIN dim USING (principle) WHERE suite = 'constitution')
        SELECT label, family, principle, count(*) AS n, round(avg(credit), 6) AS h2h, {", ".join(f"count(*) FILTER (place = {i}) AS place_{i}" for i in range(1, 6))}, {", ".join(f"count(*) FILTER (upper(trim(grade)) = '{g}') AS grade_{g.lower().replace('+', '_plus')}" for g in K.GRADE_POINTS)}
        FROM k GROUP BY GROUPING SETS ((label, family), (label, principle)) HAVING grouping(principle) = 0 OR family IS NOT NULL""",
    "a14_lineage": f"""{_V}, {_ROWS}, o(label, rung) AS (VALUES ('signup', 1), ('click', 2), ('none', 3), ('error', 4), ('view', 5)),
        w AS (SELECT label, rung, max(h2h_score) FILTER (suite = 'constitution_weighted') AS weighted, max(h2h_score) FILTER (suite = 'ALL') AS h2h, max(wins) FILTER (suite = 'constitution_weighted') AS win_share FROM rows JOIN o USING (label) GROUP BY ALL)
        SELECT w.label, w.rung, w.weighted, round(w.weighted - p.weighted, 4) AS delta, w.h2h, w.win_share FROM w LEFT JOIN w p ON p.rung = w.rung - 1""",
    "w9_wide_ladder": f"""WITH {SCORES_SQL}, i AS (SELECT concat(suite, ' (rule)') AS metric, label, concat(principle, '::', item) AS key, rule_score AS value FROM scores WHERE NOT (suite = 'drift' AND label = 'view')
          UNION ALL SELECT concat(suite, ' (judge)'), label, concat(principle, '::', item), judge_score FROM scores WHERE NOT (suite = 'drift' AND label = 'view')),
        k AS (SELECT metric, label, key, avg(value) AS value FROM i WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT metric, {", ".join(f"avg(value) FILTER (label = '{x}') AS score_{x}" for x in LABELS)} FROM k GROUP BY metric),
        o(label, rung) AS (VALUES {", ".join(f"('{x}', {n})" for n, x in enumerate(LABELS, 1))}), r AS (SELECT * FROM k JOIN o USING (label)), d AS (SELECT a.metric, a.key, a.rung, a.value - b.value AS x FROM r a JOIN r b ON a.metric = b.metric AND a.key = b.key AND a.rung = b.rung + 1),
        w AS (SELECT key, rep, {_poisson("concat('42|', rep, '|', key)")} AS w FROM (SELECT DISTINCT key FROM d), unnest(range(0, 2000)) AS u(rep)), m AS (SELECT metric, rung, rep, round(sum(w * x) / sum(w), 9) AS m FROM d JOIN w USING (key) WHERE w > 0 GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY metric, rung ORDER BY m) - 1 AS spot, count(*) OVER (PARTITION BY metric, rung) AS n FROM m),
        e AS (SELECT metric, rung, max(m) FILTER (spot = n * 25 // 1000) AS lo, max(m) FILTER (spot = least(n * 975 // 1000, n - 1)) AS hi FROM p GROUP BY ALL)
        SELECT s.metric, {", ".join(f"round(any_value(score_{x}), 6) AS score_{x}" for x in LABELS)}, {", ".join(f"round(any_value(score_{b}) - any_value(score_{a}), 6) AS delta_{a}__{b}" for a, b in _STEPS)},
          {", ".join(f"round(max({c}) FILTER (rung = {n}), 6) AS {c}_{a}__{b}" for n, (a, b) in enumerate(_STEPS, 2) for c in ("lo", "hi"))} FROM s LEFT JOIN e USING (metric) GROUP BY s.metric""",
}
