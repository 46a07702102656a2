"""Queries of rows built from a teacher's replies, and of appraisals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import acceptance as A
from millrace.operators import appraisal as P
from millrace.plans.fixtures import documents

SYSTEM = "Solve with code."
PROSE = "repeat('the reasoning goes on. ', 8)"
#: A solution: in a call with reasoning, in a call after prose, in a fence with comments, without code.
SOLUTION = f"""CASE doc_id % 5 WHEN 0 THEN concat('<think> ', source, ' </think><tool>python_execute(code=\"\"\" print(', n_chars, ') \"\"\")</tool>') WHEN 1 THEN concat('First ', lang, '. <tool> python_execute(code="print(1)") </tool>')
 WHEN 2 THEN concat('```python', chr(10), '# add', chr(10), '#', chr(10), 'print(', doc_id, ') # no', chr(10), ' ## then', chr(10), '```') WHEN 3 THEN concat('```', chr(10), 'x = 1', chr(10), '```') ELSE text END"""
PRINTED = "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nothing' WHEN 2 THEN concat('total 7', chr(10), n_chars, chr(10)) WHEN 3 THEN concat('-', n_chars, '.5 is it') ELSE concat(' ', n_chars, chr(10), 'done ') END"
FIRST = f"""CASE doc_id % 6 WHEN 0 THEN concat({PROSE}, '<ask> Which ', source, '? </ask>') WHEN 1 THEN concat('<think>', {PROSE}, '</think><answer> a ', lang, '</answer>') WHEN 2 THEN 'short <answer>x</answer>' WHEN 3 THEN concat({PROSE}, '<ask>a? b?</ask>') WHEN 4 THEN {PROSE} ELSE concat('<think>', {PROSE}, '</think>x<act>do</act><answer>no</answer>') END"""
K = "CAST(floor(doc_id / 6) AS BIGINT)"
SECOND = f"CASE {K} % 3 WHEN 0 THEN concat('<think>', {PROSE}, '</think><act>go</act> tail') WHEN 1 THEN '<answer>short</answer>' ELSE concat({PROSE}, '<ask>again?</ask>') END"
HUMAN = f"CASE WHEN {K} % 2 = 0 THEN ' this one ' ELSE ' ' END"
CATEGORY = "CASE doc_id % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'jailbreak' ELSE 'evasion' END"
REFUSAL = f"""CASE doc_id % 5 WHEN 0 THEN concat('<think>', {PROSE}, '</think><answer>No. ```x```</answer>') WHEN 1 THEN concat({PROSE}, '<answer>', source, ': no</answer>') WHEN 2 THEN concat({PROSE}, '<ask>why?</ask>') WHEN 3 THEN '<answer>No</answer>' ELSE NULL END"""


def _rows(rows: DataFrame, status: str) -> DataFrame:
    """One row a message; of refused rows one with nulls."""
    m = rows.select("doc_id", status, F.posexplode_outer("messages").alias("pos", "m"))
    return m.select("doc_id", status, "pos", "m.role", "m.content")


def e9_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Solutions whose code printed the expected number, as rows of five messages."""
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("Q"), "doc_id").alias("question"), F.col("n_chars").cast("string").alias("expected"), F.expr(SOLUTION).alias("reply"), F.expr(PRINTED).alias("printed"))
    return _rows(A.solutions(rows, SYSTEM), "status")


def e10_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Refusals of risky requests."""
    rows = documents(spark, d).select("doc_id", F.expr(CATEGORY).alias("category"), F.concat(F.lit("Q"), "doc_id").alias("question"), F.expr(REFUSAL).alias("reply"))
    return _rows(A.refusals(rows, SYSTEM), "status")


def e11_clarifications(spark: SparkSession, d: str) -> DataFrame:
    """Clarifying questions with what follows them, and replies that need none."""
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("Q"), "doc_id").alias("question"), F.expr(FIRST).alias("first"), F.expr(HUMAN).alias("human"), F.expr(SECOND).alias("second"))
    return _rows(A.clarifications(rows, SYSTEM), "branch")


def _appraised(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    value = F.transform(F.slice("embedding", 1, len(P.DIMENSIONS)), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") * 1.5 + 0.5)))
    emotion = F.when(F.col("label") % 5 > 0, F.concat(F.lit("mood"), F.col("label").cast("string")))
    return P.appraised(e.select("vec_id", value.alias("v"), emotion.alias("emotion")), F.col("v"), F.col("emotion"))


def x27_appraisals(spark: SparkSession, d: str) -> DataFrame:
    """Valence, the three most extreme dimensions, the reading, and whether an appraisal carries a signal."""
    return _appraised(spark, d).select("vec_id", "valence", F.array_join("top3", ",").alias("top3"), "reading", "significant", F.col("appraisal")["agency"].alias("agency"), F.col("appraisal")["fairness"].alias("fairness"))


def e12_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many appraisals carry a signal, in all and by emotion."""
    return P.kept_share(_appraised(spark, d), "emotion")


QUERIES = {f.__name__: f for f in (e9_solutions, e10_refusals, e11_clarifications, x27_appraisals, e12_kept)}

_NL = "chr(10)"
_THINK = f"concat('<think>', {PROSE}, '</think>')"
#: Prose that is put into tags has no blanks at its ends.
_WRAPPED = f"concat('<think>', {_NL}, trim({PROSE}), {_NL}, '</think>')"
_TENTHS = ", ".join(f"coalesce(round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, embedding[{i}]::DOUBLE * 1.5 + 0.5)) * 10000), 5000)::BIGINT AS {n}" for i, n in enumerate(P.DIMENSIONS, 1))
_MATTER = [n for n in P.DIMENSIONS if n in P.EMPATHY]
_APPRAISED = f"""v AS (SELECT vec_id, CASE WHEN label % 5 > 0 THEN concat('mood', label) END AS emotion, {_TENTHS} FROM embeddings),
    n AS (SELECT vec_id, i, {_MATTER}[i] AS name, [{", ".join(_MATTER)}][i] AS x FROM v, unnest(range(1, {len(_MATTER) + 1})) AS u(i)),
    t AS (SELECT vec_id, string_agg(name, ',' ORDER BY k) AS top3, string_agg(concat(CASE WHEN x > 5000 THEN 'high ' ELSE 'low ' END, replace(name, '_', ' ')), ', ' ORDER BY k) AS said FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x - 5000) DESC, i) AS k FROM n) WHERE k <= 3 GROUP BY 1),
    a AS (SELECT v.*, top3, said, (pleasantness + 10000 - unpleasantness + 1) // 2 AS valence FROM v JOIN t USING (vec_id)),
    w AS (SELECT *, abs(valence - 5000) > 3000 OR coping_potential < 4000 OR goal_relevance > 7000 AS significant FROM a)"""
SQL = {
    "e9_solutions": f"""WITH s AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'no_code' WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 7 = 1 THEN 'no_number' WHEN doc_id % 7 = 3 THEN 'wrong' ELSE 'accepted' END AS status FROM documents),
        p AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN concat('First ', lang, '.') WHEN 2 THEN concat('{A.STEPS}', {_NL}, {_NL}, '- add', {_NL}, '- then') ELSE '{A.STEPS}' END AS thought,
            CASE doc_id % 5 WHEN 0 THEN concat('print(', n_chars, ')') WHEN 1 THEN 'print(1)' WHEN 2 THEN concat('# add', {_NL}, '#', {_NL}, 'print(', doc_id, ') # no', {_NL}, ' ## then') ELSE 'x = 1' END AS code,
            CASE WHEN doc_id % 7 = 2 THEN concat('total 7', {_NL}, n_chars) ELSE concat(n_chars, {_NL}, 'done') END AS printed FROM s WHERE status = 'accepted')
        SELECT doc_id, status, NULL::INT AS pos, NULL AS role, NULL AS content FROM s WHERE status <> 'accepted' UNION ALL SELECT doc_id, status, 0, 'system', '{SYSTEM}' FROM p UNION ALL SELECT doc_id, status, 1, 'user', concat('Q', doc_id) FROM p
        UNION ALL SELECT doc_id, status, 2, 'assistant', concat('<think>', {_NL}, thought, {_NL}, '</think>', {_NL}, '<tool>python_execute(code=\"\"\"', code, '\"\"\")</tool>') FROM p
        UNION ALL SELECT doc_id, status, 3, 'tool', concat('[TOOL_RESULT: python_execute]', {_NL}, printed, {_NL}, '[/TOOL_RESULT]') FROM p UNION ALL SELECT doc_id, status, 4, 'assistant', concat('<answer>', n_chars, '</answer>') FROM p""",
    "e10_refusals": f"""WITH s AS (SELECT *, CASE WHEN doc_id % 5 > 1 THEN 'unclean' WHEN doc_id % 5 = 0 AND doc_id % 3 <> 1 THEN 'compliant' ELSE 'ok' END AS status FROM documents)
        SELECT doc_id, status, NULL::INT AS pos, NULL AS role, NULL AS content FROM s WHERE status <> 'ok' UNION ALL SELECT doc_id, status, 0, 'system', '{SYSTEM}' FROM s WHERE status = 'ok' UNION ALL SELECT doc_id, status, 1, 'user', concat('Q', doc_id) FROM s WHERE status = 'ok'
        UNION ALL SELECT doc_id, status, 2, 'assistant', CASE WHEN doc_id % 5 = 0 THEN concat({_THINK}, {_NL}, '<answer>No. ```x```</answer>') ELSE concat({_WRAPPED}, {_NL}, '<answer>', source, ': no</answer>') END FROM s WHERE status = 'ok'""",
    "e11_clarifications": f"""WITH s AS (SELECT *, {K} AS k FROM documents), b AS (SELECT *, CASE doc_id % 6 WHEN 1 THEN 'B_negative' WHEN 5 THEN 'B_negative' WHEN 3 THEN 'bad_question' WHEN 0 THEN CASE WHEN k % 2 > 0 THEN 'no_answer' WHEN k % 3 > 0 THEN 'unresolved' ELSE 'B' END ELSE 'unclean' END AS branch FROM s)
        SELECT doc_id, branch, NULL::INT AS pos, NULL AS role, NULL AS content FROM b WHERE branch NOT IN ('B', 'B_negative') UNION ALL SELECT doc_id, branch, 0, 'system', '{SYSTEM}' FROM b WHERE branch IN ('B', 'B_negative') UNION ALL SELECT doc_id, branch, 1, 'user', concat('Q', doc_id) FROM b WHERE branch IN ('B', 'B_negative')
        UNION ALL SELECT doc_id, branch, 2, 'assistant', CASE doc_id % 6 WHEN 0 THEN concat({_WRAPPED}, {_NL}, '<ask>Which ', source, '?</ask>') WHEN 1 THEN concat({_THINK}, {_NL}, '<answer>a ', lang, '</answer>') ELSE concat({_THINK}, {_NL}, '<act>do</act>') END FROM b WHERE branch IN ('B', 'B_negative')
        UNION ALL SELECT doc_id, branch, 3, 'user', 'this one' FROM b WHERE branch = 'B' UNION ALL SELECT doc_id, branch, 4, 'assistant', concat({_THINK}, {_NL}, '<act>go</act>') FROM b WHERE branch = 'B'""",
    "x27_appraisals": f"""WITH {_APPRAISED} SELECT vec_id, valence / 10000.0::DOUBLE AS valence, top3, concat(said, ' → ', CASE {" ".join(f"WHEN {' AND '.join(f'{n} {sign} {x}' for n, sign, x in cs)} THEN '{t}'" for cs, t in P.STORIES)} ELSE concat('user is experiencing ', coalesce(emotion, 'neutral'), ' — respond with attentive, personalised empathy') END) AS reading,
        significant, agency / 10000.0::DOUBLE AS agency, fairness / 10000.0::DOUBLE AS fairness FROM w""",
    "e12_kept": f"""WITH {_APPRAISED} SELECT NULL AS emotion, count(*) AS n, count(*) FILTER (significant) AS kept, round(count(*) FILTER (significant) / count(*), 4)::DOUBLE AS share FROM w
        UNION ALL SELECT coalesce(emotion, ''), count(*), count(*) FILTER (significant), round(count(*) FILTER (significant) / count(*), 4) FROM w GROUP BY emotion""",
}
