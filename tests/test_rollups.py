"""Summaries of judged runs on rows whose results are known."""

import json

from pyspark.sql import functions as F

from millrace.operators import rollups, suites


def reports(spark, *rows):
    return suites.parsed(spark.createDataFrame([(label, suite, json.dumps(r)) for label, suite, r in rows], "label string, suite string, json string"))


def rows(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def test_personas(spark):
    judge = lambda overall, **more: {"judge": {"overall": overall, **more}}
    r = reports(spark, ("a", "persona", {"persona_results": [judge(0.5, dimensions={"warm": {"score": 1}, "deep": {}}), judge(1.0, dimensions={"warm": {"score": 0}}), judge(0.1, judge_failed=True, dimensions={"warm": {"score": 9}}), judge(None), {"judge": "x"}, {}]}), ("b", "persona", {"persona_results": [{}]}), ("c", "drift", {}))
    assert rows(rollups.personas(r)) == {("a", None): (0.75, 2, 6), ("a", "warm"): (0.5, 2, 6), ("b", None): (None, 0, 1)}


def test_rescored(spark):
    call = '<tool>python_execute(code="1")</tool>'
    items = [("x", "P4_math_code", 0, "no call", ["python_execute"], False), ("x", "P4_math_code", 1, call, None, True), ("x", "P4_math_code", 2, call, [], None), ("x", "gone", 0, "x", None, True), ("x", "P4_math_code", 9, "x", None, True)]
    df = spark.createDataFrame(items, "label string, group_id string, idx int, response string, trace array<string>, passed boolean")
    got = rows(rollups.rescored(df))
    assert got["x", "P4_math_code"] == (4, 0.5, 0.75, 0.5, -0.25, True, True) and got["x", "gone"] == (1, 1.0, 1.0, 1.0, 0.0, False, False)
    assert got["x", None] == (2, 0.5, 1.0, 0.5, -0.5, True, False)


def test_runs(spark):
    r = reports(spark, ("a", "constitution", {"constitution_score": 0.0, "category_score": 0.4, "run_metadata": {"model_label": "m"}, "timestamp": "t"}), ("a", "drift", {"drift_score": 0.0}), ("a", "adversarial", {}), ("a", "persona", {"persona_score": 1}))
    assert rows(rollups.catalogue(r)) == {("a", "constitution"): ("m", "t", 0.4), ("a", "drift"): ("?", "?", 0.0), ("a", "adversarial"): ("?", "?", None)}


def test_degradation(spark):
    turns = [("a", 1, None, 1, False), ("a", 2, True, 0, True), ("a", 5, False, 2, True), ("a", 4, False, 1, None), ("b", 1, None, 0, False)]
    df = spark.createDataFrame(turns, "label string, turn int, correct boolean, n_tools int, requires_tool boolean")
    assert {r.label: tuple(r)[1:] for r in rollups.degradation(df).collect()} == {"a": (3, 1, 0.3333, 4, 2), "b": (0, 0, None, None, 0)}


def test_hypotheses_and_gains(spark):
    scores = spark.createDataFrame([("a", "P4_math_code", 0.5), ("b", "P4_math_code", 0.6), ("b", "P5_realtime_honesty", 0.04), ("a", "P9_no_winner", 0.5), ("a", "P17", 0.2), ("b", "P17", 0.2), ("c", "P17", 0.9)], "label string, principle string, score double")
    got = {r.hypothesis: tuple(r)[1:] for r in rollups.hypotheses(scores, "a", "b").collect()}
    assert got == {"H1 (compliance)": (0.07, 1, 0, 2), "H3 (limits)": (-0.5, 0, 1, 1), "other": (0.0, 0, 0, 1)}
    got = {r.principle: r.gain for r in rollups.gains(scores, F.col("label") == "a", F.col("label") == "b").collect()}
    assert got == {"P4_math_code": 0.1, "P9_no_winner": -0.5, "P17": 0.0, None: -0.12}


def test_exposure_and_claims(spark):
    judged = spark.createDataFrame([("a", "full", 0.5), ("a", "full", None), ("a", "none", 0.25), ("b", "bare", 1.0)], "label string, mode string, score double")
    assert {r.label: tuple(r)[1:] for r in rollups.exposure(judged).collect()} == {"a": (0.5, None, 0.25, 0.25), "b": (None, 1.0, None, None)}
    checked = spark.createDataFrame([(1, True, 0.9), (1, False, 0.2)], "id long, verified boolean, confidence double")
    assert {r.id: tuple(r)[1:] for r in rollups.claims(spark.range(1, 3), checked).collect()} == {1: (0.55, 2, 1), 2: (1.0, 0, 0)}


def test_empty_tables(spark):
    none = reports(spark, ("a", "persona", {})).limit(0)
    assert rollups.personas(none).count() == 0 == rollups.catalogue(none).count() == rollups.retries(suites.records(none)).count()
