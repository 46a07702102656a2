"""Rows built from replies, and appraisals, on cases whose results are known."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import acceptance as A
from millrace.operators import appraisal as P

LONG = "so it goes on and on, " * 10


def one(spark, f, kind, *row):
    return f(spark.createDataFrame([row], kind), "S").first()


@pytest.mark.parametrize("reply, printed, expected, status, computed", [
    ('<tool>python_execute(code="""a""")</tool>', "x 1.5\ny 2,000", "1.5", "wrong", "2"), ('<tool>python_execute(code="""a""")</tool>', "7\n-.5\nend", "-0.5", "accepted", "-.5"), ("```\na\n```", "100.4", "100", "accepted", "100.4"), ("```\na\n```", "102", "100", "wrong", "102"),
    ("```python\na\n```", "", "1", "no_number", None), ("```python\na\n```", None, "1", "failed", None), ("none", "1", "1", "no_code", "1"), (None, "1", "1", "no_code", "1"), ("```\na\n```", "0", "0", "accepted", "0"), ("```\na\n```", "3", "n/a", "wrong", "3"),
])
def test_solutions(spark, reply, printed, expected, status, computed):
    r = one(spark, A.solutions, "question string, expected string, reply string, printed string", "Q", expected, reply, printed)
    assert (r.status, r.computed, r.messages is not None) == (status, computed, status == "accepted")


def test_reasoning_of_a_solution(spark):
    thought = lambda reply: one(spark, A.solutions, "question string, expected string, reply string, printed string", "Q", "1", reply, " 1 ").messages[2].content
    assert thought('<think> a\nb </think><tool>python_execute(code="""\n# c\nx\n""")</tool>') == '<think>\na\nb\n</think>\n<tool>python_execute(code="""# c\nx""")</tool>'
    assert thought("prose <tool>python_execute(code='x')</tool>").startswith("<think>\nprose\n</think>")
    assert thought("```\nx\n# one\n#\n  ## two #\n```").startswith(f"<think>\n{A.STEPS}\n\n- one\n- two #\n</think>")
    assert thought("```\nx\n```").startswith(f"<think>\n{A.STEPS}\n</think>")


@pytest.mark.parametrize("category, reply, status", [
    ("malware", f"{LONG}<answer>no</answer>", "ok"), ("malware", f"{LONG}<answer>```x```</answer>", "compliant"), ("fraud", f"{LONG}<answer>```x```</answer>", "ok"), (None, f"<think>{LONG}</think><answer>no</answer>", "ok"),
    ("fraud", f"{LONG}<act>no</act>", "unclean"), ("fraud", "<think>short</think><answer>no</answer>", "unclean"), ("fraud", LONG, "unclean"), ("fraud", None, "unclean"),
])
def test_refusals(spark, category, reply, status):
    r = one(spark, A.refusals, "category string, question string, reply string", category, "Q", reply)
    assert (r.status, r.messages is not None) == (status, status == "ok")


@pytest.mark.parametrize("first, human, second, branch, n", [
    (f"{LONG}<ask>what?</ask>", "this", f"{LONG}<act>go</act>", "B", 5), (f"{LONG}<answer>x</answer>", None, None, "B_negative", 3), (f"{LONG}<act>x</act><answer>y</answer>", None, None, "B_negative", 3),
    (f"{LONG}<ask>what? who?</ask>", "this", f"{LONG}<act>go</act>", "bad_question", 0), (f"{LONG}<ask> </ask>", "this", f"{LONG}<act>go</act>", "bad_question", 0), (f"{LONG}<ask>what?</ask>", " ", f"{LONG}<act>go</act>", "no_answer", 0),
    (f"{LONG}<ask>what?</ask>", "this", "<act>go</act>", "unresolved", 0), (f"{LONG}<ask>what?</ask>", "this", f"{LONG}<ask>again?</ask>", "unresolved", 0), (f"{LONG}<ask>what?</ask>", "this", None, "unresolved", 0), ("<ask>what?</ask>", "this", f"{LONG}<act>go</act>", "unclean", 0), (None, None, None, "unclean", 0),
])
def test_clarifications(spark, first, human, second, branch, n):
    r = one(spark, A.clarifications, "question string, first string, human string, second string", "Q", first, human, second)
    assert (r.branch, len(r.messages or [])) == (branch, n)


def appraise(spark, emotion=None, **values):
    v = [values.get(n, 0.5) for n in P.DIMENSIONS]
    return P.appraised(spark.createDataFrame([(v, emotion)], "v array<double>, e string"), F.col("v"), F.col("e")).first()


def test_appraisals(spark):
    r = appraise(spark, pleasantness=0.9, goal_relevance=0.65, fairness=0.1, attention=1.0)
    assert (r.top3, r.valence, r.significant) == (["fairness", "pleasantness", "goal_relevance"], 0.7, False)
    assert r.reading.startswith("low fairness, high pleasantness, high goal relevance → user is experiencing a positive")
    r = appraise(spark, "joy", unpleasantness=0.65, self_control=0.65)
    assert r.top3[:2] == ["self_control", "unpleasantness"] and "stressed but feels capable" in r.reading  # in the order of the dimensions where level
    assert "experiencing joy" in appraise(spark, "joy").reading and "experiencing neutral" in appraise(spark).reading and appraise(spark).top3 == ["goal_relevance", "self_control", "fairness"]
    assert appraise(spark, coping_potential=0.39).significant and not appraise(spark, coping_potential=0.4).significant and appraise(spark, pleasantness=1.0, unpleasantness=0.3).significant
    df = spark.createDataFrame([(None, "a"), ([0.1], None)], "v array<double>, e string")
    rows = P.appraised(df, F.col("v"), F.col("e"))
    assert [r.valence for r in rows.collect()] == [0.5, 0.5]
    assert {r.e: (r.n, r.kept) for r in P.kept_share(rows, "e").collect()} == {None: (2, 0), "a": (1, 0), "": (1, 0)}
