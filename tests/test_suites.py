"""Reports of any shape and with fields of any type, against plain code over the parsed JSON."""

import json
import statistics

import pytest

from millrace.functions import principles
from millrace.operators import suites

PROBES = {
    "probe_results": [
        {"id": "P4_math_code", "question_results": [
            {"question_idx": 0, "think_length": 30, "answer_content": " ten chars ", "tools_called": ["python_execute", "nope"], "metrics": {"tool_failures": {"a": 2, "b": "x", "c": [1]}, "latency_s": 1.5, "tokens_generated": 7}, "rule_passed": True, "rule_score": 1.0, "question": ["one", "two"], "combined_score": 0.5, "llm_reason": "why"},
            {"question_idx": 1, "answer_content": [{"role": "user", "content": "a"}, "b", {"x": 1}], "response": "other", "ask_content": " ? ", "think_empty": False, "harness_retries": 2, "harness_violations": ["P1", {"k": 1}], "tool_profile": "no_tools", "tools_called": ["web_search"], "rule_score": 0.0},
            {"answer_content": "", "response": "said", "rule_passed": None, "tools_called": None, "metrics": None, "response_type": "ask"},
            {"question_idx": 3, "rule_passed": True, "think_length": None, "answer_content": [], "response": None},
        ]},
        {"question_results": [{"question_idx": "x", "rule_score": 0.25, "tools_called": "web_search", "rule_passed": "yes"}]},
        {"id": "none"},
    ],
    "constitution_score": 0.4, "scores_by_principle": {"P4": 0.5}, "run_metadata": {},
}
REPORTS = [
    ("a", "constitution", PROBES),
    ("a", "categories", {"category_results": [{"category": "math", "question_results": [{"question_idx": 2, "answer": "x", "llm_score": 0.75}]}], "category_score": 0.6}),
    ("a", "drift", {"turn_results": [{"turn": 1, "response": "r"}, {"turn": 2, "rule_passed": False}], "drift_score": 0.1, "first_drift_at": 2}),
    ("a", "adversarial", {"probe_results": [{"id": "A1", "passed": True, "score": 0.5}, {"passed": False}], "adversarial_score": 0.5}),
    ("a", "persona", {"persona_results": [{"persona_id": "p", "profile": "x", "goal": "y", "transcript": "t", "judge": {"overall": 0.9, "summary": "s"}}, {"judge": None}], "persona_score": 0.9, "dimension_means": {"warm": 1}}),
    ("b", "constitution", {"probe_results": "no list", "other": 1}),
    ("c", "constitution", None),
]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(label, suite, json.dumps(r) if r is not None else "no json {") for label, suite, r in REPORTS]
    return suites.parsed(spark.createDataFrame(rows, "label string, suite string, json string"))


def test_records(reports):
    got = {r.key: r for r in suites.records(reports).collect()}
    assert set(got) == {"P4_math_code::0", "P4_math_code::1", "P4_math_code::None", "P4_math_code::3", "?::x", "cat::math::2", "drift::1", "drift::2"}
    r = got["P4_math_code::0"]
    assert (r.think_len, r.think_empty, r.answer_chars, r.ext_ratio, r.is_ask) == (30, False, 9, 30 / 39, False)
    assert (r.tools, r.n_tools, r.n_decoy, r.n_tool_fail, r.latency_s, r.tokens_gen) == (["python_execute", "nope"], 2, 1, 4, 1.5, 7.0)
    r = got["P4_math_code::1"]
    assert (r.answer_chars, r.is_ask, r.think_empty, r.retries, r.violations, r.tool_profile) == (3, True, False, 2, 2, "no_tools")
    r = got["P4_math_code::None"]
    assert (r.answer_chars, r.is_ask, r.think_empty, r.n_tools, r.rule_passed) == (4, True, True, 0, False)
    assert (got["P4_math_code::3"].answer_chars, got["P4_math_code::3"].ext_ratio) == (0, None)
    assert (got["?::x"].principle, got["?::x"].n_tools, got["cat::math::2"].suite, got["drift::1"].answer_chars) == ("?", 0, "categories", 1)


def test_vectors(reports):
    got = {(r.vector, r.key): r.value for r in suites.vectors(reports).collect()}
    assert got["hollow", "P4_math_code::3"] == 1.0 and got["hollow", "P4_math_code::0"] == 0.0 and got["rule", "P4_math_code::1"] == 0.0
    assert {k: v for k, v in got.items() if k[0] in ("combined", "adversarial", "persona")} == {("combined", "P4_math_code::0"): 0.5, ("adversarial", "A1"): 1.0, ("adversarial", "1"): 0.0, ("persona", "p"): 0.9}
    assert ("ext_ratio", "P4_math_code::3") not in got and len({k for k, _ in got}) == 8


def test_cells(reports):
    got = {(r.suite, r.key): r for r in suites.cells(reports).collect()}
    assert len(got) == 12 and {r.label for r in got.values()} == {"a"}
    r = got["constitution", "P4_math_code::0"]
    assert (r.question, r.answer, r.score, r.judge_reason) == ("one  |  two", " ten chars ", 0.5, "why")
    assert got["constitution", "P4_math_code::1"].answer.split(" ")[:2] == ["a", "b"] and got["constitution", "P4_math_code::1"].score is None
    assert (got["category", "x"].score if ("category", "x") in got else got["categories", "math::2"].score, got["categories", "math::2"].answer) == (0.75, "x")
    assert got["drift", "turn2"].score == 0.0 and got["drift", "turn1"].response == "r" and got["drift", "turn1"].score is None
    assert got["adversarial", "A1"].score == 0.5 and got["adversarial", ""].score == 0.0
    r = got["persona", "p"]
    assert (r.question, r.response, r.score, r.judge_reason) == ("x — goal: y", "t", 0.9, "s") and got["persona", ""].score is None


def test_bundle_and_summary(reports):
    got = {(r.label, r.metric, r.name): r.value for r in suites.bundle(reports).collect()}
    assert {k[0] for k in got} == {"a"}
    assert got["a", "principle", "P4_math_code"] == 0.5 and got["a", "family", "tool"] == 0.5 and got["a", "tier", "3"] == pytest.approx(0.375)
    assert got["a", "constitution", "overall_rule"] == pytest.approx(0.375) and got["a", "framing", "unknown"] == 0.25
    assert got["a", "depth", "think_len_median"] == statistics.median([30, 0, 0, 0, 0]) and got["a", "tool", "distinct_tools"] == 3
    assert got["a", "tool", "tool_fail_rate"] == pytest.approx(4 / 3) and got["a", "tool", "unnecessary_tool_rate"] == 1.0
    assert (got["a", "categories", "overall"], got["a", "drift", "first_drift_at"], got["a", "adversarial", "overall"]) == (0.6, 2.0, 0.5)
    rows = {r.label: r for r in suites.summary(reports).collect()}
    assert rows["a"].scores_by_principle == {"P4": 0.5} and rows["a"].persona_dimension_means == {"warm": 1.0} and rows["a"].first_drift_at == 2
    assert tuple(rows["b"])[1:] == (None,) * 7 == tuple(rows["c"])[1:]


def test_the_weighted_mean_is_by_tier(spark):
    rows = {r.principle: r for r in principles.dimension(spark).collect()}
    assert len(rows) == 23 and (rows["P5_realtime_honesty"].weight, rows["P9_no_winner"].weight, rows["P4_math_code"].weight) == (3.0, 2.0, 1.0)


def test_no_reports(reports):
    none = reports.limit(0)
    assert [f(none).count() for f in (suites.records, suites.vectors, suites.cells, suites.bundle, suites.summary)] == [0] * 5
