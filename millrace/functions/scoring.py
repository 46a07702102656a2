"""Row-level scores: reward components, harness violations, a rule table compiled into one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

WEIGHTS = {"format": 0.20, "accuracy": 0.35, "tool_integrity": 0.10, "tool_quality": 0.15, "constitution": 0.10, "greedy_followup": 0.10}
#: Tools by profile, all known tools, and categories by kind. Fixed values.
PROFILES = {
    "all_tools": ("python_execute", "web_search", "read_url", "get_datetime"),
    "compute_only": ("python_execute",),
    "compute_and_search": ("python_execute", "web_search", "read_url"),
    "no_tools": (),
}
ALWAYS_ON = ("user_memory_sections", "user_memory_read", "user_memory_update", "scratchpad_sections", "scratchpad_read", "scratchpad_update")
KNOWN = (*PROFILES["all_tools"], *ALWAYS_ON)
MATH = ("arithmetic", "algebra", "geometry", "statistics", "math_arithmetic", "math_algebra", "math_geometry", "math_statistics", "gsm8k")
GREEDY = ("first_principles_questioning", "user_context_behavioral", "ambiguous_underspecified", "multi_step_clarification", "appraisal_empathy", "subjective_tradeoffs")
#: Wordings of a follow-up question about the user: axes in capitals, and phrases in any case. Fixed values.
AXES = r"\b(WHO|WHAT|WHEN|WHERE|WHY|HOW)\b"
ABOUT_USER = (
    r"(?i)your\s+\b(why|who|what|when|where|how|situation|context|background|goal|motivation|reason|timeline|use\s+case|role|setup)\b"
    r"|\bwhy\s+(are\s+you|do\s+you|did\s+you|would\s+you|is\s+this)\b"
    r"|\bwho\s+(are\s+you|is\s+this|is\s+the)\b"
    r"|\bwhat\s+(is\s+your|are\s+you|does\s+your|specifically|exactly)\b"
    r"|\bwhen\s+(do\s+you|are\s+you|is\s+this|is\s+your)\b"
    r"|\bwhere\s+(are\s+you|do\s+you|is\s+this|does\s+this)\b"
    r"|\bhow\s+(do\s+you|are\s+you|does\s+your|would\s+you|much)\b"
    r"|tell\s+me\s+(more\s+)?(about\s+)?(your|who|why|what|how|when|where)\b"
    r"|to\s+(give|help)\s+(you\s+)?(more|better|a\s+sharper|sharper)"
    r"|\b5w\+?h\b"
)


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tools_of(profile: Column, default: str | None = None) -> Column:
    """Tools of a profile; of an unknown one those of default, or none."""
    out = strings(PROFILES[default] if default else ())
    for name, tools in PROFILES.items():
        out = F.when(profile == name, strings(tools)).otherwise(out)
    return out


def format_reward(r: Column) -> Column:
    """Structure: both tags, and reasoning of substance between them."""
    n = T.think_length(r)
    return (
        F.when(~(T.opens(r, "think") & T.opens(r, "answer")), 0.0)
        .when(n == 0, 0.15)
        .when(n < 40, 0.4)
        .when(F.contains(r, F.lit("CAPABILITY_CHECK")), 0.6)
        .when(n < 100, 0.75)
        .otherwise(1.0)
    )


def accuracy_reward(r: Column, expected: Column, category: Column, output: Column) -> Column:
    """Verifiable answers: output is what the response's code printed (null: none ran, or it failed)."""
    answer = T.tag_body(r, "answer")
    mental = T.has_tag(r, "answer") & F.coalesce(T.numbers_match(T.last_number(answer), expected), F.lit(False))
    ran = F.coalesce(T.numbers_match(T.last_number(output), expected), F.lit(False))
    neutral = F.coalesce(expected == "", F.lit(True)) | ~category.isin(*MATH)
    code = T.code_blocks(r)
    return F.when(neutral, 0.5).when(F.size(code) == 0, F.when(mental, 0.3).otherwise(0.0)).when(F.exists(code, trivial), 0.0).when(ran, 1.0).otherwise(0.0)


def integrity_reward(called: Column, active: Column) -> Column:
    """No unknown tool, and none that the profile withholds."""
    unknown = F.array_except(called, strings(KNOWN))
    withheld = F.array_except(F.array_intersect(called, strings(PROFILES["all_tools"])), active)
    return F.when((F.size(unknown) > 0) | (F.size(withheld) > 0), 0.0).otherwise(1.0)


#: Code of fewer characters does nothing.
LEAST_CODE = 5


def trivial(code: Column) -> Column:
    """Whether code is too short to do anything."""
    return F.length(T.strip(F.coalesce(code, F.lit("")))) < LEAST_CODE


def empty_code(r: Column) -> Column:
    """Whether a call of python_execute, native or XML, has trivial code."""
    native = F.exists(T.call_bodies(r), lambda b: (T.call_name(b) == "python_execute") & trivial(T.call_argument(b, "code")))
    xml = F.filter(F.regexp_extract_all(r, F.lit(r"(?s)<tool>(.*?)</tool>"), 1), lambda b: b.rlike(r"^\s*python_execute\s*\("))
    return F.coalesce(native, F.lit(False)) | F.exists(xml, lambda b: trivial(F.get(T.code_blocks(b), F.lit(0))))


def quality_reward(r: Column, called: Column, active: Column, category: Column) -> Column:
    """The right tool for the question: each lapse multiplies the score; a call of code without any is 0."""
    timed = F.array_intersect(active, strings(("get_datetime", "web_search")))
    return F.when(empty_code(r), 0.0).otherwise(
        F.when(category.isin("real_time_dependent", "real_time_data") & (F.size(timed) > 0) & (F.size(F.array_intersect(called, timed)) == 0), 0.1).otherwise(1.0)
        * F.when(category.isin("user_context_behavioral", "verbose_context_behavioral") & ~F.arrays_overlap(called, strings(("user_memory_read", "user_memory_sections"))), 0.4).otherwise(1.0)
        * F.when((category == "entity_facts_web_search") & F.array_contains(active, "web_search") & ~F.array_contains(called, "web_search"), 0.05).otherwise(1.0)
        * F.when(category.isin(*MATH) & F.array_contains(active, "python_execute") & ~F.array_contains(called, "python_execute"), 0.2).otherwise(1.0)
    )


def followup_reward(r: Column, category: Column) -> Column:
    """The answer ends with a question about the user."""
    answer = T.strip(T.tag_body(r, "answer"))
    last = T.last_sentence(answer)
    asked = F.endswith(last, F.lit("?"))
    return (
        F.when(~category.isin(*GREEDY), 0.5)
        .when(~T.has_tag(r, "answer"), 0.0)
        .when(~asked, F.when(F.contains(answer, F.lit("?")), 0.3).otherwise(0.0))
        .when(last.rlike(AXES) | last.rlike(ABOUT_USER), 1.0)
        .otherwise(0.7)
    )


def structure_reward(r: Column) -> Column:
    n = T.opens(r, "think").cast("int") + T.opens(r, "answer").cast("int")
    return F.when(n == 2, 1.0).when(n == 1, 0.5).otherwise(0.0)


def composite(parts: dict[str, Column], names: Sequence[str] = tuple(WEIGHTS)) -> Column:
    """Weighted sum; of some components only, with weights that sum to one again."""
    total = sum(WEIGHTS[n] for n in names)
    out = F.lit(0.0)
    for n in names:
        out = out + parts[n] * F.lit(WEIGHTS[n] / total)
    return out


#: Words that call for arithmetic. Fixed value.
MATH_SIGNAL = r"(?i)\b(calculate|compute|how many|total|percent|sum of|average|costs?)\b|\d+\s*[-+*/%]\s*\d+"
FIRST_PRINCIPLES = (
    r"(?i)\b(fundamental(ly)?|first principles?|core (question|problem)|non-negotiable|constraints?)\b"
    r"|\bwhat is (fundamentally|actually|really) being asked\b|\b5w\+?h\b|\b(who|what|when|where|why|how)\s+(is|are|do|does|did|would|am|have)\b"
)


def harness_violations(r: Column, question: Column, active: Column, pad_open: Column) -> Column:
    """Codes of the broken principles, in order. pad_open: tasks that the scratchpad still holds (null: no scratchpad)."""
    called = F.array_union(F.regexp_extract_all(r, F.lit(r"<tool>(\w+)\("), 1), F.regexp_extract_all(r, F.lit(r'"name"\s*:\s*"(\w+)"'), 1))
    think = F.regexp_extract(r, r"(?is)<think\b.*?</think>", 0)
    answer = T.strip(T.tag_body(r, "answer"))
    last = T.last_sentence(answer)
    code = r.rlike(r'<tool>\s*python_execute|"name"\s*:\s*"python_execute"')
    asked = F.endswith(last, F.lit("?")) & (last.rlike(AXES) | last.rlike(ABOUT_USER))
    withheld = F.filter(F.array_except(F.array_intersect(called, strings(KNOWN)), active), lambda t: F.regexp_like(F.lower(think), F.concat(t, F.lit(r"\s+not\s+available"))))
    tests = (
        ("P1", ~r.rlike(r"(?i)<think\b")),
        ("P3", F.size(F.array_except(called, strings(KNOWN))) > 0),
        ("P3_unavailable", F.size(withheld) > 0),
        ("P4", F.array_contains(active, "python_execute") & question.rlike(MATH_SIGNAL) & ~code & r.rlike(r"(?s)<answer>.*\d[\d,.]+.*</answer>")),
        ("P18", ~r.rlike(r"(?i)<answer\b")),
        ("P20", (F.length(think) >= 20) & ~think.rlike(FIRST_PRINCIPLES)),
        ("P21", T.has_tag(r, "answer") & ~asked),
        ("P24a", pad_open.isNotNull() & (F.regexp_count(r, F.lit(r"<tool>(?!scratchpad_)")) >= 3) & ~r.rlike(r"<tool>\s*scratchpad_read")),
        ("P24b", (F.coalesce(pad_open, F.lit(0)) > 0) & r.rlike(r"(?i)<answer\b")),
    )
    return F.array_compact(F.array(*[F.when(broken, code_) for code_, broken in tests]))


def rule_case(rules: Sequence[tuple[str, int, str]], group: Column, idx: Column) -> Column:
    """A rule table (group, question, SQL condition) as one CASE; null where no rule is."""
    out = F.lit(None).cast("boolean")
    for g, i, condition in reversed(rules):
        out = F.when((group == g) & (idx == i), F.expr(condition)).otherwise(out)
    return out
