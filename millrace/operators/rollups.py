"""Summaries of judged runs, a grouping each: personas, rules scored again, retries, runs, degradation, hypotheses, the harness's gain, exposure, claims.

Nulls are left out of means; a group without anything to average has a null; nothing divides by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators.suites import at

#: The score from which a probe passes, and the change from which one condition wins over another. Fixed values.
PASSES, WINS = 0.6, 0.05
#: Principles by hypothesis. Fixed values.
HYPOTHESES = {
    "H1 (compliance)": ("P1_decompose_first", "P2P3_tool_discipline", "P4_math_code", "P5_realtime_honesty", "P6_context_gate", "P7_uncertainty", "P8_impossibility", "P14_hold_position", "P18_answer_present", "P20_first_principles"),
    "H2 (personalisation)": ("H2_memory_persistence", "P21_greedy_followup", "P16_user_memory"),
    "H3 (limits)": ("P9_no_winner", "P12_assumption_naming", "P13_multi_step", "P15_partial_capability", "P19_search_entity_facts"),
}


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def personas(reports: DataFrame) -> DataFrame:
    """label, dimension (null: overall), mean, judged and total of persona reports (VARIANT); conversations whose judge failed or gave no overall score count in total only."""
    each = reports.filter("suite = 'persona'").select("label", F.explode(at("report", "$.persona_results", "array<variant>")).alias("p"))
    valid = at("p", "$.judge.overall", "double").isNotNull() & ~F.coalesce(at("p", "$.judge.judge_failed", "boolean"), F.lit(False))
    rows = each.select("label", valid.alias("valid"), at("p", "$.judge.overall", "double").alias("overall"), at("p", "$.judge.dimensions", "map<string,variant>").alias("dimensions"))
    whole = rows.groupBy("label").agg(F.round(F.avg(F.when(F.col("valid"), F.col("overall"))), 4).alias("mean"), F.count_if("valid").alias("judged"), F.count("*").alias("total"))
    by = rows.filter("valid").select("label", F.explode("dimensions").alias("dimension", "d")).select("label", "dimension", at("d", "$.score", "double").alias("score")).filter("score IS NOT NULL")
    by = by.groupBy("label", "dimension").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("judged")).join(whole.select("label", "total"), "label")
    return whole.select("label", F.lit(None).cast("string").alias("dimension"), "mean", "judged", "total").unionByName(by)


def rescored(items: DataFrame) -> DataFrame:
    """label, group_id (null: all), n, saved, replicated, traced, delta, drifts and matched of probes scored again by the rules.

    items: label, group_id, idx, response, trace (names of the tools that ran) and passed (the saved verdict). replicated reads calls from the
    responses, traced from the trace; an item without a rule keeps its verdict. A probe's score is its items' share; over all, the share of probes that pass.
    """
    of = rules.parts(F.col("response"))
    trace = F.coalesce("trace", F.array().cast("array<string>"))
    again = lambda tools: F.coalesce(rules.verdict(F.col("group_id"), F.col("idx"), of, tools), F.col("saved"))
    rows = items.withColumn("saved", F.coalesce("passed", F.lit(False)))
    rows = rows.select("label", "group_id", "saved", again(rules.calls(F.col("response"), F.lit(None).cast("array<string>"))).alias("replicated"), again(trace).alias("traced"), F.col("group_id").isin(*rules.PROBES, *[n for names in rules.ATTACKS.values() for n in names]).alias("matched"))
    names = ("saved", "replicated", "traced")
    per = rows.groupBy("label", "group_id").agg(F.count("*").alias("n"), *[_share(F.col(c)).alias(c) for c in names], F.max("matched").alias("matched"))
    whole = per.groupBy("label").agg(F.count("*").alias("n"), *[_share(F.col(c) >= PASSES).alias(c) for c in names], F.min("matched").alias("matched")).withColumn("group_id", F.lit(None).cast("string"))
    out = per.unionByName(whole)
    return out.select("label", "group_id", "n", *[F.round(c, 4).alias(c) for c in names], F.round(F.col("traced") - F.col("replicated"), 4).alias("delta"), (F.abs(F.col("replicated") - F.col("saved")) > 1e-9).alias("drifts"), "matched")


def retries(records: DataFrame) -> DataFrame:
    """label, principle and mean retries of probe records."""
    return records.groupBy("label", "principle").agg(F.round(F.avg("retries"), 2).alias("mean_retries"))


def catalogue(reports: DataFrame) -> DataFrame:
    """label, suite, model, said_at and score of every run; of the scores that a report has the first that isn't zero."""
    score = lambda name: at("report", f"$.{name}", "double")
    first = [F.nullif(score(n), F.lit(0.0)) for n in ("constitution_score", "adversarial_score", "category_score")]
    text = lambda path: F.coalesce(at("report", path), F.lit("?"))
    return reports.filter("suite <> 'persona'").select("label", "suite", text("$.run_metadata.model_label").alias("model"), text("$.timestamp").alias("said_at"), F.coalesce(*first, score("drift_score")).alias("score"))


def degradation(turns: DataFrame) -> DataFrame:
    """label, scored, correct, share, first_failure (turn) and idle_calls (turns that call a tool without need) of turns (label, turn, correct: null if not scored, n_tools, requires_tool)."""
    needless = (F.col("n_tools") > 0) & ~F.coalesce("requires_tool", F.lit(False))
    return turns.groupBy("label").agg(
        F.count("correct").alias("scored"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"), F.round(_share(F.col("correct")), 4).alias("share"), F.min(F.when(~F.col("correct"), F.col("turn"))).alias("first_failure"), F.count_if(needless).alias("idle_calls")
    )


def hypothesis(principle: Column) -> Column:
    """The hypothesis that a principle belongs to."""
    out = F.lit("other")
    for name, own in HYPOTHESES.items():
        out = F.when(principle.isin(*own), name).otherwise(out)
    return out


def hypotheses(scores: DataFrame, a: str, b: str) -> DataFrame:
    """hypothesis, mean_delta, wins, losses and n of condition b against a; scores: label, principle, score. A principle that one of them lacks counts as 0 there."""
    of = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("score"))), F.lit(0.0))
    rows = scores.filter(F.col("label").isin(a, b)).groupBy("principle").agg(F.round(of(b) - of(a), 4).alias("delta"))
    return rows.groupBy(hypothesis(F.col("principle")).alias("hypothesis")).agg(F.round(F.avg("delta"), 6).alias("mean_delta"), F.count_if(F.col("delta") > WINS).alias("wins"), F.count_if(F.col("delta") < -WINS).alias("losses"), F.count("*").alias("n"))


def gains(scores: DataFrame, without: Column, within: Column) -> DataFrame:
    """principle (null: all) and gain of runs with a harness over those without; scores: principle, score. Principles that only runs with it have are left out."""
    rows = scores.groupBy("principle").agg(F.avg(F.when(without, F.col("score"))).alias("a"), F.avg(F.when(within, F.col("score"))).alias("b"))
    whole = rows.agg(F.round(F.avg("b") - F.avg("a"), 4).alias("gain")).select(F.lit(None).cast("string").alias("principle"), "gain")
    return rows.filter("a IS NOT NULL").select("principle", F.round(F.coalesce("b", F.lit(0.0)) - F.col("a"), 4).alias("gain")).unionByName(whole)


def exposure(judged: DataFrame, modes: tuple[str, ...] = ("full", "bare", "none")) -> DataFrame:
    """label, the mean score in each mode of what the judge is told, and gap (full - none); judged: label, mode, score."""
    wide = judged.groupBy("label").pivot("mode", list(modes)).agg(F.round(F.avg("score"), 4))
    return wide.withColumn("gap", F.round(F.col("full") - F.col("none"), 4))


def claims(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """id, score (mean confidence), total and verified of every answer; one without a claim scores 1. checked: id, verified, confidence."""
    per = checked.groupBy("id").agg(F.round(F.avg("confidence"), 4).alias("score"), F.count("*").alias("total"), F.count_if("verified").alias("verified"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return answers.select("id").join(per, "id", "left").select("id", zero("score", 1.0), zero("total", 0), zero("verified", 0))
