"""The scored principles as a dimension: family, framing, tier and weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, family, framing and tier of each principle, and the weights of tiers. Fixed values.
PRINCIPLES = (
    ("P1_decompose_first", "reasoning", "positive", 2),
    ("P2P3_tool_discipline", "tool", "negative", 3),
    ("P4_math_code", "tool", "positive", 3),
    ("P5_realtime_honesty", "honesty", "calibration", 1),
    ("P6_context_gate", "personalisation", "positive", 1),
    ("P7_uncertainty", "honesty", "calibration", 1),
    ("P8_impossibility", "honesty", "negative", 1),
    ("P9_no_winner", "robustness", "negative", 2),
    ("P10_correct_tool_use", "tool", "positive", 3),
    ("P11_tool_avoidance", "tool", "negative", 3),
    ("P12_tool_failure", "tool", "calibration", 3),
    ("P13_no_tool_faking", "tool", "negative", 1),
    ("P14_hold_pressure", "robustness", "negative", 2),
    ("P15_self_correction", "reasoning", "positive", 2),
    ("P16_cutoff_awareness", "honesty", "calibration", 1),
    ("P17_single_question", "personalisation", "positive", 1),
    ("P18_explicit_dont_know", "honesty", "negative", 1),
    ("P19_search_entity_facts", "tool", "calibration", 3),
    ("P20_first_principles", "reasoning", "positive", 2),
    ("P21_greedy_followup", "reasoning", "positive", 1),
    ("H2_memory_persistence", "personalisation", "positive", 2),
    ("H2b_memory_retention_multiturn", "personalisation", "positive", 2),
    ("P22_scratchpad_multistep", "tool", "positive", 3),
)
WEIGHTS = {1: 3.0, 2: 2.0, 3: 1.0}
#: Tier of a principle that the dimension lacks.
OTHER_TIER = 3


def dimension(spark: SparkSession) -> DataFrame:
    """principle, family, framing, tier and weight: one row for each principle."""
    return spark.createDataFrame([(*p, WEIGHTS[p[3]]) for p in PRINCIPLES], "principle string, family string, framing string, tier int, weight double")
