"""Appraisals of utterances: 21 dimensions named, valence, the three most extreme of those that matter, a reading in words, and whether they carry a signal.

All is expressions within the row. Values are rounded to four decimals and compared as whole ten-thousandths, so that equal distances are
ties on any engine. A vector that is null or shorter than 21 has null values, which count as 0.5; a null emotion is called neutral.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scoring import strings

#: The dimensions in order, and those that matter for a reply. Fixed values.
DIMENSIONS = (
    "suddenness", "familiarity", "predictability", "intrinsic_pleasantness", "goal_relevance", "chance_success", "causal_agent_other", "causal_agent_self", "self_control", "other_control", "situation_control",
    "anticipated_effort", "fairness", "norm_violation", "self_consistency", "unpleasantness", "pleasantness", "coping_potential", "meaning_significance", "attention", "agency",
)
EMPATHY = ("pleasantness", "unpleasantness", "goal_relevance", "coping_potential", "meaning_significance", "self_control", "fairness")
#: From where a valence, a coping potential and a relevance carry a signal, in ten-thousandths. Fixed values.
VALENCE, COPING, GOAL = 3000, 4000, 7000
#: What a reading ends with, by the first condition that holds (in ten-thousandths). Fixed values.
STORIES = (
    ((("pleasantness", ">", 7000), ("goal_relevance", ">", 6000)), "user is experiencing a positive, goal-relevant outcome — respond with warm acknowledgement"),
    ((("unpleasantness", ">", 7000), ("coping_potential", "<", 4000)), "user is in distress with low coping capacity — respond with empathetic validation before any advice"),
    ((("goal_relevance", ">", 7000), ("self_control", "<", 4000)), "user faces a high-stakes situation outside their control — acknowledge the difficulty first"),
    ((("unpleasantness", ">", 6000), ("self_control", ">", 6000)), "user is stressed but feels capable of handling it — supportive and practical tone"),
    ((("pleasantness", "<", 4000), ("goal_relevance", ">", 6000)), "user is disappointed about something that matters — validate the feeling before problem-solving"),
)


def appraised(rows: DataFrame, vector: Column, emotion: Column) -> DataFrame:
    """rows with appraisal (map of the 21 values), top3, valence, reading and significant."""
    tenths = F.struct(*[F.coalesce(F.round(F.get(vector, F.lit(i)).cast("double") * 10000), F.lit(5000.0)).cast("long").alias(n) for i, n in enumerate(DIMENSIONS)])
    out = rows.withColumn("__v", tenths).withColumn("__emotion", F.coalesce(emotion, F.lit("neutral")))
    at = lambda n: F.col(f"__v.{n}")
    matter = [n for n in DIMENSIONS if n in EMPATHY]
    far = F.array_sort(F.array(*[F.struct((-F.abs(at(n) - 5000)).alias("far"), F.lit(i).alias("i"), F.lit(n).alias("name"), at(n).alias("x")) for i, n in enumerate(matter)]))
    out = out.withColumn("__top", F.slice(far, 1, 3))
    # Half a ten-thousandth is rounded up.
    valence = F.expr("(__v.pleasantness + 10000 - __v.unpleasantness + 1) div 2")
    story = F.concat(F.lit("user is experiencing "), F.col("__emotion"), F.lit(" — respond with attentive, personalised empathy"))
    for conditions, said in reversed(STORIES):
        (one, two) = (at(n) > x if sign == ">" else at(n) < x for n, sign, x in conditions)
        story = F.when(one & two, said).otherwise(story)
    level = lambda t: F.concat(F.when(t["x"] > 5000, "high ").otherwise("low "), F.replace(t["name"], F.lit("_"), F.lit(" ")))
    reading = F.concat(F.array_join(F.transform("__top", level), ", "), F.lit(" → "), story)
    return out.withColumns(
        {
            "appraisal": F.map_from_arrays(strings(DIMENSIONS), F.array(*[at(n) / 10000.0 for n in DIMENSIONS])),
            "top3": F.transform("__top", lambda t: t["name"]),
            "valence": valence / 10000.0,
            "reading": reading,
            "significant": (F.abs(valence - 5000) > VALENCE) | (at("coping_potential") < COPING) | (at("goal_relevance") > GOAL),
        }
    ).drop("__v", "__emotion", "__top")


def kept_share(appraisals: DataFrame, by: str) -> DataFrame:
    """by (null: all), n, kept and share of appraisals that carry a signal."""
    sets = appraisals.groupingSets([[], [by]], by).agg(F.grouping(by).alias("whole"), F.count("*").alias("n"), F.count_if("significant").alias("kept"))
    return sets.select(F.when(F.col("whole") == 0, F.coalesce(by, F.lit(""))).alias(by), "n", "kept", F.round(F.try_divide("kept", "n"), 4).alias("share"))
