"""Ranks of conditions per question, and what is summed up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition_ranks(scores: DataFrame, question: list[str], label: str, score: str) -> DataFrame:
    """scores with place: equal scores share the best place; a missing score counts as -1."""
    order = F.coalesce(F.col(score), F.lit(-1.0)).desc()
    return scores.withColumn("place", F.rank().over(Window.partitionBy(*question).orderBy(order)))


def beat_credit(ranked: DataFrame, question: list[str], averaged: bool = True) -> DataFrame:
    """ranked with n (labels), tied and credit: the share of rivals beaten, a tied rival counting half (or, not averaged, fully)."""
    w = Window.partitionBy(*question)
    rows = ranked.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("tied", F.count(F.lit(1)).over(w.partitionBy(*question, "place")))
    shift = (F.col("tied") - 1) / 2.0 if averaged else F.lit(0.0)
    return rows.withColumn("credit", F.when(F.col("n") > 1, (F.col("n") - F.col("place") - shift) / (F.col("n") - 1)).otherwise(F.lit(1.0)))


def win_share(place: Column, tied: Column) -> Column:
    """A win is shared by those tied for the first place."""
    return F.when(place == 1, 1.0 / tied).otherwise(F.lit(0.0))


def head_to_head(credited: DataFrame, label: str, suite: str, weight: Column) -> DataFrame:
    """label, suite (null: all), n, wins, h2h, mean_place, weighted_h2h; both levels from one scan by grouping sets."""
    rows = credited.withColumn("__win", win_share(F.col("place"), F.col("tied"))).withColumn("__w", weight)
    return rows.groupingSets([[label], [label, suite]], label, suite).agg(
        F.count("*").alias("n"),
        F.sum("__win").alias("wins"),
        F.avg("credit").alias("h2h"),
        F.avg("place").alias("mean_place"),
        F.try_divide(F.sum(F.col("__w") * F.col("credit")), F.sum("__w")).alias("weighted_h2h"),
    )


def duels(ranked: DataFrame, question: list[str], label: str) -> DataFrame:
    """a, b, n, a_ahead, level: how two conditions compare over shared questions. A question has few labels, so pairs stay few."""
    left = ranked.select(*question, F.col(label).alias("a"), F.col("place").alias("pa"))
    right = ranked.select(*question, F.col(label).alias("b"), F.col("place").alias("pb"))
    met = left.join(right, question).filter("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("pa") < F.col("pb")).alias("a_ahead"), F.count_if(F.col("pa") == F.col("pb")).alias("level"))


#: Points of rubric grades. Fixed values.
GRADE_POINTS = {"A+": 1.0, "A": 0.9, "B+": 0.8, "B": 0.7, "C+": 0.6, "C": 0.5, "D": 0.3, "E": 0.0}


def points(grade: Column) -> Column:
    """Points of a grade, in any case and with blanks around it; null if there is no such grade."""
    given = F.upper(F.trim(grade))
    out = F.lit(None).cast("double")
    for name, value in GRADE_POINTS.items():
        out = F.when(given == name, value).otherwise(out)
    return out


def resolved(verdicts: DataFrame, question: list[str], stated: str = "stated", grade: str = "grade") -> DataFrame:
    """verdicts with points, place, shown and disagrees: grades are the ranking, equal ones share a place.

    shown is the order of display: by points, then as the judge stated it; disagrees, the same for a whole question, says that the judge's order was
    another. Of a question without any grade the stated order is the ranking. Answers of one question are few.
    """
    w = Window.partitionBy(*question)
    rows = verdicts.withColumn("points", points(F.col(grade))).withColumn("__graded", F.count("points").over(w) > 0).withColumn("__order", -F.coalesce("points", F.lit(-1.0)))
    shown = F.when(F.col("__graded"), F.row_number().over(w.orderBy("__order", stated))).otherwise(F.row_number().over(w.orderBy(stated)))
    place = F.when(F.col("__graded"), F.rank().over(w.orderBy("__order"))).otherwise(F.row_number().over(w.orderBy(stated)))
    rows = rows.withColumns({"place": place, "shown": shown, "__stated": F.row_number().over(w.orderBy(stated))})
    return rows.withColumn("disagrees", F.max(F.col("shown") != F.col("__stated")).over(w)).drop("__graded", "__order", "__stated")


def rank_rows(credited: DataFrame, dimension: DataFrame, label: str = "label", suite: str = "suite", principle: str = "principle", weighed: str = "constitution") -> DataFrame:
    """label, suite, n, wins, h2h_score and mean_score: a row for all questions, one for each suite, and for the suite whose principles have weights one by weights (its wins are a share) and one for each tier.

    credited: resolved verdicts with credit and tied; dimension: principle, tier and weight, a few rows.
    """
    rows = credited.withColumn("__win", win_share(F.col("place"), F.col("tied")))
    whole = rows.groupingSets([[label], [label, suite]], label, suite).agg(F.count("*").alias("n"), F.round(F.sum("__win"), 2).alias("wins"), F.round(F.avg("credit"), 4).alias("h2h_score"), F.round(F.avg("points"), 4).alias("mean_score"))
    none = F.lit(None).cast("double")
    whole = whole.select(label, F.coalesce(suite, F.lit("ALL")).alias("suite"), "n", "wins", "h2h_score", F.when(F.col(suite).isNull(), F.col("mean_score")).alias("mean_score"))
    own = rows.filter(F.col(suite) == weighed).join(F.broadcast(dimension.select(F.col("principle").alias(principle), "tier", "weight")), principle, "left")
    own = own.withColumns({"tier": F.coalesce("tier", F.lit(3)), "weight": F.coalesce("weight", F.lit(1.0))})
    total = rows.groupBy(label).agg(F.count("*").alias("n"))
    mean = lambda c: F.round(F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum("weight")), 4)
    weighted = own.groupBy(label).agg(mean("__win").alias("wins"), mean("credit").alias("h2h_score")).join(total, label)
    weighted = weighted.select(label, F.lit(f"{weighed}_weighted").alias("suite"), "n", "wins", "h2h_score", none.alias("mean_score"))
    tiers = own.groupBy(label, "tier").agg(F.count("*").alias("n"), F.round(F.sum("__win"), 2).alias("wins"), F.round(F.avg("credit"), 4).alias("h2h_score"))
    tiers = tiers.select(label, F.concat(F.lit(f"{weighed}_tier"), F.col("tier").cast("string")).alias("suite"), "n", "wins", "h2h_score", none.alias("mean_score"))
    return whole.unionByName(weighted).unionByName(tiers)


def lineage(rows: DataFrame, order: list[str], label: str = "label", weighed: str = "constitution") -> DataFrame:
    """label, rung, weighted, delta (from the rung before), h2h and win_share of conditions in the order that they were built in; a condition without rows is left out, and is no rung to compare with."""
    rung = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    of = lambda suite, c: F.max(F.when(F.col("suite") == suite, F.col(c)))
    wide = rows.filter(rung > 0).groupBy(label).agg(of(f"{weighed}_weighted", "h2h_score").alias("weighted"), of("ALL", "h2h_score").alias("h2h"), of(f"{weighed}_weighted", "wins").alias("win_share"))
    wide = wide.withColumn("rung", rung.cast("int"))
    before = wide.select((F.col("rung") + 1).alias("rung"), F.col("weighted").alias("__before"))
    return wide.join(before, "rung", "left").select(label, "rung", "weighted", (F.col("weighted") - F.col("__before")).alias("delta"), "h2h", "win_share")
