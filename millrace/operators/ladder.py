"""The ladder: a row for each metric, conditions side by side, with the step from each rung to the next and its interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import stats


def wide(items: DataFrame, labels: list[str], reps: int = 2000, alpha: float = 0.05, seed: str = "42") -> DataFrame:
    """metric, a score for each label, and delta, lo and hi for each label and the one before it.

    items: metric, label, key and value of every item. A score is the mean over a condition's items; a step is the difference of scores, and its interval that
    of resampled paired differences over the items that both conditions have (null without any). Weights stand for draws, so that no metric's items meet in one place.
    """
    known = items.filter(F.col("label").isin(labels) & F.col("value").isNotNull()).groupBy("metric", "label", "key").agg(F.avg("value").alias("value"))
    scores = known.groupBy("metric").pivot("label", labels).agg(F.avg("value"))
    steps = list(zip(labels, labels[1:]))
    rung = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    placed = known.withColumn("rung", rung)
    before = placed.select("metric", "key", (F.col("rung") + 1).alias("rung"), F.col("value").alias("before"))
    pairs = placed.join(before, ["metric", "key", "rung"]).select("metric", "key", "rung", (F.col("value") - F.col("before")).alias("x"))
    means = stats.weighted_means(pairs, ["metric", "rung"], ["key"], ["x"], reps, seed).withColumn("x", F.round("x", 9))
    ends = stats.interval(means, ["metric", "rung"], "x", alpha).select("metric", "rung", "lo", "hi")
    at = lambda k, c: F.max(F.when(F.col("rung") == k, F.col(c)))
    ends = ends.groupBy("metric").agg(*[at(k, c).alias(f"{c}_{a}__{b}") for k, (a, b) in enumerate(steps, 2) for c in ("lo", "hi")])
    named = scores.select("metric", *[F.col(x).alias(f"score_{x}") for x in labels], *[(F.col(b) - F.col(a)).alias(f"delta_{a}__{b}") for a, b in steps])
    return named.join(ends, "metric", "left")
