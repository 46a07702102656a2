"""Global row numbers without a single task: quantiles cut the key's range into buckets, whose counts give each bucket's first number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def numbered(rows: DataFrame, key: str, *ties: str, to: str = "number", buckets: int = BUCKETS) -> DataFrame:
    """rows with a number from 0 by key (numeric), then ties. Nulls come first.

    Three passes over the key: quantiles, counts per bucket, numbers within buckets. What reaches the driver is
    buckets bounds and counts; equal keys share a bucket, so ties should be fewer than a task can sort.
    """
    at = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx(key, at, 10_000)).first()[0] or []
    bounds = sorted(set(found))
    bucket = F.lit(0) if not bounds else F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))), F.lit(0))
    placed = rows.withColumn("__bucket", F.when(F.col(key).isNull(), -1).otherwise(bucket))
    firsts, n = [], 0
    for b, count in sorted((r[0], r[1]) for r in placed.groupBy("__bucket").count().collect()):
        firsts += [b, n]
        n += count
    first = F.element_at(F.create_map(*map(F.lit, firsts)), F.col("__bucket")) if firsts else F.lit(0)
    w = Window.partitionBy("__bucket").orderBy(key, *ties)
    return placed.withColumn(to, (F.row_number().over(w) - 1 + first).cast("long")).drop("__bucket")


def numbered_within(rows: DataFrame, by: str, key: str, *ties: str, to: str = "number", total: str = "n", buckets: int = BUCKETS) -> DataFrame:
    """rows with a number from 0 by key (numeric, no nulls), then ties, within each group, and the group's total; no task sorts a whole group.

    Quantiles of all keys cut their range into buckets; a bucket of a group is sorted by itself, after those of smaller keys are counted.
    """
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.agg(F.percentile_approx(key, at, 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    placed = rows.withColumn("__bucket", bucket)
    counts = placed.groupBy(by, "__bucket").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(by, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"), F.sum("__size").over(Window.partitionBy(by)).alias(total))
    own = Window.partitionBy(by, "__bucket").orderBy(key, *ties)
    return placed.withColumn("__own", F.row_number().over(own) - 1).join(firsts, [by, "__bucket"]).withColumn(to, (F.col("__own") + F.col("__first")).cast("long")).drop("__own", "__first", "__bucket")


def rolling_mean(rows: DataFrame, by: str, number: str, value: Column, size: int, to: str, block: int = 10_000) -> DataFrame:
    """rows with the mean of value over the last size rows of the group, by number (from 0, without gaps); tasks take blocks of numbers.

    The last size - 1 rows of a block are copied to the next, so that its first rows have theirs before them.
    """
    at = F.expr(f"{number} div {block}")
    copies = F.when(F.col(number) % block > block - size, F.array(at, at + 1)).otherwise(F.array(at))
    placed = rows.withColumn("__value", value).withColumn("__block", F.explode(copies))
    window = Window.partitionBy(by, "__block").orderBy(number).rowsBetween(1 - size, 0)
    return placed.withColumn(to, F.avg("__value").over(window)).filter(F.col("__block") == at).drop("__value", "__block")
