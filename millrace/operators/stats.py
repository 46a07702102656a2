"""Statistics as aggregations: agreement, correlation, intervals. Sums first, so that all of them combine partially.

Results are null where a statistic is undefined (no pairs, a constant side); nothing divides by zero under ANSI rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest, pick


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Over pairs with both sides there; null for fewer than least pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varied = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)) & (F.count(a) >= least)
    return F.when(varied, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def average_ranks(cells: DataFrame, by: str, value: str, count: str, to: str) -> DataFrame:
    """by, value and to: the 1-based rank of each distinct value, ties sharing the mean of their places, from counts of values.

    What is sorted per group are distinct values (scores have few), never rows.
    """
    counts = cells.groupBy(by, value).agg(F.sum(count).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(by, value, (before + (F.col("k") + 1) / 2.0).alias(to))


def spearman(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, spearman: Pearson's r of average ranks, per group, from counts of the pairs of values."""
    cells = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    ranked = cells.join(average_ranks(cells, by, "x", "c", "rx"), [by, "x"]).join(average_ranks(cells, by, "y", "c", "ry"), [by, "y"])
    total = lambda e: F.sum(F.col("c") * e)
    sums = ranked.groupBy(by).agg(F.sum("c").alias("n"), F.max("rx").alias("mx"), F.min("rx").alias("lx"), F.max("ry").alias("my"), F.min("ry").alias("ly"), total(F.col("rx")).alias("sx"), total(F.col("ry")).alias("sy"), total(F.col("rx") * F.col("rx")).alias("sxx"), total(F.col("ry") * F.col("ry")).alias("syy"), total(F.col("rx") * F.col("ry")).alias("sxy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    return sums.select(by, F.when((F.col("mx") > F.col("lx")) & (F.col("my") > F.col("ly")), (n * F.col("sxy") - sx * sy) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def categorical_agreement(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by, n, observed, kappa (Cohen) and ac1 (Gwet) of two categorical raters, per group, from one contingency count."""
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(by, F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("s"))
    margins = sides.groupBy(by, "s.c").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    total = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0))).alias("same"))
    shares = margins.join(total, by).withColumns({"pa": F.col("na") / F.col("n"), "pb": F.col("nb") / F.col("n")})
    pi = (F.col("pa") + F.col("pb")) / 2
    chance = shares.groupBy(by).agg(F.first("n").alias("n"), F.first("same").alias("same"), F.sum(F.col("pa") * F.col("pb")).alias("pe"), F.sum(pi * (1 - pi)).alias("spread"), F.count("*").alias("q"))
    po = F.col("same") / F.col("n")
    full = F.when(po >= 1, F.lit(1.0))
    ge = F.try_divide(F.col("spread"), F.col("q") - 1)
    return chance.select(
        by,
        "n",
        po.alias("observed"),
        F.when(F.col("pe") >= 1, full).otherwise(F.try_divide(po - F.col("pe"), 1 - F.col("pe"))).alias("kappa"),
        F.when(F.col("q") < 2, full).when(ge >= 1, full).otherwise(F.try_divide(po - ge, 1 - ge)).alias("ac1"),
    )


def krippendorff(ratings: DataFrame, by: str, unit: str, value: str) -> DataFrame:
    """by, alpha_interval, alpha_nominal over units with two ratings or more, in closed form (no pairs are made)."""
    v = ratings.filter(F.col(value).isNotNull()).select(by, unit, F.col(value).cast("double").alias("v"))
    per_unit = v.groupBy(by, unit).agg(F.count("*").alias("m"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2")).filter("m >= 2")
    # Of a unit's ordered pairs the squared differences sum to 2 (m s2 - s1^2).
    interval = per_unit.groupBy(by).agg(
        F.sum("m").alias("n"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"), F.sum(2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("within")
    )
    counts = v.groupBy(by, unit, "v").agg(F.count("*").alias("k")).join(per_unit.select(by, unit, "m"), [by, unit])
    unequal = counts.groupBy(by, unit, "m").agg(F.sum(F.col("k") * F.col("k")).alias("same")).groupBy(by).agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("unlike"))
    overall = counts.groupBy(by, "v").agg(F.sum("k").alias("k")).groupBy(by).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    n = F.col("n")
    pairs = n * (n - 1)
    de_i, de_n = 2 * (n * F.col("t2") - F.col("t1") * F.col("t1")) / pairs, (n * n - F.col("squares")) / pairs
    alpha = lambda do, de: F.when(de == 0, F.lit(1.0)).otherwise(1 - F.try_divide(do / n, de))
    return interval.join(unequal, by).join(overall, by).select(by, alpha(F.col("within"), de_i).alias("alpha_interval"), alpha(F.col("unlike"), de_n).alias("alpha_nominal"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) for n = 0."""
    p, zz = F.try_divide(hits, n), z * z
    centre, width = p + zz / (2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + zz / (4 * n * n))
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.try_divide(centre - width, 1 + zz / n)))
    return low, F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(centre + width, 1 + zz / n)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the binomial tail at one half, built by running products of logarithms."""
    n, k = b + c, F.least(b, c)
    # log C(n, i) grows by log((n - i + 1) / i); 2**-n by logarithm too, so that no factor overflows.
    step = lambda s, i: F.struct((s["term"] + F.ln((n - i + 1) / i)).alias("term"), (s["sum"] + F.exp(s["term"] + F.ln((n - i + 1) / i))).alias("sum"))
    first = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("sum"))
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>")), first, step, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def paired_bootstrap(pairs: DataFrame, by: str, key: str, a: str, b: str, reps: int = 2000, alpha: float = 0.05, seed: str = "42") -> DataFrame:
    """by, n, delta (mean b - a), lo, hi: percentile interval over reps resamples of the shared items.

    Items of a group are one array (item-level tables: hundreds), drawn from by keyed hashes; the replicates are dealt
    out over the cluster and only their means are shuffled. For groups of any size there is weighted_means().
    """
    sample = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), (F.col(b) - F.col(a)).alias("x")))).alias("items"))
    n = F.size("items")
    reps_of = sample.select(by, "items", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("items"), pick(n, seed, F.col("rep"), i).cast("int"))["x"])
    means = reps_of.select(by, n.alias("n"), (F.aggregate(draws, F.lit(0.0), lambda s, x: s + x) / n).alias("m"), F.aggregate("items", F.lit(0.0), lambda s, x: s + x["x"]).alias("total"))
    ranked = means.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("m")) - 1)
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("m")))
    return ranked.groupBy(by).agg(
        F.first("n").cast("long").alias("n"),
        (F.first("total") / F.first("n")).alias("delta"),
        at(int(alpha / 2 * reps)).alias("lo"),
        at(min(reps - 1, int((1 - alpha / 2) * reps))).alias("hi"),
    )


def poisson(digits: Column, most: int = 12) -> Column:
    """The Poisson count of mean 1 that eight hex digits stand for, taken as a number from 0 to 1; counts beyond most have a chance below 1e-9."""
    upto, term, out = 0.0, math.exp(-1), None
    for k in range(most):
        upto += term
        term /= k + 1
        # Hex digits of one length are in order as texts are, so no number need be made of them.
        below = digits < f"{math.ceil(upto * 2**32):08x}"
        out = F.when(below, k) if out is None else out.when(below, k)
    return out.otherwise(most)


def weighted_means(rows: DataFrame, by: list[str], item: list[str], values: list[str], reps: int = 2000, seed: str = "42") -> DataFrame:
    """by, rep and the mean of each value in reps resamples of the items: each item counts as often as a keyed hash of replicate and item says.

    The Poisson form of the bootstrap: an item's weight depends on nothing but itself, so a row is drawn where it is, and what is shuffled are
    one partial sum for each task, group and replicate. Groups that share items share their draws. A resample that draws none of a group's items gives it
    no row; null values are left out.
    """
    weight = poisson(F.substring(digest(seed, F.col("rep"), *[F.col(c) for c in item]), 1, 8))
    drawn = rows.select(*by, *item, *values).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", weight).filter("w > 0")
    mean = lambda v: F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v)
    return drawn.groupBy(*by, "rep").agg(*[mean(v) for v in values])


def interval(means: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """by, lo, hi and share (of values of 0 or less) of resampled values: those at the places int(alpha / 2 n) and int((1 - alpha / 2) n) of n in order."""
    w = Window.partitionBy(*by)
    placed = means.filter(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w.orderBy(value)) - 1).withColumn("of", F.count("*").over(w))
    spot = lambda share: F.max(F.when(F.col("at") == F.least(F.floor(F.lit(share) * F.col("of") + 1e-9), F.col("of") - 1), F.col(value)))
    return placed.groupBy(*by).agg(spot(alpha / 2).alias("lo"), spot(1 - alpha / 2).alias("hi"), F.avg((F.col(value) <= 0).cast("double")).alias("share"))
