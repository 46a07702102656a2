"""Scores of conditions: aggregation, comparison, ranking, agreement and intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.overlap import FIELDS, rouge_scores
from millrace.operators import ranking as K
from millrace.operators import stats as S
from millrace.operators.ranks import numbered, numbered_within, rolling_mean
from millrace.plans.fixtures import RESPONSES_SQL, SCORES_SQL, responses, scores

#: Principles by family, tier and weight: made-up values for nine principles.
FAMILIES = [("P0", "honesty", 1, 3.0), ("P1", "honesty", 2, 2.0), ("P2", "care", 1, 3.0), ("P3", "care", 3, 1.0), ("P4", "tools", 2, 2.0), ("P5", "tools", 3, 1.0), ("P6", "tools", 1, 3.0)]
COMBINED = "CASE WHEN judge_score IS NULL THEN rule_score ELSE (rule_score + judge_score) / 2 END"


def _r(c, n=6):
    return F.round(c, n)


def _families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "principle string, family string, tier int, weight double")


def a7_j4_principles(spark: SparkSession, d: str) -> DataFrame:
    """Mean per principle, then of the means, per family, tier and overall, and weighted; unknown principles fall to tier 3."""
    per = scores(spark, d).groupBy("label", "principle").agg(F.avg("rule_score").alias("score"))
    # The dimension is a constant of a few rows.
    rows = per.join(F.broadcast(_families(spark)), "principle", "left").select(
        "label", "score", F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("tier", F.lit(3)).alias("tier"), F.coalesce("weight", F.lit(1.0)).alias("weight")
    )
    return rows.groupingSets([["label"], ["label", "family"], ["label", "tier"]], "label", "family", "tier").agg(
        _r(F.avg("score")).alias("score"), _r(F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("weighted"), F.count("*").alias("n")
    )


def a8_a10_suites(spark: SparkSession, d: str) -> DataFrame:
    """Suite scores by three rules of combining, passes, and drift from a baseline."""
    s = scores(spark, d)
    mixed = F.coalesce((F.col("rule_score") + F.col("judge_score")) / 2, F.col("rule_score"))
    per = s.groupBy("label", "suite", "principle").agg(F.avg(mixed).alias("mixed"), _r(F.avg(F.coalesce("judge_score", "rule_score")), 4).alias("primary"), F.avg(F.coalesce(mixed, F.lit(0.5))).alias("halved"))
    out = per.groupBy("label", "suite").agg(_r(F.avg("mixed")).alias("mixed"), _r(F.avg("primary")).alias("primary"), _r(F.avg("halved")).alias("with_default"), F.count_if(F.col("mixed") >= 0.6).alias("passed"), F.count("*").alias("total"))
    return out.withColumn("drift", _r(F.col("mixed") - 0.5)).withColumn("warns", F.col("drift") < -0.05)


def a11_attack_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Passes overall and by kind of attack."""
    s = scores(spark, d).filter("suite = 'drift'")
    return s.rollup("principle").agg(F.count("*").alias("total"), F.count_if(F.col("rule_score") >= 0.6).alias("passed"), _r(F.avg((F.col("rule_score") >= 0.6).cast("double"))).alias("score"))


def a3_a5_depth_tools_cost(spark: SparkSession, d: str) -> DataFrame:
    """Depth, tool and cost metrics of responses by profile."""
    from millrace.functions import text as T

    r = F.col("r")
    rows = responses(spark, d).select("profile", "n_chars", T.think_length(r).alias("think"), T.called_tools(r).alias("tools"), T.is_ask(r).alias("ask"), F.length(T.user_facing(r)).alias("answer"))
    calls = F.size("tools")
    known = F.array(*map(F.lit, ("python_execute", "web_search", "read_url", "get_datetime")))
    decoys = F.size(F.array_except("tools", known))
    return rows.groupBy("profile").agg(
        F.count("*").alias("n"),
        _r(F.avg("think")).alias("mean_think"),
        _r(F.median("think")).alias("median_think"),
        _r(F.avg((F.col("think") < 10).cast("double"))).alias("empty_rate"),
        _r(F.avg(F.col("ask").cast("double"))).alias("ask_rate"),
        _r(F.avg(calls)).alias("calls_per_response"),
        _r(F.coalesce(F.try_divide(F.sum(decoys), F.sum(calls)), F.lit(0.0))).alias("decoy_rate"),
        _r(F.avg(F.when(F.col("profile") == "no_tools", (calls > 0).cast("double")))).alias("unnecessary_rate"),
        _r(F.avg(F.try_divide(F.col("think"), F.col("think") + F.col("answer")))).alias("think_share"),
        _r(F.avg("n_chars")).alias("mean_cost"),
    )


def a25_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Counts and p50, p95, p99 by index int(n * p / 100), clamped, per event type."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("label"), "value", "event_id")
    rows = numbered_within(e, "label", "value", "event_id", to="at")
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return rows.groupBy("label").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("at") == place(p), F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)])


def j1_t14_significance(spark: SparkSession, d: str) -> DataFrame:
    """Paired items of each condition against 'click': discordant pairs, exact p, effect size, interval."""
    s = scores(spark, d).groupBy("label", "item").agg(F.max("rule_score").alias("score")).select("label", "item", (F.col("score") >= 1.0).alias("ok"))
    base = s.filter("label = 'click'").select("item", F.col("ok").alias("base"))
    pairs = s.filter("label <> 'click'").join(base, "item").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("hits"), F.count_if("base").alias("base_hits"),
        F.count_if(F.expr("ok AND NOT base")).alias("b"), F.count_if(F.expr("base AND NOT ok")).alias("c"))
    n = F.col("n")
    lo, hi = S.wilson(F.col("hits"), n)
    return pairs.select("label", "n", "b", "c", _r(S.mcnemar(F.col("b"), F.col("c"))).alias("p"), _r(S.cohens_h(F.col("hits") / n, F.col("base_hits") / n)).alias("h"), _r(lo).alias("lo"), _r(hi).alias("hi"))


def j2_e7_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two runs side by side: what is missing counts 0, with a flag; win, loss or same at 0.05."""
    s = scores(spark, d).filter("NOT (label = 'view' AND principle = 'P3')").groupBy("label", "principle").agg(F.avg("rule_score").alias("score"))
    a = s.filter("label = 'click'").select("principle", F.col("score").alias("a"))
    b = s.filter("label = 'view'").select("principle", F.col("score").alias("b"))
    both = a.join(b, "principle", "full")
    delta = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    verdict = F.when(_r(delta) > 0.05, "WIN").when(_r(delta) < -0.05, "LOSS").otherwise("SAME")
    return both.select("principle", _r(F.coalesce("a", F.lit(0.0))).alias("a"), _r(F.coalesce("b", F.lit(0.0))).alias("b"), _r(delta).alias("delta"), verdict.alias("verdict"), (F.col("a").isNull() | F.col("b").isNull()).alias("missing"))


def j3_k4_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Conditions as columns per principle, with differences from the first."""
    labels = ["click", "error", "purchase", "signup", "view"]
    wide = scores(spark, d).groupBy("principle").pivot("label", labels).agg(F.avg("rule_score"))
    return wide.select("principle", *[_r(F.col(x)).alias(x) for x in labels], *[_r(F.col(x) - F.col("click")).alias(f"d_{x}") for x in labels[1:]])


def _per_question(spark: SparkSession, d: str) -> DataFrame:
    """Scores per question in whole tenths, rounded down, so that ties are ties on any engine."""
    tenths = F.sum(F.round(F.col("rule_score") * 10).cast("long"))
    return scores(spark, d).groupBy("suite", "item", "label").agg((F.floor(tenths / F.count("*")) / 10).alias("score"))


def w3_a13_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Ranks per question with ties, wins shared, head-to-head per condition, overall and by suite."""
    ranked = K.beat_credit(K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score"), ["suite", "item"])
    weight = F.when(F.col("suite") == "constitution", 3.0).when(F.col("suite") == "category", 2.0).otherwise(1.0)
    out = K.head_to_head(ranked, "label", "suite", weight)
    return out.select("label", "suite", "n", *[_r(F.col(c)).alias(c) for c in ("wins", "h2h", "mean_place", "weighted_h2h")])


def a14_grades(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of grades and of places per condition."""
    ranked = K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score")
    grade = F.when(F.col("score") >= 0.7, "A").when(F.col("score") >= 0.6, "B").when(F.col("score") >= 0.5, "C").when(F.col("score") >= 0.3, "D").otherwise("E")
    points = F.element_at(F.create_map(*[F.lit(x) for p in (("A", 1.0), ("B", 0.75), ("C", 0.5), ("D", 0.25), ("E", 0.0)) for x in p]), F.col("grade"))
    rows = ranked.withColumn("grade", grade).withColumn("points", points)
    return rows.groupBy("label").agg(*[F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in "ABCDE"], *[F.count_if(F.col("place") == p).alias(f"place_{p}") for p in (1, 2, 3, 4, 5)], _r(F.avg("points")).alias("mean_points"))


def j12_duels(spark: SparkSession, d: str) -> DataFrame:
    """Conditions against each other over shared questions."""
    return K.duels(K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score"), ["suite", "item"], "label")


def w5_w9_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Conditions as rungs: score, difference from the rung before, and failing or regressing principles."""
    per = scores(spark, d).groupBy("principle", "label").agg(F.avg("rule_score").alias("score"))
    before = F.lag("score").over(Window.partitionBy("principle").orderBy("label"))
    rows = per.withColumn("before", before).withColumn("delta", _r(F.col("score") - F.col("before")))
    fails, falls = F.col("score") < 0.6, F.col("delta") < -0.05
    flag = F.when(fails & falls, "FAIL+REGRESS").when(fails, "FAIL").when(falls, "REGRESS")
    return rows.select("principle", "label", _r(F.col("score")).alias("score"), "delta", flag.alias("flag"))


def t1_t7_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two raters of the same items per condition: correlations, errors, chance-corrected agreement, bias."""
    s = scores(spark, d).select("label", "event_id", "rule_score", "judge_score")
    x, y = F.col("rule_score"), F.col("judge_score")
    both = s.filter(y.isNotNull())
    sums = both.groupBy("label").agg(S.pearson(x, y).alias("pearson"), F.avg(F.abs(x - y)).alias("mae"), F.avg((F.abs(x - y) <= 1e-9).cast("double")).alias("exact"), F.avg(x).alias("rule_mean"), F.avg(y).alias("judge_mean"))
    passed = both.select("label", (x >= 0.6).cast("int").alias("a"), (y >= 0.6).cast("int").alias("b"))
    long = both.select("label", "event_id", F.explode(F.array(x, y)).alias("v"))
    out = sums.join(S.spearman(both, "label", "rule_score", "judge_score"), "label").join(S.categorical_agreement(passed, "label", "a", "b"), "label").join(S.krippendorff(long, "label", "event_id", "v"), "label")
    out = out.withColumn("bias", F.col("judge_mean") - F.col("rule_mean"))
    return out.select("label", "n", *[_r(F.col(c)).alias(c) for c in ("pearson", "spearman", "mae", "exact", "observed", "kappa", "ac1", "alpha_interval", "alpha_nominal", "bias")])


def t8_a31_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Spread of repeated scores within items, and how often the verdict flips."""
    per = scores(spark, d).groupBy("label", "item").agg(F.count("*").alias("k"), F.avg("rule_score").alias("mean"), F.stddev_samp("rule_score").alias("sd"), F.min("rule_score").alias("least"), F.max("rule_score").alias("most"))
    return per.groupBy("label").agg(
        F.count("*").alias("items"), _r(F.avg("k")).alias("mean_k"), _r(F.coalesce(F.avg("sd"), F.lit(0.0))).alias("mean_sd"), _r(F.avg(((F.col("least") < 0.6) & (F.col("most") >= 0.6)).cast("double"))).alias("flip_rate"), _r(F.avg("mean")).alias("mean")
    )


def _click_pairs(spark: SparkSession, d: str) -> DataFrame:
    per = scores(spark, d).groupBy("label", "item").agg(F.avg("rule_score").alias("score"))
    base = per.filter("label = 'click'").select("item", F.col("score").alias("base"))
    return per.filter("label <> 'click'").join(base, "item")


def t9_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of each condition's mean difference from 'click' over shared items, of 200 resamples as its SQL has it."""
    return S.paired_bootstrap(_click_pairs(spark, d), "label", "item", "base", "score", 200).select("label", "n", *[_r(F.col(c)).alias(c) for c in ("delta", "lo", "hi")])


def t9_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same intervals of the reference's 2,000 resamples."""
    return S.paired_bootstrap(_click_pairs(spark, d), "label", "item", "base", "score").select("label", "n", *[_r(F.col(c)).alias(c) for c in ("delta", "lo", "hi")])


def t9_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same intervals by weights of items in place of draws, so that no group's items meet in one place."""
    pairs = _click_pairs(spark, d).withColumn("x", F.col("score") - F.col("base"))
    means = S.weighted_means(pairs, ["label"], ["item"], ["x"]).withColumn("x", F.round("x", 9))
    points = pairs.groupBy("label").agg(F.count("x").alias("n"), _r(F.avg("x")).alias("delta"))
    return points.join(S.interval(means, ["label"], "x"), "label").select("label", "n", "delta", _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


def t10_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of head-to-head means (b is null) and of their differences, by weights of questions that all conditions share."""
    ranked = K.beat_credit(K.competition_ranks(_per_question(spark, d), ["suite", "item"], "label", "score"), ["suite", "item"])
    means = S.weighted_means(ranked, ["label"], ["suite", "item"], ["credit"], 10_000, "t10")
    left, right = (means.select("rep", F.col("label").alias(c), F.col("credit").alias(f"v{c}")) for c in "ab")
    single = left.select("a", F.lit("").alias("b"), F.col("va").alias("v"))
    values = single.unionByName(left.join(right, "rep").filter("a < b").select("a", "b", (F.col("va") - F.col("vb")).alias("v"))).withColumn("v", F.round("v", 9))
    points = ranked.groupBy("label").agg(F.avg("credit").alias("point"))
    out = S.interval(values, ["a", "b"], "v").join(points.select(F.col("label").alias("a"), F.col("point").alias("pa")), "a").join(points.select(F.col("label").alias("b"), F.col("point").alias("pb")), "b", "left")
    two = F.col("b") != ""
    return out.select("a", F.when(two, F.col("b")).alias("b"), _r(F.col("pa") - F.coalesce("pb", F.lit(0.0))).alias("point"), _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"), F.when(two, _r(F.col("share"))).alias("share_le_0"), F.when(two, ~((F.col("lo") <= 0) & (F.col("hi") >= 0))).alias("separated"))


def t15_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of every two principles over items scored on both, flagged from 0.9 on."""
    per = scores(spark, d).groupBy("label", "item", "principle").agg(F.avg("rule_score").alias("score"))
    wide = per.groupBy("label", F.expr("substr(item, 2)").cast("int").alias("q")).agg(F.avg("score").alias("a"), F.max("score").alias("b"), F.min("score").alias("c"))
    dims = wide.select("label", "q", F.explode(F.map_from_arrays(F.array(F.lit("mean"), F.lit("most"), F.lit("least")), F.array("a", "b", "c"))).alias("dim", "v"))
    r = S.pearson(F.col("v1"), F.col("v2"), 3)
    met = dims.select("label", "q", F.col("dim").alias("d1"), F.col("v").alias("v1")).join(dims.select("label", "q", F.col("dim").alias("d2"), F.col("v").alias("v2")), ["label", "q"])
    return met.groupBy("d1", "d2").agg(_r(r).alias("r"), F.count("*").alias("n")).withColumn("redundant", F.abs("r") >= 0.9)


def _poisson(key: str) -> str:
    """SQL of a Poisson count by the chances of 0, 1, 2 ... draws."""
    chances, term = [], math.exp(-1)
    for k in range(12):
        chances.append(term)
        term /= k + 1
    u = f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
    return "(" + " + ".join(f"({u} >= {sum(chances[: k + 1])!r})::INT" for k in range(12)) + ")"


def _with_reference(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the benchmark item of the same remainder."""
    items = numbered(spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("ref")), "item_id", to="k")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.pmod("doc_id", F.lit(max(1, items.count()))).alias("k"))
    return docs.join(items.select("k", "ref"), "k")


def t16_rouge(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 (precision, recall, F) of documents against their references, on words as they are."""
    rows = _with_reference(spark, d).select("doc_id", rouge_scores(F.col("text"), F.col("ref"), stems=False).alias("s"))
    return rows.select("doc_id", *[_r(F.col(f"s.{f}")).alias(f) for f in FIELDS if f[:6] != "rougel"])


def t16_rouge_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L (precision, recall, F) of documents against their references, on stems."""
    rows = _with_reference(spark, d).select("doc_id", rouge_scores(F.col("text"), F.col("ref")).alias("s"))
    return rows.select("doc_id", *[_r(F.col(f"s.{f}")).alias(f) for f in FIELDS])


def w1_w2_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per user: turns, and the first of three turns in a row that all score below one half."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = scores(spark, d).withColumn("turn", F.row_number().over(w)).withColumn("score", F.coalesce("judge_score", "rule_score"))
    ahead = w.rowsBetween(0, 2)
    low = (F.max("score").over(ahead) < 0.5) & (F.count("score").over(ahead) == 3)
    rows = s.withColumn("low", low)
    return rows.groupBy("user_id").agg(F.count("*").alias("turns"), F.min(F.when(F.col("low"), F.col("turn"))).cast("long").alias("first_drift"), _r(F.avg("score")).alias("adherence"))


def w7_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Failure rate over the last 50 checks per principle, and whether it calls for adaptation."""
    rows = numbered_within(scores(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "principle", "at", "event_id")
    s = rolling_mean(rows, "principle", "number", (F.col("rule_score") < 0.3).cast("double"), 50, "rate").withColumn("rate", _r(F.col("rate")))
    return s.select("event_id", "principle", "rate", (F.col("rate") >= 0.3).alias("adapts"))


def w8_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Gap to the user's event before, and events in the hour up to now."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s")
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return e.select("event_id", "user_id", (gap < 600_000_000).alias("short_gap"), F.count(F.lit(1)).over(w.rangeBetween(-3_600_000_000, 0)).alias("in_hour"))


def a16_honesty(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of abstentions against what was expected, by profile; precision, recall, F1, over-refusal."""
    from millrace.functions import text as T

    rows = responses(spark, d).select("profile", T.user_facing(F.col("r")).rlike(T.ABSTAINS).alias("abstained"), F.expr("category = 'real_time_data' AND profile IN ('no_tools', 'compute_only') OR doc_id % 5 = 0").alias("should"))
    c = rows.groupBy("profile").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "should AND abstained"), ("fp", "NOT should AND abstained"), ("fn", "should AND NOT abstained"), ("tn", "NOT should AND NOT abstained"))])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("profile", "tp", "fp", "fn", "tn", _r(share(tp, tp + fp)).alias("precision"), _r(share(tp, tp + fn)).alias("recall"), _r(share(2 * tp, 2 * tp + fp + fn)).alias("f1"), _r(share(fp, fp + tn)).alias("over_refusal"))


QUERIES = {
    f.__name__: f
    for f in (
        a7_j4_principles, a8_a10_suites, a11_attack_rollup, a3_a5_depth_tools_cost, a25_percentiles, j1_t14_significance, j2_e7_compare, j3_k4_matrix, w3_a13_head_to_head, a14_grades,
        j12_duels, w5_w9_ladder, t1_t7_agreement, t8_a31_consistency, t9_bootstrap, t9_intervals, t9_weighted, t10_weighted, t15_correlations, t16_rouge, t16_rouge_stemmed, w1_w2_drift, w7_rolling, w8_bursts, a16_honesty,
    )
}

_FAM = ", ".join(f"('{p}', '{f}', {t}, {w}::DOUBLE)" for p, f, t, w in FAMILIES)
_PER_Q = "q AS (SELECT suite, item, label, (sum(round(rule_score * 10)::BIGINT) // count(*))::BIGINT / 10.0::DOUBLE AS score FROM scores GROUP BY ALL)"
_RANKED = f"{_PER_Q}, ranked AS (SELECT *, rank() OVER (PARTITION BY suite, item ORDER BY score DESC) AS place FROM q)"
_S = f"WITH {SCORES_SQL.replace('/ 10.0', '/ 10.0::DOUBLE')}"

SQL = {
    "a7_j4_principles": f"""{_S}, f(principle, family, tier, weight) AS (VALUES {_FAM}),
        p AS (SELECT label, principle, avg(rule_score) AS score FROM scores GROUP BY ALL),
        j AS (SELECT label, score, coalesce(family, 'unknown') AS family, coalesce(tier, 3)::INT AS tier, coalesce(weight, 1.0) AS weight FROM p LEFT JOIN f USING (principle))
        SELECT label, NULL AS family, NULL::INT AS tier, round(avg(score), 6) AS score, round(sum(weight * score) / sum(weight), 6) AS weighted, count(*) AS n FROM j GROUP BY label
        UNION ALL SELECT label, family, NULL, round(avg(score), 6), round(sum(weight * score) / sum(weight), 6), count(*) FROM j GROUP BY label, family
        UNION ALL SELECT label, NULL, tier, round(avg(score), 6), round(sum(weight * score) / sum(weight), 6), count(*) FROM j GROUP BY label, tier""",
    "a8_a10_suites": f"""{_S}, m AS (SELECT *, CASE WHEN judge_score IS NULL THEN rule_score ELSE (rule_score + judge_score) / 2 END AS x FROM scores),
        p AS (SELECT label, suite, principle, avg(x) AS x, round(avg(ifnull(judge_score, rule_score)), 4) AS y FROM m GROUP BY ALL),
        s AS (SELECT label, suite, round(avg(x), 6) AS mixed, round(avg(y), 6) AS primary_, count(*) FILTER (x >= 0.6) AS passed, count(*) AS total FROM p GROUP BY ALL)
        SELECT label, suite, mixed, primary_ AS "primary", mixed AS with_default, passed, total, round(mixed - 0.5, 6) AS drift, round(mixed - 0.5, 6) < -0.05 AS warns FROM s""",
    "a11_attack_rollup": f"""{_S} SELECT principle, count(*) AS total, count(*) FILTER (rule_score >= 0.6) AS passed, round(count(*) FILTER (rule_score >= 0.6) / count(*), 6) AS score
        FROM scores WHERE suite = 'drift' GROUP BY ROLLUP (principle)""",
    "a25_percentiles": """WITH a AS (SELECT event_type AS label, list_sort(list(value)) AS v FROM events GROUP BY 1)
        SELECT label, len(v)::BIGINT AS n, v[least(len(v) * 50 // 100, len(v) - 1) + 1] AS p50, v[least(len(v) * 95 // 100, len(v) - 1) + 1] AS p95, v[least(len(v) * 99 // 100, len(v) - 1) + 1] AS p99 FROM a""",
    "j1_t14_significance": f"""{_S}, s AS (SELECT label, item, max(rule_score) >= 1.0 AS ok FROM scores GROUP BY ALL),
        p AS (SELECT a.label, count(*) AS n, count(*) FILTER (a.ok) AS hits, count(*) FILTER (z.ok) AS base, count(*) FILTER (a.ok AND NOT z.ok) AS b, count(*) FILTER (z.ok AND NOT a.ok) AS c
              FROM s a JOIN s z USING (item) WHERE z.label = 'click' AND a.label <> 'click' GROUP BY a.label),
        t AS (SELECT label, sum(factorial((b + c)::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((b + c - i)::INT)::DOUBLE) / pow(2, b + c)) AS tail FROM p, unnest(range(0, least(b, c) + 1)) AS u(i) GROUP BY label),
        w AS (SELECT p.*, tail, hits / n AS q, 1.96 * 1.96 AS zz FROM p JOIN t USING (label))
        SELECT label, n, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1.0, 2 * tail) END, 6) AS p, round(2 * asin(sqrt(q)) - 2 * asin(sqrt(base / n)), 6) AS h,
          round(greatest(0.0, (q + zz / (2 * n) - 1.96 * sqrt(q * (1 - q) / n + zz / (4 * n * n))) / (1 + zz / n)), 6) AS lo,
          round(least(1.0, (q + zz / (2 * n) + 1.96 * sqrt(q * (1 - q) / n + zz / (4 * n * n))) / (1 + zz / n)), 6) AS hi FROM w""",
    "j2_e7_compare": f"""{_S}, s AS (SELECT principle, avg(rule_score) FILTER (label = 'click') AS a, avg(rule_score) FILTER (label = 'view' AND principle <> 'P3') AS b FROM scores GROUP BY 1)
        SELECT principle, round(ifnull(a, 0), 6) AS a, round(ifnull(b, 0), 6) AS b, round(ifnull(b, 0) - ifnull(a, 0), 6) AS delta,
          CASE WHEN round(ifnull(b, 0) - ifnull(a, 0), 6) > 0.05 THEN 'WIN' WHEN round(ifnull(b, 0) - ifnull(a, 0), 6) < -0.05 THEN 'LOSS' ELSE 'SAME' END AS verdict, (a IS NULL OR b IS NULL) AS missing
        FROM s WHERE a IS NOT NULL OR b IS NOT NULL""",
    "j3_k4_matrix": f"""{_S} SELECT principle, {", ".join(f"round(avg(rule_score) FILTER (label = '{x}'), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view"))},
        {", ".join(f"round(avg(rule_score) FILTER (label = '{x}') - avg(rule_score) FILTER (label = 'click'), 6) AS d_{x}" for x in ("error", "purchase", "signup", "view"))} FROM scores GROUP BY principle""",
    "w3_a13_head_to_head": f"""{_S}, {_PER_Q},
        c AS (SELECT a.suite, a.item, a.label, count(*) FILTER (b.score > a.score) + 1 AS place, count(*) FILTER (b.score = a.score) + 1 AS tied,
              CASE WHEN count(b.label) = 0 THEN 1.0 ELSE (count(*) FILTER (b.score < a.score) + 0.5 * count(*) FILTER (b.score = a.score)) / count(b.label) END AS credit
              FROM q a LEFT JOIN q b ON a.suite = b.suite AND a.item = b.item AND a.label <> b.label GROUP BY a.suite, a.item, a.label),
        x AS (SELECT *, CASE WHEN place = 1 THEN 1.0 / tied ELSE 0 END AS win, CASE suite WHEN 'constitution' THEN 3.0 WHEN 'category' THEN 2.0 ELSE 1.0 END AS w FROM c)
        SELECT label, suite, count(*) AS n, round(sum(win)::DOUBLE, 6) AS wins, round(avg(credit)::DOUBLE, 6) AS h2h, round(avg(place), 6) AS mean_place, round((sum(w * credit) / sum(w))::DOUBLE, 6) AS weighted_h2h
        FROM x GROUP BY GROUPING SETS ((label), (label, suite))""",
    "a14_grades": f"""{_S}, {_RANKED}, g AS (SELECT *, CASE WHEN score >= 0.7 THEN 'A' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.5 THEN 'C' WHEN score >= 0.3 THEN 'D' ELSE 'E' END AS grade FROM ranked)
        SELECT label, {", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}" for g in "ABCDE")}, {", ".join(f"count(*) FILTER (place = {p}) AS place_{p}" for p in (1, 2, 3, 4, 5))},
          round(avg(CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.25 ELSE 0 END::DOUBLE), 6) AS mean_points FROM g GROUP BY label""",
    "j12_duels": f"""{_S}, {_PER_Q} SELECT x.label AS a, y.label AS b, count(*) AS n, count(*) FILTER (x.score > y.score) AS a_ahead, count(*) FILTER (x.score = y.score) AS level
        FROM q x JOIN q y ON x.suite = y.suite AND x.item = y.item AND x.label < y.label GROUP BY ALL""",
    "w5_w9_ladder": f"""{_S}, p AS (SELECT principle, label, avg(rule_score) AS score FROM scores GROUP BY ALL),
        l AS (SELECT a.principle, a.label, a.score, round(a.score - b.score, 6) AS delta FROM p a LEFT JOIN p b ON a.principle = b.principle
              AND b.label = CASE a.label WHEN 'error' THEN 'click' WHEN 'purchase' THEN 'error' WHEN 'signup' THEN 'purchase' WHEN 'view' THEN 'signup' END)
        SELECT principle, label, round(score, 6) AS score, delta, CASE WHEN score < 0.6 AND delta < -0.05 THEN 'FAIL+REGRESS' WHEN score < 0.6 THEN 'FAIL' WHEN delta < -0.05 THEN 'REGRESS' END AS flag FROM l""",
    "t1_t7_agreement": f"""{_S}, p AS (SELECT label, event_id, rule_score AS x, judge_score AS y, (rule_score >= 0.6)::INT AS a, (judge_score >= 0.6)::INT AS b FROM scores WHERE judge_score IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry FROM p),
        k AS (SELECT label, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg(abs(x - y)) AS mae, avg((abs(x - y) <= 1e-9)::INT) AS exact, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb, avg(y) - avg(x) AS bias,
              sum((x - y) * (x - y)) * 2 AS within, sum((x <> y)::INT) * 2 AS unlike FROM r GROUP BY label),
        v AS (SELECT label, x AS v FROM p UNION ALL SELECT label, y FROM p),
        m AS (SELECT label, var_samp(v) * 2 AS de FROM v GROUP BY label),
        c AS (SELECT label, (sum(n) * sum(n) - sum(n * n)) / (sum(n) * (sum(n) - 1)) AS den FROM (SELECT label, v, count(*) AS n FROM v GROUP BY ALL) GROUP BY label),
        z AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2) AS ge FROM k JOIN m USING (label) JOIN c USING (label))
        SELECT label, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mae, 6) AS mae, round(exact, 6) AS exact, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa, round((po - ge) / (1 - ge), 6) AS ac1,
          round(1 - within / (2 * n) / de, 6) AS alpha_interval, round(1 - unlike / (2 * n) / den, 6) AS alpha_nominal, round(bias, 6) AS bias FROM z""",
    "t8_a31_consistency": f"""{_S}, i AS (SELECT label, item, count(*) AS k, avg(rule_score) AS m, stddev_samp(rule_score) AS sd, count(DISTINCT rule_score >= 0.6) > 1 AS flips FROM scores GROUP BY ALL)
        SELECT label, count(*) AS items, round(avg(k), 6) AS mean_k, round(ifnull(avg(sd), 0), 6) AS mean_sd, round(avg(flips::INT), 6) AS flip_rate, round(avg(m), 6) AS mean FROM i GROUP BY label""",
    "t9_bootstrap": f"""{_S}, p AS (SELECT label, item, avg(rule_score) AS s FROM scores GROUP BY ALL),
        d AS (SELECT a.label, row_number() OVER (PARTITION BY a.label ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY a.label) AS n, a.s - z.s AS x FROM p a JOIN p z USING (item) WHERE z.label = 'click' AND a.label <> 'click'),
        w AS (SELECT DISTINCT label, n, rep, k, ('0x' || substr(md5(concat('42|', rep, '|', k)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT label, n FROM d), unnest(range(0, 200)) AS a(rep), unnest(range(0, n)) AS b(k)),
        m AS (SELECT w.label, rep, avg(x) AS m FROM w JOIN d USING (label, i) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) - 1 AS spot FROM m),
        t AS (SELECT label, count(*) AS n, avg(x) AS delta FROM d GROUP BY label)
        SELECT label, n, round(delta, 6) AS delta, round(max(o.m) FILTER (spot = 5), 6) AS lo, round(max(o.m) FILTER (spot = 195), 6) AS hi FROM t JOIN o USING (label) GROUP BY label, n, delta""",
    "t9_intervals": f"""{_S}, p AS (SELECT label, item, avg(rule_score) AS s FROM scores GROUP BY ALL),
        d AS (SELECT a.label, row_number() OVER (PARTITION BY a.label ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY a.label) AS n, a.s - z.s AS x FROM p a JOIN p z USING (item) WHERE z.label = 'click' AND a.label <> 'click'),
        w AS (SELECT DISTINCT label, n, rep, k, ('0x' || substr(md5(concat('42|', rep, '|', k)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT label, n FROM d), unnest(range(0, 2000)) AS a(rep), unnest(range(0, n)) AS b(k)),
        m AS (SELECT w.label, rep, avg(x) AS m FROM w JOIN d USING (label, i) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) - 1 AS spot FROM m),
        t AS (SELECT label, count(*) AS n, avg(x) AS delta FROM d GROUP BY label)
        SELECT label, n, round(delta, 6) AS delta, round(max(o.m) FILTER (spot = 50), 6) AS lo, round(max(o.m) FILTER (spot = 1950), 6) AS hi FROM t JOIN o USING (label) GROUP BY label, n, delta""",
    "t9_weighted": f"""{_S}, p AS (SELECT label, item, avg(rule_score) AS s FROM scores GROUP BY ALL), d AS (SELECT a.label, item, a.s - z.s AS x FROM p a JOIN p z USING (item) WHERE z.label = 'click' AND a.label <> 'click'),
        w AS (SELECT item, rep, {_poisson("concat('42|', rep, '|', item)")} AS w FROM (SELECT DISTINCT item FROM d), unnest(range(0, 2000)) AS a(rep)),
        m AS (SELECT label, rep, round(sum(w * x) / sum(w), 9) AS m FROM d JOIN w USING (item) WHERE w > 0 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) - 1 AS spot, count(*) OVER (PARTITION BY label) AS k FROM m),
        t AS (SELECT label, count(*) AS n, avg(x) AS delta FROM d GROUP BY label)
        SELECT label, n, round(delta, 6) AS delta, round(max(o.m) FILTER (spot = k * 25 // 1000), 6) AS lo, round(max(o.m) FILTER (spot = least(k * 975 // 1000, k - 1)), 6) AS hi FROM t JOIN o USING (label) GROUP BY label, n, delta""",
    "t10_weighted": f"""{_S}, q AS (SELECT suite, item, label, floor(sum(round(rule_score * 10)::BIGINT) / count(*)) / 10 AS score FROM scores GROUP BY ALL),
        c AS (SELECT a.suite, a.item, a.label, (count(*) FILTER (b.score < a.score) + 0.5 * count(*) FILTER (b.score = a.score))::DOUBLE / greatest(count(b.label), 1) AS credit FROM q a LEFT JOIN q b ON a.suite = b.suite AND a.item = b.item AND a.label <> b.label GROUP BY ALL),
        w AS (SELECT suite, item, rep, {_poisson("concat('t10|', rep, '|', suite, '|', item)")} AS w FROM (SELECT DISTINCT suite, item FROM c), unnest(range(0, 10000)) AS a(rep)),
        m AS (SELECT label, rep, sum(w * credit) / sum(w) AS m FROM c JOIN w USING (suite, item) WHERE w > 0 GROUP BY ALL),
        v AS (SELECT label AS a, NULL AS b, round(m, 9) AS v FROM m UNION ALL SELECT x.label, y.label, round(x.m - y.m, 9) FROM m x JOIN m y USING (rep) WHERE x.label < y.label),
        p AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY v) - 1 AS spot, count(*) OVER (PARTITION BY a, b) AS k FROM v), t AS (SELECT label, avg(credit) AS h FROM c GROUP BY 1),
        e AS (SELECT a, b, round(max(v) FILTER (spot = k * 25 // 1000), 6) AS lo, round(max(v) FILTER (spot = least(k * 975 // 1000, k - 1)), 6) AS hi, round(avg((v <= 0)::INT), 6) AS share FROM p GROUP BY a, b)
        SELECT a, b, round(x.h - coalesce(y.h, 0), 6) AS point, lo, hi, CASE WHEN b IS NOT NULL THEN share END AS share_le_0, CASE WHEN b IS NOT NULL THEN NOT (lo <= 0 AND hi >= 0) END AS separated FROM e JOIN t x ON x.label = a LEFT JOIN t y ON y.label = b""",
    "t15_correlations": f"""{_S}, p AS (SELECT label, item, principle, avg(rule_score) AS s FROM scores GROUP BY ALL), w AS (SELECT label, item, avg(s) AS mean, max(s) AS most, min(s) AS least FROM p GROUP BY ALL),
        l AS (SELECT label, item, 'mean' AS dim, mean AS v FROM w UNION ALL SELECT label, item, 'most', most FROM w UNION ALL SELECT label, item, 'least', least FROM w)
        SELECT a.dim AS d1, b.dim AS d2, round(corr(a.v, b.v), 6) AS r, count(*) AS n, abs(round(corr(a.v, b.v), 6)) >= 0.9 AS redundant FROM l a JOIN l b USING (label, item) GROUP BY ALL""",
    "t16_rouge": """WITH n AS (SELECT count(*) AS k FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, text FROM benchmark),
        w AS (SELECT doc_id, doc_id % k AS item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents, n WHERE k > 0), r AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM b),
        g AS (SELECT doc_id, item_id, 1 AS o, unnest(w) AS g FROM w UNION ALL SELECT doc_id, item_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
        h AS (SELECT item_id, 1 AS o, unnest(w) AS g FROM r UNION ALL SELECT item_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM r),
        gc AS (SELECT doc_id, item_id, o, g, count(*) AS c FROM g GROUP BY ALL), hc AS (SELECT item_id, o, g, count(*) AS c FROM h GROUP BY ALL),
        hit AS (SELECT doc_id, o, sum(least(gc.c, hc.c)) AS n FROM gc JOIN hc USING (item_id, o, g) GROUP BY ALL),
        x AS (SELECT w.doc_id, len(w.w) AS a1, len(r.w) AS b1, greatest(len(w.w) - 1, 0) AS a2, greatest(len(r.w) - 1, 0) AS b2, ifnull(h1.n, 0) AS n1, ifnull(h2.n, 0) AS n2
              FROM w JOIN r USING (item_id) LEFT JOIN hit h1 ON h1.doc_id = w.doc_id AND h1.o = 1 LEFT JOIN hit h2 ON h2.doc_id = w.doc_id AND h2.o = 2)
        SELECT doc_id, round(ifnull(n1 / nullif(a1, 0), 0)::DOUBLE, 6) AS rouge1_p, round(ifnull(n1 / nullif(b1, 0), 0)::DOUBLE, 6) AS rouge1_r, round(ifnull(2 * n1 / nullif(a1 + b1, 0), 0)::DOUBLE, 6) AS rouge1_f,
          round(ifnull(n2 / nullif(a2, 0), 0)::DOUBLE, 6) AS rouge2_p, round(ifnull(n2 / nullif(b2, 0), 0)::DOUBLE, 6) AS rouge2_r, round(ifnull(2 * n2 / nullif(a2 + b2, 0), 0)::DOUBLE, 6) AS rouge2_f FROM x""",
    "w1_w2_drift": f"""{_S}, t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, ifnull(judge_score, rule_score) AS s FROM scores),
        f AS (SELECT a.user_id, min(a.turn) AS t FROM t a JOIN t b ON a.user_id = b.user_id AND b.turn = a.turn + 1 JOIN t c ON a.user_id = c.user_id AND c.turn = a.turn + 2 WHERE a.s < 0.5 AND b.s < 0.5 AND c.s < 0.5 GROUP BY 1)
        SELECT t.user_id, count(*) AS turns, any_value(f.t) AS first_drift, round(avg(s), 6) AS adherence FROM t LEFT JOIN f USING (user_id) GROUP BY t.user_id""",
    "w7_rolling": f"""{_S}, r AS (SELECT event_id, principle, round(avg((rule_score < 0.3)::INT) OVER (PARTITION BY principle ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rate FROM scores)
        SELECT event_id, principle, rate, rate >= 0.3 AS adapts FROM r""",
    "w8_bursts": """SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 600000000 AS short_gap,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events""",
}


def _more() -> dict[str, str]:
    from millrace.functions import text as T
    from millrace.plans.q_parse import USER, _q

    return {
        "a3_a5_depth_tools_cost": rf"""WITH {RESPONSES_SQL},
            x AS (SELECT *, length(regexp_replace(regexp_extract(r, '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g')) AS think, length({USER}) AS answer,
                  list_distinct(list_transform(regexp_extract_all(r, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), lambda c: json_extract_string(c, '$.name')) || regexp_extract_all(r, '<tool>(\w+)\(', 1)) AS tools,
                  regexp_matches(r, '(?is)<ask>.*?</ask>') AND NOT regexp_matches(r, '(?is)<answer>.*?</answer>') AS ask FROM responses),
            y AS (SELECT *, len(tools) AS calls, len(list_filter(tools, lambda t: t NOT IN ('python_execute', 'web_search', 'read_url', 'get_datetime'))) AS decoys FROM x)
            SELECT profile, count(*) AS n, round(avg(think), 6) AS mean_think, round(median(think), 6) AS median_think, round(avg((think < 10)::INT), 6) AS empty_rate, round(avg(ask::INT), 6) AS ask_rate, round(avg(calls), 6) AS calls_per_response,
              round(ifnull(sum(decoys) / nullif(sum(calls), 0), 0)::DOUBLE, 6) AS decoy_rate, round(avg((calls > 0)::INT) FILTER (profile = 'no_tools'), 6) AS unnecessary_rate, round(avg(think / nullif(think + answer, 0)), 6) AS think_share, round(avg(n_chars), 6) AS mean_cost
            FROM y GROUP BY profile""",
        "a16_honesty": f"""WITH {RESPONSES_SQL}, x AS (SELECT profile, regexp_matches({USER}, '{_q(T.ABSTAINS)}') AS abstained, (category = 'real_time_data' AND profile IN ('no_tools', 'compute_only') OR doc_id % 5 = 0) AS should FROM responses),
            c AS (SELECT profile, count(*) FILTER (should AND abstained) AS tp, count(*) FILTER (abstained AND NOT should) AS fp, count(*) FILTER (should AND NOT abstained) AS fn, count(*) FILTER (NOT should AND NOT abstained) AS tn FROM x GROUP BY 1)
            SELECT *, round(ifnull(tp / nullif(tp + fp, 0), 0)::DOUBLE, 6) AS precision, round(ifnull(tp / nullif(tp + fn, 0), 0)::DOUBLE, 6) AS recall, round(ifnull(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1, round(ifnull(fp / nullif(fp + tn, 0), 0)::DOUBLE, 6) AS over_refusal FROM c""",
    }


SQL |= _more()
