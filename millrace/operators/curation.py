"""Curation of chat trajectories: gates, deduplication, caps, variants, order.

A trajectory is one row with messages ARRAY<STRUCT<pos, role, content>>; a long table of messages is one row per
message. Each function maps a DataFrame to a DataFrame; counts of what was dropped come from the reason column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import digest, uniform
from millrace.operators.ranks import numbered

MIN_RESPONSE = 80
MIN_THINK = 150
#: Most tool calls of a trajectory, and characters under which one is of the first stage.
MOST_CALLS = 5
SHORT = 600
#: Marks of a teacher's prompt, and phrases of its scaffolding. Fixed values.
LEAKS = (
    "you are a frontier ai assistant generating exemplary training data",
    "mandatory output format — follow this exactly",
    "critical format rules — violation invalidates the training example",
    "your reasoning principles (demonstrate through behavior",
)
BANNED = ("capability_check", "consequence_check", "principle_", "5w+h:", "first_principles:", "none flagged", "see answer below", "inferred from question")


def trajectories(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, messages: the long table's rows of one conversation, by position."""
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def _content(messages: Column, at: int) -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(at))["content"], F.lit(""))


def system_text(messages: Column) -> Column:
    return _content(of_role(messages, "system"), 1)


def first_think(messages: Column) -> Column:
    """The first assistant message's reasoning; null if it has none, even if a later one does."""
    first = _content(of_role(messages, "assistant"), 1)
    return F.when(T.has_tag(first, "think"), T.strip(T.tag_body(first, "think")))


def user_key(messages: Column) -> Column:
    return T.strip(_content(of_role(messages, "user"), 1))


def gate_reason(messages: Column) -> Column:
    """'ok', or the first rule that the trajectory breaks."""
    first, last = _content(of_role(messages, "assistant"), 1), _content(of_role(messages, "assistant"), -1)
    system, think = F.lower(system_text(messages)), first_think(messages)
    thinks = F.flatten(F.transform(of_role(messages, "assistant"), lambda m: F.regexp_extract_all(F.lower(m["content"]), F.lit("(?s)<think>(.*?)</think>"), 1)))
    banned = F.exists(thinks, lambda t: F.exists(F.array(*map(F.lit, BANNED)), lambda p: F.contains(t, p)))
    return (
        F.when(F.size(messages) < 3, "too_few_messages")
        .when(F.size(of_role(messages, "assistant")) == 0, "no_assistant_message")
        .when(F.size(of_role(messages, "system")) == 0, "no_system_message")
        .when(F.exists(F.array(*map(F.lit, LEAKS)), lambda p: F.contains(system, p)), "teacher_constitution_leaked")
        .when(F.length(first) < MIN_RESPONSE, "response_too_short")
        .when(~F.contains(last, F.lit("<answer>")) & ~F.contains(last, F.lit("</answer>")), "missing_tag_answer")
        .when(think.isNull(), "missing_think_block")
        .when(F.length(think) < MIN_THINK, "think_too_short")
        .when(banned, "banned_think_phrase")
        .otherwise("ok")
    )


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key that isn't empty; by minimum, not by window, so that a hot key is summed up before the shuffle."""
    kept = rows.withColumn("__key", key).filter("__key IS NOT NULL AND __key <> ''")
    columns = [c for c in rows.columns if c not in order]
    first = kept.groupBy("__key").agg(F.min(F.struct(*order, *columns)).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


def capped(rows: DataFrame, by: str, most: int, seed: str, key: str) -> DataFrame:
    """At most so many rows per category, chosen by a keyed hash."""
    w = Window.partitionBy(by).orderBy(digest(seed, F.col(key)), key)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def variants(rows: DataFrame, shares: dict[str, float], seed: str, key: str, prompt: Column) -> DataFrame:
    """For each level, copies of a share of rows, with prompt(level) in place of every system message."""
    table = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(share).alias("share")) for level, share in shares.items()]))
    drawn = rows.withColumn("__v", table).filter(uniform(seed, F.col("__v.level"), F.col(key)) < F.col("__v.share"))
    level = F.col("__v.level")
    swapped = F.transform("messages", lambda m: F.when(m["role"] == "system", F.struct(m["pos"], m["role"], F.concat(prompt, F.lit(" "), level).alias("content"))).otherwise(m))
    return drawn.select(*[swapped.alias("messages") if c == "messages" else c for c in rows.columns], level.alias("level"))


def interleaved(a: DataFrame, b: DataFrame, ratio: int, order_a: str, order_b: str) -> DataFrame:
    """Rows of a in order, one of b after every ratio of them, the rest of b at the end: rows with place, from 1.

    Places follow from each side's own numbers, so nothing is sorted as a whole.
    """
    na, nb = a.count(), b.count()
    full = min(na // ratio, nb)
    left = numbered(a, order_a).withColumn("place", F.col("number") + 1 + F.least(F.expr(f"number div {ratio}"), F.lit(full)))
    number = F.col("number")
    right = numbered(b, order_b).withColumn("place", F.when(number < full, (number + 1) * ratio + number + 1).otherwise(na + number + 1))
    return left.unionByName(right).drop("number")


def batches(have: DataFrame, targets: dict[str, int], axes: int, size: int = 15, seed: str = "axes") -> DataFrame:
    """category, start, n and axis of the batches that a set still needs: as many as the target lacks, size at a time; each begins at the axis of its first item's number, in a cycle shuffled by category.

    have: category of every item that there is; categories without a target are left out.
    """
    spark = have.sparkSession
    wanted = spark.createDataFrame(list(targets.items()), "category string, target long")
    lacks = wanted.join(have.groupBy("category").agg(F.count("*").alias("n")), "category", "left").withColumn("needed", F.greatest(F.lit(0), F.col("target") - F.coalesce("n", F.lit(0))))
    starts = lacks.filter("needed > 0").select("category", "needed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("needed") - 1, F.lit(size).cast("long"))).alias("start"))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(axes - 1)), lambda i: F.struct(digest(seed, F.col("category"), i).alias("h"), i.alias("i")))), lambda x: x["i"])
    return starts.select("category", "start", F.least(F.lit(size), F.col("needed") - F.col("start")).alias("n"), F.get(order, (F.col("start") % axes).cast("int")).alias("axis"))
