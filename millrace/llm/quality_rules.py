"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule. A policy is a named, versioned mask over those bits, so that a verdict, another version of it
or an ablation is bit arithmetic on the ledger and reads no text again.

Everything is a DataFrame expression within the row: no shuffle, no Python. Defined results: a null
or empty text has no words and all counts 0; repeated rows are judged each on its own; rows of an
empty table give an empty ledger; a null doc_id is carried. Only the id and text columns are read,
so other columns' names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, whole_text

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where the SQL condition over the measurements holds. bit: its place in the ledger, never reused."""

    bit: int
    name: str
    fails: str


#: Shares are written in whole numbers, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "long_words", "word_chars > 16 * n_words"),
    Rule(5, "shouted", "100 * n_shouts > 40 * n_words"),
)

#: Policies by name and version: the rules that count. Old versions stay, so that old verdicts can be had again.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    ("web", 2): ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "shouted"),
}
CURRENT = ("web", 2)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the rules of these names."""
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in names)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is not evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(keys: Column) -> Column:
    """Words that lie in windows whose key occurs twice or more; keys: one per window, in order."""

    def starts(s: Column) -> Column:
        same = lambda x, j: (j > 0) & (F.get(s, j - 1)["k"] == x["k"]) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"]))

    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("at"))))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last"))
    return F.aggregate(_let(placed, starts), first, step, lambda a: a["n"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts (all long).

    n_lines: lines with a word; n_shouts: exclamation marks. Windows are compared by a 64-bit hash of
    their words, within one document only.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    split = text.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_replace("text", r"[^#*$%&|<>!]+", "").alias("marks"),
    )
    # A window's key is built from its halves: of one word, of two, of four, of eight.
    keyed = split.withColumn("windows", F.transform("words", lambda word: F.xxhash64(word)))
    for half in (1, 2, 4):
        later = F.slice("windows", F.lit(half + 1), F.greatest(F.size("windows") - half, F.lit(0)))
        keyed = keyed.withColumn("windows", F.zip_with("windows", later, lambda a, b: F.xxhash64(a, b)))
    keyed = keyed.withColumn("windows", F.slice("windows", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    shouts = F.length("marks") - F.length(F.translate("marks", "!", ""))
    return keyed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("marks") - shouts).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        shouts.cast("long").alias("n_shouts"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and fail_bits (long): bit r.bit is 1 where rule r fails."""
    bits = F.lit(0).cast("long")
    rows = measured(docs, id_col, text_col)
    for r in rules:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("fail_bits", bits)


def judged(rows: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """A ledger with policy (name.version) and kept: no bit of the policy's rules is set."""
    bits = mask(POLICIES[policy])
    return rows.withColumn("policy", F.lit(f"{policy[0]}.{policy[1]}")).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(bits).cast("long")) == 0)


def ablation(rows: DataFrame, policy: tuple[str, int] = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: n_fail, n_only (documents that it alone rejects) and kept_without, from one grouping by mask.

    The ledger collapses to one row per combination of bits before rules are told apart.
    """
    whole = mask(POLICIES[policy])
    combos = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in POLICIES[policy]]))
    each = combos.withColumn("r", table).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long")))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(rest == 0).alias("kept_without"),
    )
