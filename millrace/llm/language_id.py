"""Language identification by rank-order profiles.

A language's profile is the list of its PROFILE most frequent n-grams of one to three letters, by count and then
by code points; a document's is made alike from its whole text. The out-of-place distance of a document to a
language sums, over the document's n-grams, how far apart the two ranks are, or PROFILE where the language's
profile lacks the n-gram. The language of the smallest distance is the prediction; of equal ones the first by
name.

Words are runs of letters and marks (Unicode classes L and M), lower-cased one code point at a time; each has a
blank at either end, which counts as a letter but not alone. So signs, digits, addresses and markup weigh little.

Training counts the n-grams of all labelled documents: tasks count blocks of text at once and give sums, which are
added before and after one shuffle by language and n-gram. Profiles are taken in two steps (by language and
part of the n-grams, then by language), so that a language with most of the corpus is no single task's. Only
profiles reach the driver: PROFILE rows for each value of the language column. Documents are then
judged one by one, without a shuffle.

Defined results: 'und' with score 0 for a null text, a text without a letter, or where no language has been
learned. A null label isn't learned from. Repeated rows are counted and judged each on its own; null ids are
carried; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import kept

PROFILE = 400
BLANK = 0x20
#: Windows counted at once, and n-grams that a task holds before it gives them away.
BLOCK, HELD = 1 << 20, 1 << 20
PARTS = 8


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it counts as (a letter as its lower-case form, a mark as itself, all else blank), and whether it is a letter."""
    to, letter = np.full(0x110000, BLANK, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            to[code], letter[code] = ord(chr(code).lower()[0]), True
        elif kind == "M":
            to[code] = code
    return to, letter


def symbols() -> tuple[np.ndarray, np.ndarray]:
    return kept("language symbols", _symbols)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """The n-grams of a text in ascending order, how often each occurs, and whether it has a letter.

    An n-gram is a long of three code points of 21 bits, missing ones 0: their order is that of the strings.
    """
    to, letter = symbols()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = np.concatenate([[BLANK], to[codes], [BLANK]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != BLANK) | (s[:-1] != BLANK)])]
    parts = []
    for i in range(0, len(s), BLOCK):
        own = s[i : i + BLOCK + 2]
        one, two, three = own[:BLOCK], own[: BLOCK + 1], own
        keys = [one[one != BLANK] << 42, two[:-1] << 42 | two[1:] << 21, (three[:-2] << 42 | three[1:-1] << 21 | three[2:])[three[1:-1] != BLANK]]
        parts.append(np.unique(np.concatenate(keys), return_counts=True))
    keys, counts = parts[0] if len(parts) == 1 else _merged(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return keys, counts, bool(letter[codes].any())


def _counted(rows: DataFrame) -> DataFrame:
    """lang, gram and n of rows (lang, text): one or more rows an n-gram and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = _merged(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        def counted(lang: str, texts: list[str]) -> int:
            keys, counts, _ = ngrams("\n".join(texts))
            held.setdefault(lang, []).append((keys, counts))
            return len(keys)

        for b in batches:
            blocks: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= BLOCK:
                    size += counted(lang, blocks.pop(lang))
                    sizes[lang] = 0
            size += sum(counted(lang, texts) for lang, texts in blocks.items())
            if size >= HELD:
                yield from given()
                size = 0
        yield from given()

    return rows.mapInArrow(run, "lang string, gram long, n long")


def ranked(docs: DataFrame, learned: Column | None = None, profile: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n and rank (from 0) of the profile of every language, learned from the rows where learned holds."""
    rows = docs if learned is None else docs.filter(learned)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    sums = _counted(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    some = sums.withColumn("rank", first("lang", "part")).filter(F.col("rank") <= profile)
    best = some.withColumn("rank", first("lang")).filter(F.col("rank") <= profile)
    return best.select("lang", "gram", "n", (F.col("rank") - 1).alias("rank"))


@dataclass(frozen=True)
class Profiles:
    """The languages by name, all n-grams of their profiles in ascending order, and each one's rank by language."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def language(self, text: str | None) -> tuple[str, float]:
        """The language of a text, and 1 less its distance as a share of the largest possible one."""
        keys, counts, letters = ngrams(text or "")
        if not letters or not self.langs:
            return "und", 0.0
        own = keys[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        there = self.ranks[at[known]]
        apart = np.where(there < 0, self.size, np.abs(there - np.flatnonzero(known)[:, None]))
        distances = apart.sum(axis=0) + self.size * int((~known).sum())
        best = int(distances.argmin())
        return self.langs[best], 1 - int(distances[best]) / (self.size * len(own))


def profiles(docs: DataFrame, learned: Column | None = None, profile: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """The profiles of all languages of docs."""
    rows = ranked(docs, learned, profile, text_col, lang_col).collect()
    langs = tuple(sorted({r.lang for r in rows}))
    number = {lang: i for i, lang in enumerate(langs)}
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(grams), len(langs)), -1, np.int64)
    ranks[np.searchsorted(grams, [r.gram for r in rows]), [number[r.lang] for r in rows]] = [r["rank"] for r in rows]
    return Profiles(langs, grams, ranks, profile)


def identified(docs: DataFrame, known: Profiles, text_col: str = "text", *keep: str | Column) -> DataFrame:
    """The kept columns, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.language(x.as_py()) for x in b.column(b.num_columns - 1)]
            columns = [*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double")
