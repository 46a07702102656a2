"""Substring deduplication by hashing lines or paragraphs, and passages that lie across them.

Units are normalised (lower case, runs of white space as one space), digested with 128 bits and grouped over the whole corpus;
of each digest the earliest occurrence stays and the words of every other are cut. There are two kinds of unit:

- lines (or paragraphs: lines up to an empty one) of min_words words or more; shorter ones are too common to tell a copy;
- any PASSAGE words in a row, wherever they start and end, so that a passage inside a line, or wrapped elsewhere, is met too. In
  one text only occurrences that don't overlap the first count.

To digest every PASSAGE words in a row would multiply the corpus. So the hashes of GRAM words in a row are thinned to the least one of
each PASSAGE - GRAM + 1 neighbours: equal passages have an equal one, an anchor, and only passages around anchors that occur
twice or more are digested. A text that is a whole copy of an earlier one is cut by the digest of all its words, without
digesting its passages.

Shuffled are anchors (one for about 13 words), those digests, and each text twice, to meet its anchors and its cuts. Hot digests are
summed up before their shuffle, and joined from written tables, whose hot keys Spark can split.

Defined results: the earliest occurrence is that of the smallest id, then of the smallest first 8 bytes of the text's MD5 (between
different texts of one id), then of the smallest position; null ids come last. Rows with equal id and equal text are one document: they keep
or lose the same words. A run of cut words goes with the white space after it; if that holds a line's end and the word
before the run has none, the line's end stays. Spans are the runs, from the first word's start to the last one's end, as code
points of the original text. A null text has no units and stays null; a text that is all cut keeps its row and the
white space at its start; an empty table gives no rows. All columns of the input stay, whatever their names but those that begin
with __cut_; spans_col replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from millrace.llm.shared import WORD, dropped, forget, written

MIN_WORDS = 15
PASSAGE = 50
GRAM = 25
#: Separators by kind of unit, as a regular expression.
UNITS = {"line": "\n", "paragraph": r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"}
SPANS = "array<struct<start:int,end:int>>"
#: Positions that stand for what isn't a line: an anchor, and all words of a text.
ANCHOR, WHOLE = -1, -2
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD = re.compile(WORD)
_SPACED = re.compile(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]+)")
#: Texts go to Python in batches of so many bytes, in about.
PART = 1 << 23


def _words(text: str) -> list[bytes]:
    """The normalised words; bytes are split at ASCII white space only."""
    return text.lower().encode().split()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _rolled(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of every size words in a row: a polynomial, put together from those of 1, 2, 4 ... words."""
    part, length, out, done = words, 1, None, 0
    while size:
        if size & 1:
            # The words of out come first.
            out = part if out is None else out[: len(part) - done] * np.uint64(pow(factor, length, 1 << 64)) + part[done:]
            done += length
        size >>= 1
        if size:
            part = part[:-length] * np.uint64(pow(factor, length, 1 << 64)) + part[length:]
            length *= 2
    return out ^ (out >> np.uint64(32))


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of PASSAGE words or more."""
    grams, width = _rolled(words, GRAM, _FACTORS[0]), PASSAGE - GRAM + 1
    last = len(grams) - width + 1
    at = [s + sliding_window_view(grams[s : s + 4096 + width - 1], width).argmin(1) for s in range(0, last, 4096)]
    at = np.unique(np.concatenate(at) + np.arange(last) % 4096)
    return grams[at], at


def _digest(data: bytes) -> tuple[int, int]:
    one = xxh3_128_digest(data)
    return int.from_bytes(one[:8], "big", signed=True), int.from_bytes(one[8:], "big", signed=True)


def _units(text: str, split, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """Positions and digests of a text's lines, of all its words, and of its anchors."""
    words, pos, one, two = [], [], [], []
    for i, line in enumerate(split(text.lower())):
        own = line.encode().split()
        if len(own) >= min_words:
            a, b = _digest(b" ".join(own))
            pos.append(i)
            one.append(a)
            two.append(b)
        words += own
    if len(words) >= PASSAGE:
        hashed = _hashed(words)
        a, b = _digest(hashed.tobytes())
        anchors = _anchors(hashed)[0].view(np.int64).tolist()
        pos += [WHOLE] + [ANCHOR] * len(anchors)
        one += [a, *anchors]
        two += [b] + [0] * len(anchors)
    return pos, one, two


def _passages(text: str, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and digests of PASSAGE words in a row that hold one of these anchors."""
    words = _hashed(_words(text))
    grams, at = _anchors(words)
    at = at[np.isin(grams.view(np.int64), hot)]
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(at + GRAM - PASSAGE, 0), 1)
    np.add.at(near, at + 1, -1)
    pos = np.flatnonzero(np.cumsum(near)[: len(words) - PASSAGE + 1] > 0)
    one, two = (_rolled(words, PASSAGE, f)[pos].view(np.int64) for f in _FACTORS)
    return pos.astype(np.int32), one, two


def cut(text: str, split, lines: list[int], passages: list[int], whole: bool) -> tuple[str, list[tuple[int, int]]]:
    """The text without the words of these lines and passages (or without any), and the runs cut from it."""
    spaced = [(m.start(2), m.end()) for m in _SPACED.finditer(text)]
    gone = np.full(len(spaced), whole)
    if lines:
        counts = [len(_WORD.findall(u)) for u in split(text)]
        starts = [0, *accumulate(counts)]
        for i in lines:
            gone[starts[i] : starts[i + 1]] = True
    for p in passages:
        gone[p : p + PASSAGE] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    parts, spans, at = [], [], 0
    for a, b in edges:
        start, end = spaced[a][0], spaced[b - 1][1]
        behind = spaced[b][0] if b < len(spaced) else len(text)
        parts.append(text[at:start])
        ended = not a or "\n" in text[spaced[a - 1][1] : start]
        if "\n" in text[end:behind] and not ended:
            parts.append("\n")
        spans.append((start, end))
        at = behind
    return "".join([*parts, text[at:]]), spans


def _splitter(kind: str):
    pattern = re.compile(UNITS[kind])
    return pattern.split


def _cutter(kind: str):
    split = _splitter(kind)

    @F.pandas_udf(f"text string, spans {SPANS}")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        forget()
        for texts, lines, passages, whole in batches:
            out = []
            for t, gone, runs, every in zip(texts, lines, passages, whole):
                if t is None:
                    out.append((None, []))
                    continue
                left, spans = cut(t, split, sorted(map(int, gone)), sorted(map(int, runs)), bool(every))
                out.append((left, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["text", "spans"])

    return made


def _place(*more: str) -> Column:
    """The order of occurrences."""
    return F.struct(F.col("rank").isNull().alias("last"), "rank", "of", *more)


def _later(found: DataFrame, *more: str, gap: int = 0) -> DataFrame:
    """found (written; rank, of, one, two and more) without each digest's earliest occurrence and what overlaps it."""
    first = found.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(_place(*more)).alias("first")).filter("n > 1").drop("n")
    first = written(first, "first")
    far = ~F.struct("rank", "of").eqNullSafe(F.struct("first.rank", "first.of"))
    for name in more:
        far = far | (F.col(name) >= F.col(f"first.{name}") + max(gap, 1))
    return found.join(first, ["one", "two"]).filter(far).select("rank", "of", *more)


def _meets(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows with those of keys for their rank and text; keys has no other column of rows' names."""
    keys = keys.withColumnRenamed("rank", "__cut_rank2").withColumnRenamed("of", "__cut_of2")
    # One plan at any size: the cost of a larger table is that of a smaller one in proportion.
    met = rows.join(keys.hint("merge"), F.col("__cut_rank").eqNullSafe(F.col("__cut_rank2")) & (F.col("__cut_of") == F.col("__cut_of2")), how)
    return met.drop("__cut_rank2", "__cut_of2")


def repeated(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rank (the id), of (8 bytes of the text's MD5), lines, passages (positions) and whole of documents with units that occurred earlier."""
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("__cut_rank"), text_key(text).alias("__cut_of"), text.alias("__cut_data"))
    rank = rows.dtypes[0][1]
    split = _splitter(kind)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            held, each = 0, []
            for n in range(b.num_rows):
                each.append((n, *_units(b.column(2)[n].as_py(), split, min_words)))
                held += len(each[-1][1])
                if held > PART // 32 or n == b.num_rows - 1:
                    at = pa.array(np.repeat([e[0] for e in each], [len(e[1]) for e in each]).astype(np.int64))
                    found = [pa.array([x for e in each for x in e[c]], k) for c, k in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *found], names=["rank", "of", "pos", "one", "two"])
                    held, each = 0, []

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for n in range(b.num_rows):
                pos, one, two = _passages(b.column(2)[n].as_py(), b.column(3)[n].values.to_numpy())
                same = [pa.repeat(b.column(c)[n], len(pos)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(pos), pa.array(one), pa.array(two)], names=["rank", "of", "pos", "one", "two"])

    unit = f"rank {rank}, of binary, pos int, one long, two long"
    units = written(rows.mapInArrow(scanned, unit), "units")
    whole = written(_later(units.filter(F.col("pos") == WHOLE)).distinct(), "whole")
    lines = written(_later(units.filter("pos >= 0"), "pos"), "lines")
    copies = whole.withColumnRenamed("rank", "rank2").withColumnRenamed("of", "of2").hint("merge")
    own = (F.col("rank").eqNullSafe(F.col("rank2"))) & (F.col("of") == F.col("of2"))
    anchors = written(units.filter(F.col("pos") == ANCHOR).select("rank", "of", "one").join(copies, own, "left_anti"), "anchors")
    dropped(units)
    twice = written(anchors.groupBy("one").count().filter("count > 1").select("one"), "twice")
    hot = written(anchors.join(twice.hint("merge"), "one").groupBy("rank", "of").agg(F.collect_set("one").alias("hot")), "hot")
    dropped(anchors, twice)
    met = _meets(rows, hot, "inner").select("__cut_rank", "__cut_of", "__cut_data", "hot")
    # Rows with equal id and text give their passages twice; they are no other place.
    passages = written(met.mapInArrow(digested, unit), "passages")
    dropped(hot)
    runs = _later(passages, "pos", gap=PASSAGE)
    none = F.lit(None).cast("int")
    every = lines.select("rank", "of", F.col("pos").alias("line"), none.alias("passage"), F.lit(False).alias("every"))
    every = every.unionByName(runs.select("rank", "of", none.alias("line"), F.col("pos").alias("passage"), F.lit(False).alias("every")))
    every = every.unionByName(whole.select("rank", "of", none.alias("line"), none.alias("passage"), F.lit(True).alias("every")))
    gone = every.groupBy("rank", "of").agg(F.collect_set("line").alias("lines"), F.collect_set("passage").alias("passages"), F.max("every").alias("whole"))
    gone = written(gone, "gone")
    dropped(passages)
    return gone


def text_key(text: Column) -> Column:
    """What tells different texts of one id apart, and orders them."""
    return F.substring(F.unhex(F.md5(text)), 1, 8)


def deduplicated(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed") -> DataFrame:
    """docs (a table; it is read three times) without repeated units in the text column, and spans_col: the runs cut, (start, end) in the original."""
    text = F.col(text_col)
    gone = repeated(docs, kind, min_words, id_col, text_col).select("rank", "of", *[F.col(c).alias(f"__cut_{c}") for c in ("lines", "passages", "whole")])
    keyed = docs.withColumns({"__cut_rank": F.col(id_col), "__cut_of": text_key(text)})
    met = _meets(keyed, gone, "left")
    changed = F.col("__cut_whole").isNotNull()
    done = met.withColumn("__cut_done", _cutter(kind)(F.when(changed, text), "__cut_lines", "__cut_passages", "__cut_whole"))
    kept = {c: F.col(f"`{c}`") for c in docs.columns}
    kept[text_col] = F.when(changed, F.col("__cut_done.text")).otherwise(text).alias(text_col)
    kept[spans_col] = F.when(changed, F.col("__cut_done.spans")).otherwise(F.array().cast(SPANS)).alias(spans_col)
    return done.select(*kept.values())
