"""Licence scans by canonical digest.

A text's canonical form is lower case, without copyright lines, with runs of anything but letters and digits as
one space and equivalent spellings made one. Digests (SHA-256) of the canonical forms of the whole text, of its blocks (two
lines or more between empty ones) and of its lines are joined with those of known licences: whole texts, notices of several lines, and
one-line notices within longer texts are found alike.

DataFrame expressions only. Digests are one row each and meet the catalogue in one hash join; rows of a text lie together, so
they are summed up before the shuffle, which moves one short row per text. A catalogue of up to BROADCAST texts is broadcast, a
larger one is shuffled.

Defined results: a null or empty text (or one of punctuation alone) has the empty canonical form, which is no
licence; repeated rows and null ids are carried; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import whole_text

#: Most texts of a catalogue that is broadcast: two columns of a hundred bytes.
BROADCAST = 10_000
#: Lines that only say whose the text is: "Copyright (c) ...", "Copyright 2020 ...", "© ...", "All rights reserved."
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|[<\[{]y)|©|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
NO_WORD = r"[^\p{L}\p{N}\n]+"
#: Spellings that mean the same in licences: (as found, as kept), after punctuation is gone. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("sub license", "sublicense"),
    ("non infring", "noninfring"),
    ("non commercial", "noncommercial"),
    ("copy right", "copyright"),
    ("https", "http"),
    ("whilst", "while"),
)


def _spelled(text: Column) -> Column:
    for found, kept in SPELLINGS:
        text = F.replace(text, F.lit(found), F.lit(kept))
    return text


def _bare(text: Column) -> Column:
    """The text without copyright lines and marks; its lines are trimmed, and empty ones stay."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), NO_WORD, " ")
    return F.array_join(F.transform(F.split(plain, "\n", -1), lambda line: F.trim(line)), "\n")


def _lines(bare: Column) -> Column:
    """The canonical form of each line, empty ones left out."""
    return F.split(_spelled(F.array_join(F.filter(F.split(bare, "\n", -1), lambda line: line != ""), "\n")), "\n", -1)


def _blocks(bare: Column) -> Column:
    """The canonical form of each block of two lines or more."""
    found = F.filter(F.split(F.regexp_replace(bare, r"^\n+|\n+$", ""), r"\n{2,}", -1), lambda b: F.contains(b, F.lit("\n")))
    return F.transform(found, lambda b: _spelled(F.replace(b, F.lit("\n"), F.lit(" "))))


def whole(lines: Column) -> Column:
    """The canonical form of a text from that of its lines: spellings may reach over a line's end."""
    return _spelled(F.array_join(lines, " "))


def _table(docs: DataFrame, rows: list[tuple[str, str]], names: str) -> DataFrame:
    """A small table of literals."""
    values = F.array(*[F.struct(*map(F.lit, r)) for r in rows]).cast(f"array<struct<{names}>>")
    return docs.sparkSession.range(1).select(F.inline(values))


def catalogue(docs: DataFrame, known: Iterable[tuple[str, str]]) -> DataFrame:
    """digest and licence of known texts; of several with one digest the first by name."""
    rows = _table(docs, list(known), "id:string,text:string").withColumn("bare", _bare(F.col("text")))
    return rows.select("id", F.sha2(whole(_lines(F.col("bare"))), 256).alias("digest")).groupBy("digest").agg(F.min("id").alias("licence"))


def scanned(docs: DataFrame, known: Iterable[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (of the whole text, or null), n_notices (lines and blocks that are known texts) and notices (their licences, distinct)."""
    known = list(known)
    table = catalogue(docs, known)
    rows = docs.select(F.col(id_col).alias("doc_id"), _bare(whole_text(text_col)).alias("bare")).select("doc_id", "bare", _lines(F.col("bare")).alias("lines"))
    digests = lambda texts: F.transform(texts, lambda t: F.sha2(t, 256))
    own = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(whole(F.col("lines")), 256).alias("own"), F.concat(digests(F.col("lines")), digests(_blocks(F.col("bare")))).alias("parts"))
    # The whole text's digest stands first.
    each = own.select("doc_id", "row", "own", F.posexplode(F.concat(F.array("own"), F.col("parts"))).alias("at", "digest"))
    met = each.join(F.broadcast(table) if len(known) <= BROADCAST else table, "digest", "left")
    part = F.when(F.col("at") > 0, F.col("licence"))
    return met.groupBy("row", "doc_id", "own").agg(F.max(F.when(F.col("at") == 0, F.col("licence"))).alias("license_id"), F.count(part).alias("n_notices"), F.collect_set(part).alias("notices")).select(
        "doc_id", F.col("own").alias("canonical_sha256"), "license_id", "n_notices", F.array_sort("notices").alias("notices")
    )
