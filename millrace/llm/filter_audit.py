"""Audit of how filters interact: what each order of them keeps, and what is each filter's share.

A document's failures are bits of a mask: A to D are told from its text alone, by one pass that writes ids, masks and
fingerprints; E (identical to the text of a smaller id) needs the whole table. For E texts are routed by their XXH64 to the
partitions of an RDD. A partition keeps, for each fingerprint, a chain of the different texts that have it, each with its
smallest id so far, and emits every id that meets a smaller one of its very text. The mapping side does the same over
what it has read (in pieces of HELD bytes), so a text with a third of all rows sends one copy a piece, not one a row; ids already
known to be later go on without their text.

The later ids and the labels are joined to the rows (id, part, mask), which carry no text. combineByKey then adds up one vector per part:
how many documents, good and toxic ones have each of the 32 masks. All orders are told from that vector, so its
size depends neither on the corpus nor on the number of orders.

Defined results: a null text is empty; a null part is the empty string. Rows of one id aren't smaller than each other, so
repeated rows of the smallest id stay; a row without an id never fails E, and lets none fail. A document is good (toxic) if
any of its rows in labels says so; null labels say nothing. Repeated rows are counted each. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import whole_text, written

FILTERS = "ABCDE"
COPY = 16
MASKS = 1 << len(FILTERS)
#: Bytes of text that a mapping task holds before it sends them on, and that a partition is meant to get.
HELD, SHARE = 16 << 20, 32 << 20
UPPER = bytes(range(0x41, 0x5B))
LATER = bytes(range(0x80, 0xC0))  # bytes that continue a code point
MARKS = b"#$%&*|"

Chain = list[list]  # of [text, smallest id]


def fingerprint(text: bytes) -> int:
    """XXH64 of a text, as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def own_failures(text: bytes) -> int:
    """The bits of A to D of a text in UTF-8."""
    words = text.split()  # of bytes: by ASCII white space
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, LATER))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


def _later(chains: dict[int, Chain], key: int, text: bytes, doc_id: int) -> int | None:
    """Puts a text with an id into its chain; the id that thereby has a smaller one, if any."""
    chain = chains.setdefault(key, [])
    for link in chain:
        if link[0] == text:
            if doc_id == link[1]:
                return None
            link[1], later = min(doc_id, link[1]), max(doc_id, link[1])
            return later
    chain.append([text, doc_id])
    return None


def _sent(rows: Iterable) -> Iterator[tuple[int, tuple[bytes | None, int]]]:
    """Of rows (id, fingerprint, text): (fingerprint, (text, id)) of different texts, and (fingerprint + id, (None, (id, fingerprint))) of ids known to have a smaller one."""
    chains: dict[int, Chain] = {}
    size = 0
    for doc_id, key, text in rows:
        text = bytes(text)
        before = len(chains.get(key, ()))
        later = _later(chains, key, text, doc_id)
        if later is not None:
            yield key + later, (None, (later, key))
        elif len(chains[key]) > before:
            size += len(text) + 200
        if size >= HELD:
            yield from _emptied(chains)
            size = 0
    yield from _emptied(chains)


def _emptied(chains: dict[int, Chain]) -> Iterator[tuple[int, tuple[bytes, int]]]:
    for key, chain in chains.items():
        for text, doc_id in chain:
            yield key, (text, doc_id)
    chains.clear()


def _not_least(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, int]]:
    """(id, fingerprint) of all ids in what _sent() has sent to one partition that have a smaller one."""
    chains: dict[int, Chain] = {}
    for key, (text, found) in routed:
        if text is None:
            yield found
        elif (later := _later(chains, key, text, found)) is not None:
            yield later, key


def _partitions(docs: DataFrame) -> int:
    """Enough partitions for SHARE bytes of text each, by the size that Spark has of the table's files."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(4 * size // SHARE + 1, 1 << 17)) if size < 1 << 60 else usual


def _own(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part, fp and mask (A to D) of every document, by one pass over the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole_text(text_col).cast("binary").alias("data"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(2)]
            columns = [pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array([own_failures(t) for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], names=["doc_id", "part", "fp", "mask"])

    return rows.mapInArrow(measured, "doc_id long, part string, fp long, mask int")


def masks(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part and mask (bit 0: A ... bit 4: E) of every document."""
    own = written(_own(docs, part_col, id_col, text_col), "masks")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary")).filter("doc_id IS NOT NULL")
    routed: RDD = texts.rdd.map(lambda r: (r[0], fingerprint(r[1]), r[1])).mapPartitions(_sent).partitionBy(_partitions(texts), lambda key: key)
    later = docs.sparkSession.createDataFrame(routed.mapPartitions(_not_least), "doc_id long, fp long", verifySchema=False)
    # An id can repeat, its text too: a row fails if its id and fingerprint are among the later ones.
    copies = later.distinct().withColumn("copy", F.lit(COPY))
    return own.join(copies, ["doc_id", "fp"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


def _one(row: tuple[int, bool, bool]) -> list[int]:
    """A vector of MASKS counts of documents, then of good, then of toxic ones."""
    return _added([0] * (3 * MASKS), row)


def _added(vector: list[int], row: tuple[int, bool, bool]) -> list[int]:
    mask, good, toxic = row
    vector[mask] += 1
    vector[MASKS + mask] += good
    vector[2 * MASKS + mask] += toxic
    return vector


def _both(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def every_order(part: str, vector: list[int]) -> Iterator[tuple]:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps."""
    steps = []
    shares = dict.fromkeys(FILTERS, 0)
    seen = range(MASKS)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            here = [m for m in seen if m & bit and not m & before]
            removed = sum(vector[m] for m in here)
            redundant = sum(vector[m] for m in seen if m & bit and m & before)
            good, toxic = (sum(vector[k * MASKS + m] for m in here) for k in (1, 2))
            before |= bit
            steps.append((order, step, name, sum(vector[m] for m in seen if not m & before), removed, redundant, vector[bit], good, toxic))
            shares[name] += removed
    for order, step, name, *counts in steps:
        yield part, "".join(order), step, *counts, shares[name]


def audited(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the five filters and step; labels: rows (doc_id, quality, toxic)."""
    said = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    rows = masks(docs, part_col, id_col, text_col).join(known, "doc_id", "left")
    keyed = rows.select("part", "mask", F.coalesce("quality", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd.map(lambda r: (r[0], tuple(r[1:])))
    vectors = keyed.combineByKey(_one, _added, _both)
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: every_order(*kv)), schema, verifySchema=False)
