"""Shards by a Feistel permutation of global row numbers.

Rows get a number 0..n-1 that follows from their identity alone (id, size, checksum of the text), not
from files or partitions. A keyed Feistel network over the next power of four, walked until it lands
below n, permutes these numbers; number p goes to shard p mod shards, slot p div shards. So shard and slot
can be computed for any row number, shard sizes differ by one row at most, slots have no gap, and the
same seed gives the same shuffle anywhere.

Numbering: rows are dealt to BUCKETS by a hash of their identity; one table of BUCKETS counts gives each
bucket's first number; within a bucket a sort numbers the identities. Rows with equal id, size and
checksum are one identity with a count, summed before any shuffle, so a hot one is one row here.

Defined results: a null text has size 16 and checksum 0; a null id is an identity like any other; repeated
rows get numbers (and places) of their own; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import whole_text, written

SHARDS = 40
SEED = 20260101
ROUNDS = 6
BUCKETS = 4096
#: Copies of one identity that one row stands for before they are dealt out.
CHUNK = 65536
OVERHEAD = 16


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, keyed."""
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & (2**64 - 1))]


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & low)
    # The halves change places at the end, so that the keys in reverse undo it.
    return (right << np.uint64(half)) | left


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The place of each row number in 0..n-1; back: the row number at each place."""
    keys, half = _keys(seed)[:: -1 if back else 1], _half_bits(n)
    out = _network(numbers.astype(np.uint64), half, keys)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], half, keys)
    return out.astype(np.int64)


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, row_number (0..n-1), and n.

    The identities are written once to the shared folder, without texts. What reaches the driver is BUCKETS counts.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    same = written(same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int")), "identities")
    counts = dict(same.groupBy("bucket").agg(F.sum("copies")).collect())
    firsts, n = [], 0
    for b in range(BUCKETS):
        firsts.append((b, n))
        n += counts.get(b, 0)
    first = same.sparkSession.createDataFrame(firsts, "bucket int, first long")
    before = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    # BUCKETS rows of two numbers: a broadcast of a fixed size.
    start = same.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(first), "bucket")
    chunks = start.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))))
    last = F.least(F.col("copies") - 1, F.col("chunk") * CHUNK + CHUNK - 1)
    each = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    return each.select("doc_id", "size", "text_crc32", (F.col("first") + F.col("before") + F.col("copy")).alias("row_number")), n


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard (int), slot (long)."""
    rows, n = numbered(docs, id_col, text_col)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column(3).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names, "shard", "slot"])

    return rows.mapInArrow(places, "doc_id " + docs.select(id_col).dtypes[0][1] + ", size long, text_crc32 long, row_number long, shard int, slot long")
