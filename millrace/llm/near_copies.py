"""Near copies: exact Jaccard similarity of word shingles, on what minwise hashes bring together.

A text is the set of the hashes of its five-word shingles. Texts of equal sets are one from the start. The ROWS * BANDS minwise
hashes of a set are cut into bands; sets that agree in a band meet, which at similarity 0.8 fails with a chance of 5e-6. Sets
that meet, over others too, are one group, and in a group every pair that can reach the similarity (by prefixes in order of
rarity) and isn't connected yet is compared exactly. A group of more than BLOCK texts, or BLOCK_BYTES, is dealt to blocks, and
every two blocks are compared by a task of their own: no task holds more than two blocks, and no pair is left out.

It goes with the fingerprints of simhash.py in the pipeline's stage, which by themselves can't find all copies of that similarity at a
cost that fits: see the README.

Defined results: texts without a word are equal to each other, texts of fewer words than a shingle have one; a null text is
an empty one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from millrace.llm.components import components
from millrace.llm.shared import dropped, written

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
SEED = 42
#: Shingles hashed at once.
PART = 2048
#: Texts, and bytes of them, that one task holds twice at most when it compares a group.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_rng = np.random.default_rng(SEED)
_ADD = _rng.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles of a UTF-8 text."""
    words = data.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band of a set's minwise hashes."""
    least = np.full(ROWS * BANDS, np.uint64(2**64 - 1))
    for start in range(0, len(hashes), PART):
        mixed = (hashes[start : start + PART, None] ^ _ADD) * _FACTOR
        least = np.minimum(least, mixed.min(0))
    least ^= least >> np.uint64(29)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(31))


def joined(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """Per set the smallest index reachable over pairs of at least that Jaccard similarity; all pairs that can reach it meet."""
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    own = np.split(rarity[at], np.cumsum([len(s) for s in sets])[:-1])
    parent, index = list(range(len(sets))), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(own):
        own[i] = s = np.sort(s)
        n = len(s)
        prefix = s[: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
        for j in sorted({j for t in prefix for j in index.get(t, ())}):
            a, b = root(i), root(j)
            if a == b or min(n, len(own[j])) < similarity * max(n, len(own[j])) - 1e-9:
                continue
            both = len(np.intersect1d(s, own[j], assume_unique=True))
            if both >= similarity * (n + len(own[j]) - both) - 1e-9:
                parent[max(a, b)] = min(a, b)
        for t in prefix:
            index.setdefault(t, []).append(i)
    return [root(i) for i in range(len(sets))]


def signature(data: bytes) -> tuple[int, int, np.ndarray]:
    """Digest of a text's set of shingles (two signed halves), and its bands."""
    hashes = shingles(data)
    digest = xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), bands(hashes).view(np.int64)


def equal_sets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) from every node to the first one of an equal set, and (node, bands) of those first ones; signed: node, one, two, bands."""
    first = written(signed.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1").drop("n"), "equal")
    met = signed.select("node", "one", "two").join(first, ["one", "two"]).filter("node <> first")
    links = written(met.select(F.col("node").alias("a"), F.col("first").alias("b")), "equal-links")
    return links, signed.select("node", "bands").join(links.select(F.col("a").alias("node")), "node", "left_anti")


def met(sets: DataFrame) -> DataFrame:
    """Links (a, b) from every node to the first one of each of its bands; sets: node, bands."""
    each = written(sets.select(F.explode("bands").alias("band"), "node"), "bands")
    shared = written(each.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1").drop("n"), "shared-bands")
    links = written(each.join(shared, "band").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "met")
    dropped(each, shared)
    return links


def dealt(groups: DataFrame) -> DataFrame:
    """One row for each task that a text is compared in: node, root, i and j (blocks); groups (written): node, root, size (bytes)."""
    total = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = groups.join(written(total.select("root", blocks.alias("blocks")), "blocks"), "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # A block is compared with every other; with one block, or the last to be paired, with itself.
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.filter("blocks = 1 OR own <> other")
    return paired.select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def verified(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the texts of each task that reach the similarity, enough to connect all that do; members: node, root, i, j, data."""

    def compared(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        data = group.column("data")
        roots = joined([shingles(x.as_py()) for x in data], similarity)
        far = [n for n, r in enumerate(roots) if r != n]
        return pa.table({"a": pa.array([nodes[n] for n in far], pa.int64()), "b": pa.array([nodes[roots[n]] for n in far], pa.int64())})

    return members.select("node", "root", "i", "j", "data").groupBy("root", "i", "j").applyInArrow(compared, "a long, b long")
