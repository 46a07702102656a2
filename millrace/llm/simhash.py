"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is the majority, bit by bit, of the hashes of a text's word shingles. Anchors are
the words of a covering code: the direct sum of perfect cyclic codes of lengths 23, 23, 15 and 3 (radii
3, 3, 1 and 1), 2**36 anchors in all, so that every fingerprint lies within the radius of exactly one. Each
fingerprint is replicated to every anchor within the radius plus its share of the threshold, and
fingerprints are compared per anchor. Two fingerprints at distance d have a midpoint within ceil(d / 2)
of each, and the midpoint's own anchor lies within the radius of it; so replicating to radius plus
ceil(threshold / 2) makes every pair within the threshold meet, at a tenth of the copies that radius plus
the whole threshold would need (19 at most against 191).

Documents with equal fingerprints are one node from the start. Per anchor only a spanning forest of the
links is kept. Few fingerprints share an anchor, as 2**36 anchors are dealt out; if an anchor is hot, its
fingerprints are joined over single-bit flips in slices, in time linear in their number.

Defined results: a null or empty text, or one without a word, has fingerprint 0, linked like any other;
a null id is carried and never chosen as a component's id unless there is no other; repeated rows are
members each on its own; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.components import components
from millrace.llm.shared import whole_text, written

SHINGLE = 3
THRESHOLD = 2
HASH_SEED = 42
#: Cyclic perfect codes by length, generator polynomial and covering radius; together 64 bits.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))
#: Fingerprints of one anchor from which on they are joined over flips instead of with each other.
HOT_ANCHOR = 4096
#: Keys held at once when a hot anchor's fingerprints are joined.
SLICE = 1 << 21


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    """The fingerprint of a UTF-8 text: majority of the XXH64 bits of its shingles, repeats included."""
    words = data.lower().split()  # of bytes: only A-Z changes, and only ASCII white space parts
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 32768):
        part = hashes[start : start + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = HASH_SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(made, f"doc_id {rows.dtypes[0][1]}, fp long")


class Block:
    """Nearest words of one cyclic perfect code: a word minus the error that its syndrome tells."""

    def __init__(self, length: int, generator: int, radius: int):
        degree = generator.bit_length() - 1
        self.length, at = length, []
        for i in range(length):
            rest = 1 << i
            while rest.bit_length() > degree:
                rest ^= generator << (rest.bit_length() - 1 - degree)
            at.append(rest)
        self.syndromes = np.array(at, np.uint32)
        self.errors = np.zeros(1 << degree, np.uint32)
        for weight in range(1, radius + 1):
            for places in combinations(range(length), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= at[p]
                self.errors[syndrome] = sum(1 << p for p in places)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint32)
        for i, s in enumerate(self.syndromes):
            out ^= ((x >> np.uint32(i)) & np.uint32(1)) * s
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code word nearest to x, and (rows, length) those nearest to x with each one bit flipped."""
        own = self.syndrome(x)
        flips = np.uint32(1) << np.arange(self.length, dtype=np.uint32)
        return x ^ self.errors[own], (x[:, None] ^ flips) ^ self.errors[own[:, None] ^ self.syndromes]


_BLOCKS: list[Block] = []


def _blocks() -> list[Block]:
    if not _BLOCKS:
        _BLOCKS.extend(Block(*c) for c in CODES)
    return _BLOCKS


def anchors(fps: np.ndarray, slack: int = (THRESHOLD + 1) // 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, anchor): all anchors within the covering radius plus slack of each fingerprint.

    They are the nearest code words of all points within slack flips of the fingerprint.
    """
    if slack > 1:
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        near = (fps[:, None] ^ flips).ravel()
        row, anchor = anchors(near, slack - 1)
        both = np.unique(np.stack([(row // 65).astype(np.uint64), anchor], 1), axis=0)
        return both[:, 0].astype(np.int64), both[:, 1]
    words, others, low = np.zeros(len(fps), np.uint64), [], 0
    for block in _blocks():
        own, near = block.nearest(((fps >> np.uint64(low)) & np.uint64((1 << block.length) - 1)).astype(np.uint32))
        words |= own.astype(np.uint64) << np.uint64(low)
        others.append((near ^ own[:, None]).astype(np.uint64) << np.uint64(low))
        low += block.length
    found = words[:, None] if not slack else np.concatenate([words[:, None], *(words[:, None] ^ o for o in others)], 1)
    found = np.sort(found, 1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per node but the smallest: (node, smallest node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, label[x], least)
        np.minimum.at(now, label[y], least)
        now = np.minimum(now, now[now])
        if (now == label).all():
            break
        label = now
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _flip_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among many fingerprints within 2 bits: those that share a point one flip away, in slices of the points."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    slices = -(-len(fps) * len(flips) // SLICE)
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for s in range(slices):
        points, owners = [], []
        for f in flips:
            p = fps ^ f
            mine = (p * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == s
            points.append(p[mine])
            owners.append(fps[mine])
        point, owner = np.concatenate(points), np.concatenate(owners)
        order = np.lexsort((owner, point))
        point, owner = point[order], owner[order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], point[1:] != point[:-1]]), np.arange(len(point)), 0))
        linked = owner != owner[first]
        a, b = _forest(np.concatenate([a, owner[linked]]), np.concatenate([b, owner[first][linked]]))
    return a, b


def _links(anchor: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within whole anchor groups (rows sorted by anchor)."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    hot = sizes > HOT_ANCHOR if threshold == 2 else np.zeros(len(sizes), bool)
    for s, n in zip(starts[hot], sizes[hot]):
        x, y = _flip_links(np.unique(fps[s : s + n]))
        a.append(x)
        b.append(y)
    at, step, held = np.flatnonzero(np.repeat(~hot & (sizes > 1), sizes)), 1, 0
    while len(at):
        at = at[at + step < len(anchor)]
        at = at[anchor[at + step] == anchor[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= threshold]
        a.append(fps[near])
        b.append(fps[near + step])
        held += len(near)
        step += 1
        if held > SLICE:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    return _forest(np.concatenate(a), np.concatenate(b))


def linked(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between different fingerprints fp (long, distinct rows) within threshold bits, enough to connect all that are."""
    slack = (threshold + 1) // 2

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(every), 4096):
                part = every[start : start + 4096]
                row, anchor = anchors(part, slack)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[row].view(np.int64))], names=["anchor", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_a, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(anchor, fp):
            a, b = _links(anchor, fp.view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            anchor = np.concatenate([rest_a, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_f, batch.column(1).to_numpy()])
            if not len(anchor):
                continue
            whole = np.searchsorted(anchor, anchor[-1])  # the last anchor's rows may go on in the next batch
            if whole:
                yield found(anchor[:whole], fp[:whole])
            rest_a, rest_f = anchor[whole:], fp[whole:]
        if len(rest_a):
            yield found(rest_a, rest_f)

    met = fps.select("fp").mapInArrow(replicated, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compared, "a long, b long").distinct()


def classes(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fp (distinct) and component_id of rows (doc_id, fp; written, not computed): the smallest doc_id reachable over links."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(linked(nodes, threshold)).withColumnRenamed("node", "fp")
    members = written(nodes.join(roots, "fp"), "members")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    tied = members.join(least, "root").select("fp", "least")
    # Written, so that the join with all rows is one of two plain tables, whose hot keys Spark can split.
    return written(nodes.join(tied, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = HASH_SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id of every row."""
    rows = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    return rows.join(classes(rows, threshold), "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp") -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
