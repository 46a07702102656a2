"""Bounded-space online packing of token sequences.

Each partition keeps at most OPEN open windows. A document's ids (and the end id) are cut into full
windows first; its rest goes into the open window that it fills best. When none can take it and OPEN are
open, the fullest is emitted: topped up with the head of the rest if its gap is MIN_CUT ids or more, else
padded. What is open at a partition's end is merged with the leftovers of FAN_IN - 1 other partitions: their
pieces are packed best-fit by falling length, the emptiest windows are then cut up to fill the gaps of
the others, and the last window is parted into powers of two, which need no padding.

Memory is bounded by OPEN windows per task and FAN_IN * OPEN in the merge, however large the input.
Partitions' results are written once to the shared folder; a lost executor costs its own tasks.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each on its
own; a null id is carried; an empty table gives no rows. Only id and text are read. A vocabulary's added tokens that stand in a text
have their own ids, as the library gives them.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import kept, whole_text, written
from millrace.llm.tokens import ByteLevel, CachedEncoder

WINDOW = 2048
OPEN = 64
MIN_CUT = 8
FAN_IN = 8
END = 1
BYTES = 4


@dataclass
class Piece:
    """A run of one document's ids; ids are little-endian unsigned 32-bit."""

    doc: object
    start: int
    total: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // BYTES

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids, and the rest."""
        return Piece(self.doc, self.start, self.total, self.ids[: BYTES * n]), Piece(self.doc, self.start + n, self.total, self.ids[BYTES * n :])


@dataclass
class Open:
    """An open window."""

    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece)


class Packer:
    """Best fit into a bounded number of open windows; full() yields those that are done."""

    def __init__(self, size: int = WINDOW, most: int = OPEN, min_cut: int = MIN_CUT):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.gaps: list[tuple[int, int]] = []  # (gap, key) of open windows, sorted
        self.windows: dict[int, Open] = {}
        self.made = 0

    def _keep(self, window: Open) -> list[Open]:
        if window.used == self.size:
            return [window]
        self.made += 1
        self.windows[self.made] = window
        insort(self.gaps, (self.size - window.used, self.made))
        return []

    def put(self, piece: Piece) -> list[Open]:
        """Windows that are done once the piece is placed."""
        done = []
        while len(piece) >= self.size:
            head, piece = piece.cut(self.size)
            done.append(Open([head], self.size))
        if not len(piece):
            return done
        at = bisect_left(self.gaps, (len(piece), 0))
        if at < len(self.gaps):
            window = self.windows.pop(self.gaps.pop(at)[1])
        elif len(self.gaps) < self.most:
            window = Open()
        else:
            gap, key = self.gaps.pop(0)
            fullest = self.windows.pop(key)
            if gap >= self.min_cut:
                head, piece = piece.cut(gap)
                fullest.add(head)
            return done + [fullest] + self.put(piece)
        window.add(piece)
        return done + self._keep(window)

    def left(self) -> list[Open]:
        """The windows still open, fullest first."""
        return [self.windows[key] for _, key in self.gaps]


def merged(pieces: list[Piece], size: int = WINDOW, min_cut: int = MIN_CUT) -> list[Open]:
    """Windows of leftover pieces, with little padding: cut where that closes a gap; the last in powers of two."""
    packer = Packer(size, len(pieces) + 1, min_cut)
    done: list[Open] = []
    for p in sorted(pieces, key=len, reverse=True):
        done += packer.put(p)
    rest = packer.left()  # fullest first
    first = 0
    while first < len(rest) - 1:
        gap = size - rest[first].used
        if gap < min_cut:
            done.append(rest[first])
            first += 1
            continue
        # Fill the gap from the emptiest window.
        source = rest[-1]
        piece = source.pieces.pop()
        source.used -= len(piece)
        if len(piece) > gap:
            piece, kept = piece.cut(gap)
            source.add(kept)
        rest[first].add(piece)
        if not source.pieces:
            rest.pop()
    for window in rest[first:]:
        now, room = Open(), 0
        left = window.used
        for piece in window.pieces:
            while len(piece):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    now = Open()
                    done.append(now)
                head, piece = piece.cut(min(room, len(piece)))
                now.add(head)
                room -= len(head)
                left -= len(head)
    return done


def _rows(kind: str) -> str:
    return f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def _listed(window: Open, sequence: int | None, with_ids: bool) -> list[tuple]:
    out, at = [], 0
    for p in window.pieces:
        out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, at, p.ids if with_ids or sequence is None else None))
        at += len(p)
    return out


def packed(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    window: int = WINDOW,
    open_windows: int = OPEN,
    min_cut: int = MIN_CUT,
    fan_in: int = FAN_IN,
    end: int = END,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless with_ids).

    tokenizer: path of a byte-level vocabulary of the library tokenizers, readable on every executor; pattern: what
    splits a text before the merges. A sequence is padded to window unless its length is a power of two.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.dtypes[0][1]
    last = end.to_bytes(BYTES, "little")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern).encoded
        packer, part, n = Packer(window, open_windows, min_cut), TaskContext.get().partitionId(), 0
        doc_type = None
        for b in batches:
            doc_type = b.schema.field(0).type
            out = []
            texts = (data[4 * a : 4 * b] for ids, edges in encode(b.column(1)) for data in [memoryview(ids).cast("B")] for a, b in pairwise(edges.tolist()))
            for doc, text in zip(b.column(0).to_pylist(), texts):
                ids = bytes(text) + last
                for w in packer.put(Piece(doc, 0, len(ids) // BYTES, ids)):
                    out += _listed(w, (part << 32) + n, with_ids)
                    n += 1
                if len(out) > 4096:
                    yield _batch(out, doc_type)
                    out = []
            if out:
                yield _batch(out, doc_type)
        for w in packer.left():
            yield _batch([(*r[:5], part, *r[6:]) for r in _listed(w, None, True)], doc_type, False)

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("sequence_id", "length", "start", "ids_crc32")])
        pieces = [Piece(*p) for p in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")))]
        out = []
        for n, w in enumerate(merged(pieces, window, min_cut)):
            out += _listed(w, ((1 << 30) + key[0].as_py() << 32) + n, with_ids)
        return pa.Table.from_batches([_batch(out, rows.schema.field("doc_id").type).select(list(FIELDS))])

    # done is false for leftovers, whose sequence_id is the partition for now.
    schema = _rows(kind) + ", done boolean"
    all_pieces = written(rows.mapInArrow(placed, schema), "pieces")
    leftovers = all_pieces.filter("NOT done").drop("done")
    whole = all_pieces.filter("done").drop("done")
    groups = leftovers.withColumn("merge", F.expr(f"sequence_id div {fan_in}"))
    return whole.unionByName(groups.groupBy("merge").applyInArrow(joined, _rows(kind)))


def encoder(path: str, pattern: str) -> CachedEncoder:
    """This worker's encoder for a vocabulary; its cache serves the tasks that follow."""

    def made() -> CachedEncoder:
        plain = ByteLevel(path, pattern)
        return CachedEncoder(plain, plain.added)

    return kept(("packing", path, pattern), made)


def _batch(rows: list[tuple], doc_type: pa.DataType, done: bool = True) -> pa.RecordBatch:
    kinds = [doc_type, *[pa.int64()] * 6, pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([done] * len(rows))], names=[*FIELDS, "done"])
