"""Byte-level BPE from a rank file, in linear time.

Tokens' bytes are mapped to Latin-1 characters, so that one automaton (pyahocorasick) finds every token
that starts at each byte of a pre-token. The longest is tried first; it may follow the token before it
only if merging their bytes by rank would leave exactly the two (a fact of the pair, memoised). Where no token
may follow, that place is dead and the search goes back to the next shorter token of the one before. A
prefix has one encoding only, so no place is tried twice, and the result is the one that merging by rank gives.

Whether two neighbours are left alone: the pieces at their border are, over the merging's course, the
last parts of the left token and the first parts of the right one; a merge across the border happens if a
pair of these is itself a token whose rank comes up while both are there.

Defined results: a null or empty text has no ids; decoding null gives empty bytes; repeated rows and null ids are
carried; an empty table gives no rows. Only id and text (or ids) are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import trim, whole_text
from millrace.llm.tokens import WORD, CachedEncoder

NEVER = 1 << 40
#: Pairs whose compatibility one worker remembers; beyond, it starts anew.
PAIRS = 300_000
#: Pieces that go through the automaton at once.
TOGETHER = 1 << 15
#: Ids of one batch of rows.
IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens, how each came to be, and the automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.bytes = ranks, {r: t for t, r in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        #: (token, rank of the merge that takes it up) from the whole token inwards, at its left and its right end.
        self.heads: dict[int, list[tuple[int, int]]] = {}
        self.tails: dict[int, list[tuple[int, int]]] = {}
        #: Length of each token that merging makes, and the longest such token that it starts with.
        self.size: dict[int, int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(token, rank)
            if halves is None:
                continue  # merging never makes it; it stands only for a whole pre-token
            left, right = halves or (None, None)
            self.heads[rank] = [(rank, NEVER)] + [(t, rank if up == NEVER else up) for t, up in self.heads.get(left, [])]
            self.tails[rank] = [(rank, NEVER)] + [(t, rank if up == NEVER else up) for t, up in self.tails.get(right, [])]
            if halves:
                self.pair[halves] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.size[rank] = len(token)
        for rank, size in self.size.items():
            token = self.bytes[rank]
            self.shorter[rank] = next((p for k in range(size - 1, 0, -1) if (p := ranks.get(token[:k])) in self.size), None)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, ...] | None:
        """The two tokens that the last merge joins; () for a byte; None if lower ranks don't leave two."""
        if len(token) == 1:
            return ()
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return tuple(self.ranks[p] for p in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves them as they are."""
        known = self.compatible.get(left << 32 | right)
        if known is None:
            known = not any(
                (across := self.pair.get((a, b))) is not None and across < a_up and across <= b_up
                for a, a_up in self.tails[left]
                for b, b_up in self.heads[right]
            )
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[left << 32 | right] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        text = word.decode("latin-1")
        # Where the longest matches in a row all fit, the search would not go back once.
        longest = [token for _, token in self.automaton.iter_long(text)]
        n = next((n for n, pair in enumerate(zip(longest, longest[1:]), 1) if not self.fits(*pair)), len(longest))
        return longest if n == len(longest) else self._searched(word, text, longest[:n], longest[n])

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of many: the ids in a row, and where each word's begin and the last one's end. The automaton runs over all, each different pair is tried once."""
        whole = list(map(self.ranks.get, words))
        texts = [word.decode("latin-1") if rank is None else "" for word, rank in zip(words, whole)]
        size = np.array(list(map(len, texts)), np.int64)
        # No token has the character between words.
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long("\u0100".join(texts))), np.int64).reshape(-1, 2)
        token, word = found[:, 1], np.searchsorted(np.cumsum(size + 1), found[:, 0], "right")
        codes, which = np.unique(token[:-1] << 32 | token[1:], return_inverse=True)
        within, fit = word[:-1] == word[1:], np.ones(len(codes), bool)
        used = np.unique(which[within])
        fit[used] = [self.fits(code >> 32, code & 0xFFFFFFFF) for code in codes[used].tolist()]
        bad = np.flatnonzero(within & ~fit[which])
        again, at = np.unique(word[bad], return_index=True)
        start = np.searchsorted(word, again)
        searched = [self._searched(words[k], texts[k], token[a : b + 1].tolist(), c) for k, a, b, c in zip(again.tolist(), start.tolist(), bad[at].tolist(), token[bad[at] + 1].tolist())]
        told = np.array([k for k, rank in enumerate(whole) if rank is not None], np.int64)
        keep = ~np.isin(word, again)
        ids = np.concatenate([token[keep], np.array([whole[k] for k in told.tolist()], np.int64), np.array([*chain.from_iterable(searched)], np.int64)])
        of = np.concatenate([word[keep], told, np.repeat(again, list(map(len, searched)))])
        return ids[np.argsort(of, kind="stable")].astype("<u4"), np.append(0, np.cumsum(np.bincount(of, minlength=len(words))))

    def _searched(self, word: bytes, text: str, path: list[int], token: int | None) -> list[int]:
        """The search with steps back, gone on with from the longest matches so far (path) and the next one (token), which doesn't fit."""
        shorter, size, fits, long = self.shorter, self.size, self.fits, self.automaton.iter_long
        dead, at, n = bytearray(len(word) + 1), sum(size[t] for t in path), len(word)
        while at < n:
            while token is not None and (dead[at + size[token]] or path and not fits(path[-1], token)):
                token = shorter[token]
            if token is None:  # nothing may go on from here
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                token = shorter[token]
            else:
                path.append(token)
                at += size[token]
                if at < n:
                    token = next(long(text, at))[1]
        return path


class RankFile:
    """plain() of a CachedEncoder by a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split, self.vocabulary = regex.compile(pattern).findall, Vocabulary(read_ranks(path))

    def __call__(self, pieces: list[str]) -> list[bytes]:
        out, split, one = [], self.split, WORD.fullmatch
        for start in range(0, len(pieces), TOGETHER):
            words = [[p] if one(p) else split(p) for p in pieces[start : start + TOGETHER]]
            ids, ends = self.vocabulary.encode_all([w.encode() for some in words for w in some])
            data, ends = ids.tobytes(), (4 * ends[np.cumsum([0, *map(len, words)])]).tolist()
            out += [data[a:b] for a, b in zip(ends, ends[1:])]
        return out


_ENCODERS: dict[tuple[str, str], CachedEncoder] = {}
_TOKENS: dict[str, pa.Array] = {}


def encoder(path: str, pattern: str) -> CachedEncoder:
    """This worker's encoder for a rank file; its cache serves all tasks that follow."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = CachedEncoder(RankFile(path, pattern))
    return _ENCODERS[path, pattern]


def _runs(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) row of runs of IDS ids at most, or of one longer row."""
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + IDS, "right")) - 1)
        yield first, last
        first = last


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row. ranks: path of the rank file, readable on every executor."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encoded
        for b in batches:
            start = 0
            for ids, edges in encode(b.column(1)):
                for first, last in _runs(edges):
                    own = ids[edges[first] : edges[last]].view("<i4")
                    lists = pa.ListArray.from_arrays(pa.array((edges[first : last + 1] - edges[first]).astype(np.int32)), pa.array(own))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start + first, last - first), lists], names=["doc_id", "ids"])
                start += len(edges) - 1
            trim()

    return rows.mapInArrow(made, f"doc_id {rows.dtypes[0][1]}, ids array<int>")


def decoded(rows: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and data (binary): the bytes that the ids stand for."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _TOKENS:
            token = {r: t for t, r in read_ranks(ranks).items()}
            _TOKENS[ranks] = pa.array([token.get(r) for r in range(max(token) + 1)], pa.large_binary())
        token = _TOKENS[ranks]
        for b in batches:
            # Null lists have no ids.
            edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)))
            for first, last in _runs(edges):
                part = b.slice(first, last - first)
                taken = token.take(part.column(1).flatten())
                if taken.null_count:
                    raise ValueError("an id that the rank file doesn't have")
                _, offsets, data = taken.buffers()
                size = edges[first : last + 1] - edges[first]
                ends = np.frombuffer(offsets, np.int64)[: len(taken) + 1][size] if len(taken) else size
                texts = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(ends)), data or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.binary())], names=["doc_id", "ids", "data"])
            trim()

    return rows.mapInArrow(made, f"doc_id {rows.dtypes[0][1]}, ids array<int>, data binary")
