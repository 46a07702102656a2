"""Encoding whole texts with a cache of words.

White space splits both public byte-level vocabularies' pre-tokens: none goes on from another character
into white space. So a text may be cut before a single space, and around a single line feed, and each
piece encoded by itself; texts of a batch are cut together, each different piece is looked up once, and a bounded cache
holds pieces' ids. Where white space runs on, the text is not cut, so that results equal those for the whole text.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.pieces import as_strings, cut, sliced

#: Pieces in either of the two generations that one worker remembers: those used since the last turn, and before.
CACHE = 200_000
#: Longer pieces are encoded each time.
LONGEST = 64
#: Letters below this one are letters to every version of Unicode.
LETTERS_TO = "\u0250"
#: One pre-token of letters below that.
WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: White space that doesn't stand alone within a text, or is no space or line feed (those that str.isspace() has, in RE2).
ODD = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class CachedEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, encoded() those of many; plain(list of pieces) gives them for each piece."""

    def __init__(self, plain: Callable[[list[str]], list[bytes]], added: dict[str, int] | None = None):
        """added: tokens that stand for themselves wherever they are in a text; the rest is encoded between them."""
        self.plain, self.known, self.older = plain, {}, {}
        self.added = {t: pack("<I", i) for t, i in (added or {}).items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        # No reference cycles are made here; frequent collections would only walk what the cache holds.
        gc.set_threshold(200_000, 50, 50)
        self.marks = dict(zip(",.", plain([",", "."])))

    def _pieces(self, text: str) -> list[str]:
        """Pieces that together are the text, cut only where no white space runs on."""
        pieces: list[str] = []
        for n, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            raw = [parts[0], *(" " + p for p in parts[1:])]
            if n:
                pieces.append("\n")
            pieces += raw
        joined: list[str] = []
        for p in pieces:
            # A cut is sound before a space or line feed that follows another kind of character, or after a lone line feed.
            if not p:
                continue
            lone = joined and joined[-1] == "\n" and not p[0].isspace()
            if joined and joined[-1][-1].isspace() and not lone:
                joined[-1] += p
            else:
                joined.append(p)
        return joined

    def encode(self, text: str) -> bytes:
        return next((ids.tobytes() for ids, _ in self.encoded(as_strings([text]))), b"")

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each slice of the texts: the ids in a row, and where each text's begin and the last one's end."""
        for part in sliced(texts):
            odd = pc.match_substring_regex(part, ODD)
            for token in self.added:
                odd = pc.or_(odd, pc.match_substring(part, token))
            spelled, piece, edges = cut(part, odd.to_numpy(zero_copy_only=False), self._own)
            ids = list(map(self.known.get, spelled))
            if None in ids:
                new = self._found([p for p, x in zip(spelled, ids) if x is None])
                ids = [new[p] if x is None else x for p, x in zip(spelled, ids)]
            _, offsets, data = pa.array(ids, pa.large_binary()).take(pa.array(piece)).buffers()
            ends = np.frombuffer(offsets, np.int64)[: len(piece) + 1] // 4 if len(piece) else np.zeros(1, np.int64)
            yield np.frombuffer(data or b"", "<u4")[: ends[-1]], ends[edges]

    def _own(self, text: str) -> list[str]:
        """Pieces of a text that isn't cut at every white space, or has added tokens."""
        if not any(token in text for token in self.added):
            return self._pieces(text)
        return [p for n, part in enumerate(self.apart.split(text)) for p in ([part] if n % 2 else self._pieces(part))]

    def _found(self, missing: list[str]) -> dict[str, bytes]:
        new, rest, known, older = {}, [], self.known, self.older
        for p in missing:
            ids = older.get(p) or self.added.get(p)
            # A letter and a mark are never one pre-token, so a known word's ids go on with the mark's.
            if ids is None and p[-1] in self.marks and len(p) > 1 and p[-2].isalpha() and p[-2] < LETTERS_TO:
                stem = known.get(p[:-1]) or older.get(p[:-1])
                ids = stem and stem + self.marks[p[-1]]
            if ids:
                new[p] = ids
            else:
                rest.append(p)
        new.update(zip(rest, self.plain(rest)))
        kept = {p: ids for p, ids in new.items() if len(p) <= LONGEST}
        if len(known) + len(kept) > CACHE:
            self.known, self.older = {}, known
        self.known.update(kept if len(kept) <= CACHE else {})
        return new


class ByteLevel:
    """plain() by a byte-level vocabulary of the library tokenizers: its pattern, then its merges on each pre-token.

    The library's own pipeline does the same with offsets, at several times the cost for short pieces.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.split, self.merges = regex.compile(pattern).findall, library.model.tokenize
        #: The vocabulary's added tokens, which the library takes out of a text first.
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        # The byte alphabet of these vocabularies: printable Latin-1 characters stand for themselves, the rest for U+0100 onwards.
        same = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in same else next(others) for b in range(256)}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        merges, split, alphabet, space, one = self.merges, self.split, self.alphabet, chr(self.alphabet[32]), WORD.fullmatch
        out = []
        for p in pieces:
            ids = []
            for word in (p,) if one(p) else split(p):
                plain = word.isascii() and word.isprintable()
                ids += [t.id for t in merges(word.replace(" ", space) if plain else word.encode().decode("latin-1").translate(alphabet))]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out
