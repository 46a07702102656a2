"""Texts of an Arrow batch as pieces, each different piece once.

A piece begins at a space, or is a line feed; a comma or full stop between a letter and white space (or the text's end) is
a piece of its own. Work on pieces is then done once for each different one, and numbers take it to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut at once; a longer text is cut by itself.
SLICE = 4 << 20
SPACE, FEED, COMMA, STOP = b" \n,."


def as_strings(texts: pa.Array | list[str]) -> pa.Array:
    """Texts as an Arrow array of strings."""
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and where each starts and the last one ends."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def sliced(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Parts of an array of strings (without nulls) of so many bytes, or of one longer text."""
    if not len(texts):
        return
    _, edges = _bytes(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(edges, edges[start] + size, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


def cut(texts: pa.Array, odd: np.ndarray | None = None, own: Callable[[str], list[str]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different pieces; the number of each piece of the texts in a row; at which of these each text begins, and the last one ends.

    odd: texts that own() cuts instead.
    """
    raw, edges = _bytes(texts)
    feed = raw == FEED
    at = np.zeros(len(raw) + 1, bool)
    at[:-1] = (raw == SPACE) | feed
    at[edges] = True
    marks = np.flatnonzero((raw == COMMA) | (raw == STOP))
    marks = marks[at[marks + 1] & (marks > 1)]
    before, lead = raw[marks - 1], raw[marks - 2]
    letter = ((before | 32) >= 97) & ((before | 32) <= 122)
    # Two bytes of U+00C0 to U+023F: letters, but for the signs of multiplication and division.
    letter |= (before >= 128) & (before < 192) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    at[marks[letter]] = True
    at[1:] |= feed
    for k in np.flatnonzero(odd).tolist() if odd is not None else ():
        at[edges[k] + 1 : edges[k + 1]] = False
        at[edges[k] + np.cumsum([len(p.encode()) for p in own(texts[k].as_py())], dtype=np.int64)] = True
    bounds = np.flatnonzero(at)
    if len(bounds) < 2:
        return [], np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
    wide = len(raw) >= 1 << 31
    offsets = bounds.astype(np.int64 if wide else np.int32)
    kind = pa.large_string() if wide else pa.string()
    found = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64), np.searchsorted(bounds, edges)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers first, first + 1, ... (so many as size) of each, in a row."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
