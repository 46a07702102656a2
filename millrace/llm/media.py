"""Media columns: losslessly compressed images kept in binary columns, read back with checks.

Writing: an 8-bit grey image, IMAGE_WIDTH samples a row, becomes a PNG: signature, IHDR, one IDAT (a zlib
stream of each row's filter type and filtered samples), IEND, each chunk with its CRC-32. A row's type is the one of least absolute
differences; for prose that costs some bytes against type 0 throughout. Reading: chunks are walked
and their checksums tested, the zlib stream is inflated (its Adler-32 is tested too), and rows are
unfiltered with numpy for all five filter types, many images at once: a sample needs those left of it and above, so all
that lie on one diagonal of their images are done in one step. The perceptual hash is the signs of the lowest
HASH_SIDE x HASH_SIDE cosine-transform coefficients of the image, against their median.

Defined results: a null text is an empty one; an empty payload is padded to 64 zero bytes; equal texts have
equal bytes and hashes; a damaged image raises ValueError when read. Null media stays null with null
features. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import whole_text

IMAGE_WIDTH = 64
LEVEL = 3
HASH_SIDE = 8
#: Rows of an image up to which its cosines are kept (32 kB each).
SHORT = 512
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples to the left, above, and above to the left; 0 beyond the image."""
    padded = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1), np.int16)
    padded[1:, 1:] = rows
    return padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + up - corner; in ties left, then up."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Lines of a PNG: each row's filter type (that of the least sum of absolute differences, in ties the smaller), then its differences."""
    left, up, corner = _neighbours(rows)
    guesses = (0, left, up, (left + up) >> 1, _nearest(left, up, corner))
    coded = np.stack([(rows - g).astype(np.uint8) for g in guesses])
    kind = np.abs(coded.view(np.int8).astype(np.int16)).sum(2, dtype=np.int32).argmin(0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, coded[kind, np.arange(len(rows))]
    return lines


def encode_png(samples: bytes, width: int = IMAGE_WIDTH) -> bytes:
    """A grey 8-bit PNG of whole rows of samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered(rows).tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfiltered(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images of one width, given as filtered lines (filter type first) of one byte a sample."""
    sizes = np.array([len(x) for x in images])
    lines = np.concatenate(images)
    if lines[:, 0].max(initial=0) > 4:
        raise ValueError(f"filter type {lines[:, 0].max()}")
    n, width = len(lines), lines.shape[1] - 1
    y = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(y, kind="stable")  # rows of one height stand together, so those of a diagonal do
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    above = np.where(y[order] == 0, n, place[order - 1])  # row n is empty
    y, kind, coded = y[order], lines[order, 0], lines[order, 1:]
    out = np.zeros((n + 1, width + 1), np.int16)
    heights = np.searchsorted(y, np.arange(y[-1] + 2 if n else 1))
    for d in range(int(y[-1]) + width if n else 0):
        a, b = heights[max(0, d - width + 1)], heights[min(d + 1, len(heights) - 1)]
        row, x, up = np.arange(a, b), d - y[a:b], above[a:b]
        left, upper, corner = out[row, x], out[up, x + 1], out[up, x]
        guess = np.choose(kind[a:b], (0, left, upper, (left + upper) >> 1, _nearest(left, upper, corner)))
        out[row, x + 1] = (coded[row, x] + guess) & 255
    whole = out[place, 1:].astype(np.uint8)
    return np.split(whole, np.cumsum(sizes)[:-1])


def inflated(data: bytes) -> np.ndarray:
    """Filtered lines (height, 1 + width) of a grey 8-bit PNG; ValueError if a check fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not grey with 8 bits")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or shape is None:
        raise ValueError("IHDR or IEND is missing")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != shape[0] * (shape[1] + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1)


def decoded(data: list[bytes]) -> list[np.ndarray]:
    """Samples (height, width) of grey 8-bit PNGs."""
    lines = [inflated(x) for x in data]
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(lines)
    for width in {x.shape[1] for x in lines}:
        at = [i for i, x in enumerate(lines) if x.shape[1] == width]
        for i, image in zip(at, unfiltered([lines[i] for i in at])):
            out[i] = image
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width) of a grey 8-bit PNG; ValueError if a check fails."""
    return decoded([data])[0]


def _cosines(n: int) -> np.ndarray:
    """The lowest HASH_SIDE rows of the orthogonal cosine transform of n samples (zeros beyond n); kept if they are short."""
    return _short_cosines(n) if n <= SHORT else _all_cosines(n)


@lru_cache(maxsize=1024)
def _short_cosines(n: int) -> np.ndarray:
    return _all_cosines(n)


def _all_cosines(n: int) -> np.ndarray:
    k, x = np.arange(HASH_SIDE)[:, None], np.arange(n)[None, :]
    rows = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, (1 / n) ** 0.5, (2 / n) ** 0.5)
    return rows * (k < n)


def low_frequency_hash(image: np.ndarray) -> bytes:
    """One bit per low-frequency coefficient but the first (the mean): above their median or not."""
    height, width = image.shape
    low = np.round(_cosines(height) @ image.astype(np.float64) @ _cosines(width).T, 6).ravel()
    return np.packbits(np.concatenate([[False], low[1:] > np.median(low[1:])])).tobytes()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary): the text's UTF-8 bytes, zero-padded to a positive multiple of the width, as PNG."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 1):
                data = part.column(1).to_pylist()
                images = [encode_png(x + bytes(-len(x) % IMAGE_WIDTH or IMAGE_WIDTH * (not x))) for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(encoded, f"doc_id {rows.dtypes[0][1]}, n_bytes long, media binary")


def _parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes in that column, so that few long values don't add up."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep, media, payload (binary, read back from media) and feature (binary, the perceptual hash)."""
    rows = media.select(*keep, "media")
    at = len(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, at):
                stored = part.column(at).to_pylist()
                read_back = iter(decoded([x for x in stored if x is not None]))
                images = [None if x is None else next(read_back) for x in stored]
                payload = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
                hashes = pa.array([None if x is None else low_frequency_hash(x) for x in images], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, payload, hashes], names=[*part.schema.names, "payload", "feature"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(read, f"{kinds}, payload binary, feature binary")
