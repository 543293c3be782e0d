"""Word hashes from the JVM, and sorted 64-bit hashes as compact blobs, so that postings shuffle at a few bytes each instead of a row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words.
SPACE = r"[ \t\n\r\f]+"


def hashed_words(text: Column) -> Column:
    """The hashes of the text's lower-cased words, in order; an empty array for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds (one more than rows) of a list column without nulls."""
    bounds = column.offsets.to_numpy()
    flat = column.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy()
    return flat, bounds.astype(np.int64) - bounds[0]


def runs(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of rows of about so many values in all; a row is never cut."""
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, to
        at = to


def planes(a: np.ndarray) -> bytes:
    """Byte planes: those of small numbers are zero, and compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(a: np.ndarray) -> bytes:
    """Of ascending uint64."""
    return planes(np.diff(a, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def squeezed(b: bytes) -> bytes:
    """Entropy-coded, with its length in front."""
    return len(b).to_bytes(6, "little") + (pa.compress(b, codec="zstd", asbytes=True) if b else b"")


def unsqueezed(b: bytes) -> bytes:
    size = int.from_bytes(b[:6], "little")
    return pa.decompress(b[6:], size, codec="zstd", asbytes=True) if size else b""


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; the last n - 1 places have none."""
    if len(words) < n:
        return words[:0]
    g = mixed(words[: len(words) - n + 1])
    for k in range(1, n):
        g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return g


def parts(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits ranges of hashes."""
    if not bits:
        return np.array([0, len(sorted_hashes)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def bits_for(total: float, each: float) -> int:
    """So many bits that 2**bits ranges hold about so many of the total each."""
    return max(0, int(np.ceil(np.log2(max(total, 1) / each))))
