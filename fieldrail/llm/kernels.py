"""Vectorised text kernels shared by the corpus operators.

They work on the buffers of one Arrow batch: word spans, word hashes, hashes of
n consecutive words.  Words are runs of bytes outside ``\\x20\\x09-\\x0D``.  Every
function takes whole texts; memory is a small multiple of the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
INK = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The five primes of XXH64.
XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)

#: Spans longer than this are hashed by BLAKE2b, one by one.
LONG = 256
_FIRST = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
_FIRST = np.append(_FIRST, ~np.uint64(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(name: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(name * 0x1000003))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def groups(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of texts; text i has words first[i]:first[i + 1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[buf]
    edge = ink.copy()
    edge[1:] &= ~ink[:-1]
    begin = offsets[:-1][offsets[:-1] < len(buf)]
    edge[begin] = ink[begin]
    starts = np.flatnonzero(edge)
    edge = ink.copy()
    edge[:-1] &= ~ink[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    edge[last] = ink[last]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans.

    Eight bytes at a time go through the finaliser, which isn't linear, after the length; spans
    of equal length up to eight bytes never collide.  A lane is a key of its own.
    """
    size = ends - starts
    eights = _eights(buf)
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + seeds(20, lane + 1)[lane])
    out = mix(out ^ (eights[starts] & _FIRST[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(live):
        at = starts[live] + done
        out[live] = mix(out[live] ^ (eights[at] & _FIRST[np.minimum(ends[live] - at, 8)]))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([lane]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span at its place in ``other``."""
    size = ends - starts
    if not np.array_equal(size, size[other]):
        return False
    eights = _eights(buf)
    live, done = np.arange(len(starts)), 0
    while len(live):
        a, b = starts[live] + done, starts[other[live]] + done
        if ((eights[a] ^ eights[b]) & _FIRST[np.minimum(ends[live] - a, 8)]).any():
            return False
        done += 8
        live = live[(size[live] > done) & (size[live] <= LONG)]
    raw = [(i, int(other[i])) for i in np.flatnonzero(size > LONG).tolist()]
    return all(np.array_equal(buf[starts[i] : ends[i]], buf[starts[j] : ends[j]]) for i, j in raw)


def spark_hashes(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """xxhash64 of longs, as Spark's function gives it."""
    p1, p2, p3, p4, p5 = (U64(int(p)) for p in XX)

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << U64(n)) | (x >> U64(64 - n))

    out = turned(values.astype(np.int64).view(U64) * p2, 31) * p1
    out ^= U64(seed) + p5 + U64(8)
    out = turned(out, 27) * p1 + p4
    out ^= out >> U64(33)
    out *= p2
    out ^= out >> U64(29)
    out *= p3
    return (out ^ (out >> U64(32))).view(np.int64)


def gram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of every n consecutive word hashes (over all texts; see inside())."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    factors = seeds(100 + lane, n) | U64(1)
    out = words[:m] * factors[0]
    for j in range(1, n):
        out += words[j : m + j] * factors[j]
    return mix(out)


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, text) of the n-grams that lie inside one text."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return at, text[at]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
