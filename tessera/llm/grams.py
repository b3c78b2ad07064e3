"""Words, runs of words and their signatures, worked out for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a worker, save for single texts that are longer.
CHUNK = 1 << 20

_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15 | 1), _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all of them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(max(n, CHUNK), base, _U)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=_U)
    return _powers


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in `data`, up to `ends`, and the text of each word.

    Words are the longest stretches of ASCII letters, digits and underscores, in lower case.
    """
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    edge[0] = edge[n] = True
    first = inside & (~np.concatenate(([False], inside[:-1])) | edge[:n])
    last = inside & (~np.concatenate((inside[1:], [False])) | edge[1:])
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[:n], dtype=_U)))
    hashed = mix((sums[stops] - sums[starts]) * inverse[starts])
    return hashed, np.searchsorted(ends, starts, side="right")


def runs(hashed: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that lie within one text, and which words begin them."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashed[j : j + n]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(out[at]), at


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of stretches of texts; a null text is empty. No text is copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield at, raw[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
        at = to


def gram_sets(texts: pa.Array, k: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 32-bit hashes of its runs of k words) of every text."""
    for at, data, ends in chunks(texts):
        hashed, text = words(data, ends)
        grams, first = runs(hashed, text, k)
        key = np.unique((text[first].astype(_U) << _U(32)) | (grams >> _U(32)))
        bounds = np.searchsorted(key, np.arange(len(ends) + 1, dtype=_U) << _U(32))
        low = (key & _U(0xFFFFFFFF)).astype(np.uint32)
        for i in range(len(ends)):
            yield at + i, low[bounds[i] : bounds[i + 1]]


def signatures(values: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Min-hashes of sets: values[bounds[i]:bounds[i+1]] are set i, none of them empty; a row per set, a column per seed."""
    out = np.empty((len(seeds), len(bounds) - 1), np.uint32)
    x = values.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    for j, (a, b) in enumerate(seeds):
        v = x * a + b
        v = (v ^ (v >> np.uint32(13))) * np.uint32(0x846CA68B)
        out[j] = np.minimum.reduceat(v, bounds[:-1])
    return np.ascontiguousarray(out.T)


def seeds(n: int) -> np.ndarray:
    """Fixed seeds of n hash functions."""
    r = np.random.default_rng(20260101).integers(0, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32)
    r[:, 0] |= np.uint32(1)
    return r


def jaccard(a: bytes, b: bytes) -> float:
    """Shared over all values of two sets of sorted 32-bit values."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0
