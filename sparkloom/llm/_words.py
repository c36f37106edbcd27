"""Words of texts and hashes of word sequences, computed over Arrow's buffers with numpy.

A batch of texts is one run of bytes; nothing here loops over words or texts in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finisher of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' byte bounds; words first[i]:first[i + 1] are those of text i."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[cuts] |= inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...], lower: bool) -> list[np.ndarray]:
    """For each seed a 64-bit hash of each word's bytes; A to Z count as a to z where lower is set."""
    out = [np.empty(len(starts), U) for _ in seeds]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK)))
        low = int(starts[a])
        letters = data[low : int(ends[b - 1])]
        if lower:
            letters = LOWER[letters]
        for seed, to in zip(seeds, out, strict=True):
            to[a:b] = Rolling(_stream(seed, 256)[letters], seed ^ 0x5DEECE66D).at(starts[a:b] - low, ends[a:b] - starts[a:b])
        a = b
    return out


class Rolling:
    """Hashes of n consecutive words (or any numbers) at every place, from running sums modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, seed: int):
        with np.errstate(over="ignore"):
            base = int(_stream(seed, 1)[0]) & (2**64 - 8) | 5
            n = len(values)
            self.seed, self.base = seed, base
            self.inverse = _powers(pow(base, -1, 2**64), n + 1)
            self.sums = np.zeros(n + 1, U)
            np.cumsum(values * _powers(base, n), out=self.sums[1:])

    def at(self, starts: np.ndarray, n) -> np.ndarray:
        """The hashes of the n words from each of the starts; n can be a number for each."""
        with np.errstate(over="ignore"):
            length = np.asarray(n).astype(U) if isinstance(n, np.ndarray) else U(n)
            return _mix((self.sums[starts + n] - self.sums[starts]) * self.inverse[starts] + length * U(0x9E3779B97F4A7C15))


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _kept.get(base)
    if found is None or len(found) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        found = np.ones(size, U)
        with np.errstate(over="ignore"):
            found[1:] = U(base)
            np.cumprod(found, out=found)
        _kept.clear() if len(_kept) > 8 else None
        _kept[base] = found
    return found[:n]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of values[i:i + width] for each i to len - width, from runs within blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
