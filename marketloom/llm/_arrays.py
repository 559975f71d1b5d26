"""Vectorised text helpers used inside Arrow tasks: byte views, word bounds, 64-bit word and shingle hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_CODES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_EXACT, _CODES = _CODES, _CODES[_LOWER]  # the second: A-Z count as a-z
_POWERS: dict[str, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system: a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of a text column; a longer row comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield b.slice(at, to - at)
            at = to
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the given inclusive ranges."""
    out = np.ones(256, bool)
    for a, b in excluded:
        out[a:b + 1] = False
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and per row the index of its first word (with one more at the end)."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if n > len(_POWERS.get(name, ())):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if n > 2 * SLICE_BYTES:  # a single giant word: not kept
            return p
        _POWERS[name] = p
    return _POWERS[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words in text order, from running polynomial sums; fold: A-Z count as a-z."""
    codes = _CODES if fold else _EXACT
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
        part = data[low:ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * _power("up", _MULT, len(part)), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power("down", _INV, len(part))[s]
        at = to
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions without n words after them are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, k = np.zeros(m, np.uint64), np.uint64(1)
    for i in range(n):
        out += words[i:i + m] * k
        k = np.uint64(int(k) * int(_GRAM) & (1 << 64) - 1)
    return mix(out + np.uint64(n))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def bitmap(keys: np.ndarray, bits: int = 20) -> np.ndarray:
    """Which high-bit prefixes occur among the keys; a small filter before an exact search."""
    out = np.zeros(1 << bits, bool)
    out[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def find(keys: np.ndarray, ordered: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys that occur in an ordered array, and where they are there."""
    bits = np.uint64(64 - (len(seen).bit_length() - 1))
    maybe = np.flatnonzero(seen[(keys >> bits).astype(np.int64)])
    at = np.minimum(np.searchsorted(ordered, keys[maybe]), max(len(ordered) - 1, 0))
    same = ordered[at] == keys[maybe] if len(ordered) else np.zeros(len(maybe), bool)
    return maybe[same], at[same]
