"""Vectorised word scanning of Arrow string batches (runs inside Spark tasks; Spark partitions the rows).

Words are ``[^\\x20\\x09-\\x0D]+``: maximal runs of bytes that are not ASCII white space (UTF-8 continuation bytes never
are). Everything works on the batch's byte buffer at once, so the cost per byte is a handful of numpy operations and
memory is bounded by ``SLICE_BYTES`` (or by one text, if a single text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # small enough for the arrays of a slice to stay near the processor

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective): spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n (odd base); grown by doubling and kept per process."""
    have = _BASES.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _BASES[base] = have = tuple(both)
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of every ``values[start:end]`` (uint64) from one prefix sum of ``values[i] * base**i``."""
    n = len(values)
    power, inverse = _powers(base, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of consecutive texts: ``data[start[i]:end[i]]`` is word i, ``row[i]`` its text's index in the slice,
    and text r owns words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        return span_hashes(_BYTE[self.data], self.start, self.end, base)

    def windows(self, hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``width`` consecutive words of one text."""
        last = self.first[1:][self.row] - width  # of the word's text: the last start
        at = np.flatnonzero(np.arange(len(self.row)) <= last)
        return at, span_hashes(hashes, at, at + width, base)


def scan(texts: pa.Array, lower: bool = False) -> Words:
    """Words of an Arrow string array; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[:1], after[-1:] = True, True
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    row = np.searchsorted(offsets[1:], start, side="right")
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(texts)), out=first[1:])
    return Words(data, start, end, row, first)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece holds at most ``limit`` bytes of ``column`` (or a single longer text)."""
    texts = batch.column(column)
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)) if len(texts) else []
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def batches(frames: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield from slices(frame, column, limit)
