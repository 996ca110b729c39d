"""Words of Arrow text columns as numpy arrays: positions, 64-bit hashes and n-gram hashes.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, all of them
ASCII, so cutting UTF-8 bytes cuts characters nowhere.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the polynomial hashes, which wrap at 2**64.
_BYTE_BASE, _GRAM_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        got = (out[0], out[1])
        if size <= 8 * CHUNK_BYTES:
            _POWERS[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Words of the rows ``first`` to ``first + rows - 1`` of an array, in order."""

    first: int
    rows: int
    #: Row r (from 0) has the bytes data[offsets[r]:offsets[r + 1]] and the words bounds[r] to bounds[r + 1] - 1; word i is data[start[i]:end[i]].
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int64), np.diff(self.bounds))

    def grams(self, n: int, base: int = _GRAM_BASE) -> np.ndarray:
        """The hash of the n words from each word on; those that run past their row's end are meaningless."""
        return gram_hashes(self.hashes, n, base)

    def second_grams(self, n: int) -> np.ndarray:
        return gram_hashes(self.hashes, n, _SECOND_BASE)

    def inside(self, n: int) -> np.ndarray:
        """Of each gram start: does the gram lie in one row?"""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=bool)
        rows = self.row_of_word()
        return rows[:count] == rows[n - 1 :]


def gram_hashes(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of a string array (null: no words), about ``size`` bytes at a time."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield _chunk(raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first], first)
        first = last


def _chunk(data: np.ndarray, offs: np.ndarray, first: int) -> Chunk:
    rows = len(offs) - 1
    word = ~_SPACE[data]
    begins, closes = word.copy(), word.copy()
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    closes[:-1] &= ~word[1:]
    closes[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(closes) + 1
    bounds = np.searchsorted(start, offs)
    up, down = powers(_BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return Chunk(first, rows, data, offs, start, end, bounds.astype(np.int64), hashes)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``function`` over a partition's batches, after which the worker gives unused memory back: it may idle beside other stages for long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
