"""Rolling hashes over the bytes of a whole Arrow string column, vectorised with numpy.

A prefix sum of table-mapped bytes times powers of an odd base (modulo 2**64) gives the hash of any substring with one
subtraction and one multiplication; equal substrings have equal hashes wherever they stand.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... (n values at least), kept between calls."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = -(-n // (1 << 18)) << 18
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def tidy() -> None:
    """Gives memory that a task has freed back to the system; a worker stays and its next task may be of another kind."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the mapped bytes; one more than there are bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(TABLE[data] * _powers("base", BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _powers("inverse", INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def grams(sums: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-byte strings, by start."""
    n = len(sums) - q
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[q:] - sums[:n]) * _powers("inverse", INVERSE, len(sums))[:n] + np.uint64(q))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows, without a copy where Arrow allows it."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges (first, last) of at most `most` bytes, or of one row that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of bytes other than space and 0x09-0x0D inside one row."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
