"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_U = np.uint64


def give_back(task: Callable) -> Callable:
    """A task on batches after which its worker, which waits for further ones, gives free memory back to the system."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_classes(separators: str) -> np.ndarray:
    keep = np.ones(256, bool)
    keep[list(separators.encode("latin-1"))] = False
    return keep


#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = _byte_classes(" \t\n\v\f\r")
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, which is looked for after lower-casing.
ALNUM = np.array([b >= 128 or chr(b).isdigit() or "a" <= chr(b).lower() <= "z" for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 65536), base, _U)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows): byte bounds of the words; words of text i are rows[i]:rows[i + 1]."""
    inside = keep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of data[start:end], by differences of a prefix sum of byte values times powers."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_P_INVERSE, n + 1)[starts] + (ends - starts).astype(_U))


def hash_words(words: list[str], keep: np.ndarray = ALNUM) -> np.ndarray:
    """The hashes that :func:`word_hashes` gives these words, one each."""
    data, offsets = text_bytes(pa.array(words, pa.large_string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the runs of ``width`` words of each text; a shorter text is one run of all its words."""
    n, have = len(words), np.diff(rows)
    count = np.where(have >= width, have - width + 1, np.minimum(have, 1))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(have)), count)
    at = rows[doc] + np.arange(out_rows[-1]) - out_rows[doc]
    length = np.minimum(have, width)[doc]
    h = length.astype(_U) * _U(0x9E3779B97F4A7C15)
    padded = np.concatenate([words, np.zeros(width, _U)])
    for k in range(width):
        step = (h ^ padded[at + k]) * _U(0xFF51AFD7ED558CCD)
        step ^= step >> _U(32)
        h = step if k == 0 else np.where(length > k, step, h)
    return mix(h), out_rows
