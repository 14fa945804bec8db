"""Words of whole Arrow string columns and their 64-bit hashes, computed on the byte buffers with NumPy."""

from __future__ import annotations

import ctypes
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.caches import Cache

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPAN = 1 << 20  # bytes hashed at a time
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[int, np.ndarray] = Cache()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(of: np.uint64, n: int) -> np.ndarray:
    key = int(of)
    if key not in _powers or len(_powers[key]) < n:
        got = np.full(n, of, U)
        got[0] = 1
        got = np.cumprod(got, dtype=U)
        if n > SPAN + 1:
            return got
        _powers[key] = got
    return _powers[key]


@dataclass
class Scan:
    """Words of a batch in order: the row, the byte span and the hash of each."""

    data: np.ndarray
    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each row's words begin; one more entry than rows."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


@functools.cache
def frugal() -> None:
    """Have the C library give freed arrays back to the system at once instead of keeping them for the worker's next
    task. Fixed values: glibc's numbers of the thresholds for mapped chunks and for trimming."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 20)
        mallopt(-1, 1 << 20)


def pieces(column: pa.Array, size: int = 1 << 20):
    """Runs of rows of about ``size`` bytes: (first row, slice)."""
    frugal()
    pa.default_memory_pool().release_unused()
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def scan(column: pa.Array, fold: bool = False, apart: np.ndarray = WHITE) -> Scan:
    """``fold`` lower-cases A-Z in the hash; ``apart`` marks the bytes that belong to no word."""
    data, ends = raw(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Scan(data, len(column), none, none, none, np.zeros(0, U))
    off = apart[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = off[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = off[1:]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    before[inner] = True
    after[inner - 1] = True
    start, end = np.flatnonzero(~off & before), np.flatnonzero(~off & after) + 1
    row = np.searchsorted(ends, start, side="right") - 1
    return Scan(data, len(column), row, start, end, spans(FOLD[data] if fold else data, start, end))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, side="right")))
        lo, hi = start[at], end[to - 1]
        s, e = start[at:to] - lo, end[at:to] - lo
        part = (data[lo:hi].astype(U) + U(1)) * powers(BASE, max(int(hi - lo), SPAN + 1))[: hi - lo]
        edges = np.empty(2 * len(s), np.int64)
        edges[0::2], edges[1::2] = s, e
        total = np.add.reduceat(part, edges[:-1])[0::2]
        h = total * powers(INVERSE, max(int(s[-1]) + 1, SPAN + 1))[s]
        out[at:to] = mix(h ^ ((e - s).astype(U) * U(0x9FB21C651E98DF25)))
        at = to
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two sequences one after the other."""
    return mix(a * U(0x9E3779B97F4A7C15) + (b ^ U(0xD6E8FEB86659FD93)))


def windows(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``n`` words from each position on, by doubling, and which positions have so many in their row."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    have, length, power, width = None, 0, words, 1
    while True:
        if n & width:
            have = power if have is None else joined(have[: len(have) - width], power[length : length + len(have) - width])
            length += width
        if width * 2 > n:
            return have, row[n - 1 :] == row[:size]
        power = joined(power[: len(power) - width], power[width:])
        width *= 2


def least(x: np.ndarray, n: int, most: bool = False) -> np.ndarray:
    """The least (or greatest) of the ``n`` values from each position on."""
    pick, got, width = np.maximum if most else np.minimum, x, 1
    while width * 2 <= n:
        got = pick(got[: len(got) - width], got[width:])
        width *= 2
    return got if width == n else pick(got[: len(got) - (n - width)], got[n - width :])


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
