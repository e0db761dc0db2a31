"""Vectorised text primitives on Arrow buffers.

A batch of texts is one byte buffer plus offsets; words, hashes and windows are
arrays over that buffer, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words are runs of bytes other than ASCII blank, tab, LF, VT, FF and CR.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
BASE_INV = pow(BASE, -1, 1 << 64)


def slices(batches, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of
    ``column`` (one row at least, so a longer text comes alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size.astype(np.int64))
        at = 0
        while at < n:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def lean(f):
    """``f``, a function over record batches, that gives the memory it no longer
    uses back to the system at its end: Python workers live on, and several
    wait beside each other on an executor."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    raw = wide.buffers()
    off = np.frombuffer(raw[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (with a
    last entry for the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~blank[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (shifts and odd products)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Powers that a worker keeps; longer texts make their own for the time being.
KEPT = (1 << 20) + 8


def _powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, U64(base))
    x[0] = 1
    return np.multiply.accumulate(x)


@lru_cache(maxsize=2)
def _kept(base: int) -> np.ndarray:
    return _powers(KEPT, base)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    return _kept(base)[:n] if n <= KEPT else _powers(n, base)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum of (byte+1)*BASE**k over i<=k<j."""
    out = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span that depends on its content only."""
    return mix((h[ends] - h[starts]) * powers(len(h), BASE_INV)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive entries, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense exact ranks of the rows made of the given integer columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


@lru_cache(maxsize=8)
def probe_table(bins: int, tries: int) -> np.ndarray:
    """probe_table[t, i]: where empty bin i looks at its t-th try."""
    t = np.arange(1, tries + 1, dtype=U64)[:, None] * U64(0xA0761D6478BD642F)
    return (mix(t + mix(np.arange(bins, dtype=U64))[None, :]) % U64(bins)).astype(np.int32)
