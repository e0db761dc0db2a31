"""Draws of the cluster bootstrap in arrays: draw k of resample b in group g is
md5("b:k:g"), its first 32 bits modulo the group's number of clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Draws made at once: their arrays stay in a core's cache.
TILE = 32768
MASK = 0xFFFFFFFF
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [int(abs(math.sin(i + 1)) * 2**32) & MASK for i in range(64)]
TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]


def heads(words: list[int | np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """First 32 bits of the md5 of padded messages, given as little-endian words
    that are numbers or arrays; the last three steps do not touch these bits."""
    state = [np.full(shape, x, np.uint32) for x in START]
    f, left = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for at in range(0, len(words), 16):
        last = at + 16 == len(words)
        a, b, c, d = (x.copy() for x in state)
        for i in range(61 if last else 64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                w = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                w = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                w = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                w = 7 * i % 16
            word, more = words[at + w], ADDED[i]
            if isinstance(word, int):
                more = (more + word) & MASK
            else:
                np.add(f, word, out=f)
            np.add(f, a, out=f)
            np.add(f, np.uint32(more), out=f)
            np.left_shift(f, np.uint32(TURNS[i]), out=left)
            np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
            np.bitwise_or(f, left, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            return (state[0] + b).byteswap()
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    raise ValueError("no words")


def by_digits(first: int, end: int) -> Iterator[np.ndarray]:
    """The numbers of a range, those of one length together."""
    while first < end:
        top = min(end, 10 ** len(str(first)))
        yield np.arange(first, top, dtype=np.int64)
        first = top


def messages(bs: np.ndarray, ks: np.ndarray, group: str) -> list[int | np.ndarray]:
    """Words of the padded "b:k:group" for numbers of one length each: b in
    rows, k in columns."""
    nb, nk, tail = len(str(bs[0])), len(str(ks[0])), f":{group}".encode()
    size = nb + 1 + nk + len(tail)
    raw = (bytes(nb) + b":" + bytes(nk) + tail + b"\x80").ljust((size + 8) // 64 * 64 + 56, b"\0") + (8 * size).to_bytes(8, "little")
    words: list[int | np.ndarray] = [int(x) for x in np.frombuffer(raw, "<u4")]
    for numbers, n, at, axis in ((bs, nb, 0, (-1, 1)), (ks, nk, nb + 1, (1, -1))):
        for p in range(n):
            digit = (numbers // 10 ** (n - 1 - p) % 10 + 48).astype(np.uint32).reshape(axis)
            w, more = (at + p) // 4, digit << np.uint32(8 * ((at + p) % 4))
            words[w] = (np.uint32(words[w]) if isinstance(words[w], int) else words[w]) + more
    return words


def tiles(first: int, end: int, n: int, group: str, *more: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The resamples' numbers, and a row of drawn clusters for each of them;
    every draw of resamples first to end - 1 in one of the tiles.  A further
    array for each of more numbers of clusters, from the same digests."""
    for ks in by_digits(0, max(n, *more) if more else n):
        for at in range(0, len(ks), TILE):
            some = ks[at : at + TILE]
            step = max(1, TILE // len(some))
            for bs in by_digits(first, end):
                for b in range(0, len(bs), step):
                    few = bs[b : b + step]
                    found = heads(messages(few, some, group), (len(few), len(some)))
                    yield few, *(found[:, : max(0, x - some[0])] % np.uint32(x) for x in (n, *more))


def sums(first: int, end: int, group: str, tables: list[list[pa.Array]]) -> list[list[list[float | None]]]:
    """For each of the group's tables its columns' sums over the clusters that
    each resample draws; null values count for nothing, and a sum of nulls alone
    is null."""
    columns = [(t, x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False) if x.null_count else None) for t, own in enumerate(tables) for x in own]
    total, some = np.zeros((len(columns), end - first)), np.zeros((len(columns), end - first), bool)
    for bs, *drawn in tiles(first, end, len(tables[0][0]), group, *(len(x[0]) for x in tables[1:])):
        at = slice(bs[0] - first, bs[-1] - first + 1)
        for j, (t, v, k) in enumerate(columns):
            total[j, at] += v[drawn[t]].sum(axis=1)
            some[j, at] |= True if k is None else k[drawn[t]].any(axis=1)
    found = iter([[float(x) if y else None for x, y in zip(*of, strict=True)] for of in zip(total, some, strict=True)])
    return [[next(found) for _ in own] for own in tables]
