"""Suffix-array dedup over bytes by deep-shallow sorting.

A text is its UTF-8 bytes; matches never cross texts.  Every byte covered by a
``WINDOW``-byte string that also starts earlier (smaller id, or same text and
earlier start) is removed; overlaps count, strings are judged on the input.

Candidate stretches meet in buckets (see ``_windows``, where equal stretches
are found to be one by their bytes; buckets with several go on).  A bucket's
suffixes are sorted deep-shallow: multikey quicksort whose characters are 8
bytes wide, three-way partitions of all groups at once, down to ``SHALLOW``
bytes; then a blind trie orders each group whose common prefix is longer,
comparing a suffix with one leaf only.  Sorting stops at ``WINDOW`` bytes:
suffixes that agree so far stand together as one class, whose earliest member
stays.

Null text is empty.  A null id comes last.  Repeated rows of one id and text
are one text (no copies of each other).  Texts under ``WINDOW`` bytes lose
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._windows import Scheme, covered, gaps, repeated_windows

WINDOW, GRAM = 100, 40
SHALLOW = 32


def _grams(gram: int):
    def run(data, off):
        n = len(data) - gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64), off
        h = A.prefix_hash(data)
        return A.mix((h[gram:] - h[:-gram]) * A.powers(n, A.BASE_INV)), off

    return run


class BlindTrie:
    """A trie that stores branching depths only; ``add`` returns the class of
    a key, the keys agreeing over their whole length sharing one."""

    def __init__(self):
        self.root = None  # a leaf is [key, class]; a node is (depth, children)
        self.classes = 0

    def add(self, key: bytes) -> int:
        if self.root is None:
            return self._leaf_root(key)
        node, path = self.root, []
        while type(node) is tuple:  # blindly: any child if the byte has none
            path.append(node)
            kids = node[1]
            node = kids.get(key[node[0]]) or next(iter(kids.values()))
        other = node[0]
        if other == key:
            return node[1]
        x = int.from_bytes(other) ^ int.from_bytes(key)
        depth = len(key) - (x.bit_length() + 7) // 8  # the first byte that differs
        leaf = [key, self.classes]
        self.classes += 1
        above = None
        for at in path:
            if at[0] >= depth:
                break
            above = at
        below = self.root if above is None else above[1].get(key[above[0]])
        if type(below) is tuple and below[0] == depth:
            below[1][key[depth]] = leaf
        elif below is None:
            above[1][key[above[0]]] = leaf
        else:
            branch = (depth, {other[depth]: below, key[depth]: leaf})
            if above is None:
                self.root = branch
            else:
                above[1][key[above[0]]] = branch
        return leaf[1]

    def _leaf_root(self, key: bytes) -> int:
        self.root = [key, 0]
        self.classes = 1
        return 0

    def order(self) -> list[int]:
        """Classes in the order of their keys."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def multikey(data: bytes, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at the given positions by their first ``depth``
    bytes (a multiple of 8), and whether each ordered one starts a group.

    Three-way partitioning by a pivot, the median of three, of every group at a
    time: the lesser and the greater keep their depth, the equal go 8 bytes on."""
    wide = np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
    order, first = np.arange(len(at)), np.zeros(len(at), bool)
    first[:1] = True
    start, size, deep = np.zeros(1, np.int64), np.array([len(at)]), np.zeros(1, np.int64)
    while True:
        live = (size > 1) & (deep < depth)
        start, size, deep = start[live], size[live], deep[live]
        if not len(start):
            return order, first
        g = np.repeat(np.arange(len(start)), size)
        head = np.cumsum(size) - size
        place = start[g] + np.arange(len(g)) - head[g]
        own = order[place]
        key = wide[at[own] + deep[g]].astype(np.uint64)
        a, b, c = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[g]
        to, begin = np.empty(len(g), np.int64), start.copy()
        parts = []
        for part, more in ((key < pivot, 0), (key == pivot, 8), (key > pivot, 0)):
            upto = np.cumsum(part)
            before = upto[head] - part[head]
            n = np.add.reduceat(part, head, dtype=np.int64)
            to[part] = (begin[g] + upto - 1 - before[g])[part]
            parts.append((begin.copy(), n, deep + more))
            begin += n
        order[to] = own
        start, size, deep = (np.concatenate(x) for x in zip(*parts, strict=True))
        first[start[size > 0]] = True


def deep_shallow(data: bytes, at: np.ndarray, size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at the given positions by their first ``size``
    bytes, and whether each ordered suffix starts a class: classes are what
    agrees over these bytes."""
    depth = min(shallow, size) // 8 * 8
    order, first = multikey(data, at, depth)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(at))
    many = end - begin > 1
    for s, e in zip(begin[many].tolist(), end[many].tolist(), strict=True):
        trie = BlindTrie()
        got = np.array([trie.add(data[p + depth : p + size]) for p in at[order[s:e]].tolist()])
        if trie.classes > 1:
            rank = np.empty(trie.classes, np.int64)
            rank[trie.order()] = np.arange(trie.classes)
            got = rank[got]
            by = np.argsort(got, kind="stable")
            order[s:e], got = order[s:e][by], got[by]
            first[s + 1 : e] = got[1:] != got[:-1]
    return order, first


def later_copies(strings: list[bytes], k: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each window that also starts at a smaller (k, position)."""
    data = b"".join(strings)
    length = np.array([len(s) for s in strings])
    many = np.maximum(0, length - size + 1)
    of = np.repeat(np.arange(len(strings)), many)
    off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    order, first = deep_shallow(data, np.repeat(np.cumsum(length) - length, many) + off, size)
    if not len(order):
        return order, order
    begin = np.flatnonzero(first)
    of_class = np.cumsum(first) - 1
    key, at = k[of[order]], (start[of] + off)[order]
    key_low = np.minimum.reduceat(key, begin)[of_class]
    at_low = np.minimum.reduceat(np.where(key == key_low, at, np.iinfo(np.int64).max), begin)[of_class]
    hit = np.sort(order[(key != key_low) | (at != at_low)])
    return of[hit], off[hit]


def scheme(size: int = WINDOW, gram: int = GRAM) -> Scheme:
    return Scheme(size, gram, _grams(gram), lambda b: b, bytes, lambda s, k, at, w: later_copies(s, k, at, size), True)


def repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """See repeated_windows: spans are runs of windows with an earlier copy, in bytes."""
    return repeated_windows(df, scheme(size, gram), key, text)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches):
        for b in A.slices(batches, "text"):
            texts, spans = (b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "spans"))
            total, gone, runs, kept = [], [], [], []
            for t, s in zip(texts, spans, strict=True):
                raw = t.encode("utf-8", "replace")
                own = covered(s, size, len(raw))
                left = b"".join([raw[a:e] for a, e in gaps(own, len(raw))])
                total.append(len(raw))
                gone.append(len(raw) - len(left))
                runs.append(len(own))
                kept.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("row")).field("doc_id"), *(pa.array(x, pa.int64()) for x in (total, gone, runs)), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeated_bytes(rows, size=size).mapInArrow(A.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
