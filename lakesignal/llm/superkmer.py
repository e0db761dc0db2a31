"""Substring dedup over words by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text (words are runs of bytes
other than ASCII blanks).  Every word covered by a window whose word sequence
also starts anywhere else, in the same text included, is removed; windows are
judged on the input.  Consecutive windows that share a minimiser travel as one
packed string to their bucket, where sorting counts windows exactly.

Null text has no words.  A repeated row is another text with the same windows.
Shorter texts than a window lose nothing; texts of any length are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _arrays as A
from ._windows import Scheme, covered, gaps, repeated_windows

WINDOW, GRAM = 35, 8


def _grams(gram: int):
    def run(data, off):
        starts, ends, first = A.words(data, off)
        return A.window_hash(A.word_hashes(data, starts, ends), gram), first

    return run


def count_windows(strings: list[bytes], size: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each window whose weight over all strings is over 1.

    Words get numbers, then runs of 2, 4, 8, ... words get ranks by sorting
    pairs of ranks, so equal ranks mean equal words."""
    numbers: dict[bytes, int] = {}
    cut = [s.split(b" ") for s in strings]
    flat = np.array([numbers.setdefault(w, len(numbers)) for own in cut for w in own], np.int64)
    length = np.array([len(x) for x in cut])
    rank, span = flat, 1
    while span < size:
        step = min(span, size - span)
        pair = rank[:-step] * (len(flat) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        span += step
    of = np.repeat(np.arange(len(cut)), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    whole = np.flatnonzero(at + size <= length[of])
    own = rank[whole]
    twice = np.bincount(own, weight[of[whole]])[own] > 1
    return of[whole[twice]], at[whole[twice]]


def scheme(size: int = WINDOW, gram: int = GRAM) -> Scheme:
    return Scheme(size, gram, _grams(gram), lambda b: b.split(), b" ".join, lambda s, k, at, w: count_windows(s, size, w), False)


def repeated_words(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """See repeated_windows: spans are runs of repeated windows, in words."""
    return repeated_windows(df, scheme(size, gram), key, text)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``df`` with the text's kept words; a text that loses none stays as it
    is, any other has its kept words joined by one blank.  A null text becomes
    an empty one."""
    names = df.columns

    def run(batches):
        for b in A.slices(batches, "text"):
            texts, spans = (b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "spans"))
            row = b.column(b.schema.names.index("row"))
            out = []
            for t, s in zip(texts, spans, strict=True):
                if s:
                    w = t.encode("utf-8", "replace").split()
                    t = b" ".join([x for a, e in gaps(covered(s, size, len(w)), len(w)) for x in w[a:e]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else row.field(c) for c in names], names=names)

    return repeated_words(df, key, text, size).mapInArrow(A.lean(run), df.schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""

    def run(batches):
        for b in A.slices(batches, "text"):
            texts, spans = (b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "spans"))
            total, gone, kept = [], [], []
            for t, s in zip(texts, spans, strict=True):
                w = t.encode("utf-8", "replace").split()
                own = gaps(covered(s, size, len(w)), len(w))
                left = [x for a, e in own for x in w[a:e]]
                total.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("row")).field("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    from pyspark.sql import functions as F

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeated_words(rows, size=size).mapInArrow(A.lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
