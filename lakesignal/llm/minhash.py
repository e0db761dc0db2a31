"""Document fingerprints: one-permutation MinHash.

Every shingle (``shingle`` consecutive words; a shorter text is one shingle of
all its words, a text without words one empty shingle) is hashed once.  The
hash's top bits name a bin and each bin keeps its least hash.  An empty bin
copies the bin that its own fixed probe sequence reaches first (optimal
densification).  The ``bits`` low-order bits of each bin are packed; the share
of equal bins, corrected for chance agreement 2**-bits, estimates the Jaccard
likeness of two texts' shingle sets.

Null text counts as empty, repeated rows are fingerprinted alike, texts of any
length are read whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import partitions, tuned

SHINGLE, BINS, BITS = 5, 256, 4


def fingerprints(column: pa.Array, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Packed fingerprints (rows of bytes) of a string array."""
    data, off = A.buffers(column)
    starts, ends, first = A.words(data, off)
    h = A.word_hashes(data, starts, ends)
    n, count = len(off) - 1, np.diff(first)
    low = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    if len(h) >= shingle:
        w = A.window_hash(h, shingle)
        doc = np.repeat(np.arange(n), count)[: len(w)]
        inside = np.arange(len(w)) + shingle <= first[1:][doc]
        w, doc = w[inside], doc[inside]
        np.minimum.at(low, doc * bins + (w >> shift).astype(np.int64), w)
    short = np.flatnonzero(count < shingle)
    if len(short):
        x = A.mix(count[short].astype(np.uint64) + np.uint64(1))
        for j in range(shingle - 1):
            has = count[short] > j
            x[has] = A.mix(x[has] + h[first[:-1][short[has]] + j])
        low[short * bins + (x >> shift).astype(np.int64)] = x
    low = low.reshape(n, bins)
    full = low != np.iinfo(np.uint64).max
    out = low.copy()
    doc, b = np.nonzero(~full)
    tries, t = 64, 0
    while len(doc):  # each pass is one try of every bin that is still empty
        while t >= tries:
            tries *= 4
        to = A.probe_table(bins, tries)[t][b]
        hit = full[doc, to]
        out[doc[hit], b[hit]] = low[doc[hit], to[hit]]
        doc, b, t = doc[~hit], b[~hit], t + 1
    # scrambled with the bin's number, so that bins holding one value agree by chance independently
    v = (A.mix(out + np.arange(bins, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(v[:, :, None], axis=2)[:, :, 8 - bits :].reshape(n, bins * bits), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected likeness of rows of packed fingerprints, 0 to 1."""
    x = np.unpackbits(a ^ b, axis=1).reshape(len(a), -1, bits).any(axis=2)
    chance = 2.0**-bits
    return np.clip(((1 - x.mean(axis=1)) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with a column of packed fingerprints (binary)."""
    tuned(df.sparkSession)
    schema = df.drop(out).withColumn(out, F.lit(None).cast("binary")).schema
    at = df.drop(out).columns

    def run(batches):
        for b in A.slices(batches, text):
            packed = fingerprints(b.column(at.index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in packed], pa.binary())], names=[*at, out])

    return df.drop(out).mapInArrow(A.lean(run), schema)


@dataclass
class Ranges:
    """Ascending ranges of keys, null first, each cut into ``parts`` by the
    tie; numbered so that bucket 0 comes first in descending order."""

    limits: np.ndarray  # greatest key of each range but the last
    parts: np.ndarray  # of the null range, then of each range

    @property
    def size(self) -> int:
        return int(self.parts.sum())

    def number(self, key: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.where(null, 0, np.searchsorted(self.limits, key, side="left") + 1)
        place = tie.view(np.uint64) ^ np.uint64(1 << 63)  # ascending, unsigned
        sub = ((place >> np.uint64(32)) * self.parts[at].astype(np.uint64)) >> np.uint64(32)
        first = np.cumsum(self.parts) - self.parts
        return self.size - 1 - (first[at] + sub.astype(np.int64))


def ranges(keys: DataFrame, n: int) -> Ranges:
    """About ``n`` ranges of one size by quantiles of the column ``key``; a key
    with more rows than that, null too, has its range cut by the tie.  The
    driver holds the limits and at most n such keys."""
    total = keys.count()
    limits = set(map(int, keys.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else set()
    hot = {r.key: r.n for r in keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(1, total // n)).collect()}
    least = -(1 << 63)
    for k in hot:
        if k is not None:
            limits |= {k, max(k - 1, least)}
    limits = np.array(sorted(limits), np.int64)
    parts = np.ones(len(limits) + 2, np.int64)
    for k, c in hot.items():
        parts[0 if k is None else int(np.searchsorted(limits, k)) + 1] = -(-c // max(1, total // n))
    return Ranges(limits, parts)


def in_neighbour_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (bucket, key, text, edge) so that within each partition, sorted by
    descending key, a row's next row follows it; each bucket ends with a copy
    (edge) of the row that starts the next one, the last with the very first.

    Rows with equal keys follow each other by a hash of the text; null keys
    come last.  The driver holds the ranges and one key for each bucket.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    r = ranges(rows.select("key"), partitions(spark))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series, null: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(r.number(k.to_numpy(np.int64), null.to_numpy(bool), tie.to_numpy(np.int64)), dtype="int32")

    tie = F.xxhash64("text") if r.parts.max() > 1 else F.lit(0).cast("long")  # else the text is not read for it
    rows = rows.withColumn("bucket", bucket_of(F.coalesce("key", F.lit(0)), F.col("key").isNull(), tie))
    heads = sorted((x.bucket, x.head) for x in rows.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    if not heads:
        return rows.select("bucket", "key", "text", F.lit(False).alias("edge"))
    follow = spark.createDataFrame([(heads[i - 1][0], *heads[i]) for i in range(len(heads))], "to int, eb int, ekey long")
    first = rows.join(F.broadcast(follow), (F.col("bucket") == F.col("eb")) & F.col("key").eqNullSafe(F.col("ekey")))
    edges = first.groupBy("to").agg(F.max_by(F.struct("key", "text"), F.xxhash64("text")).alias("x")).select(F.col("to").alias("bucket"), "x.*", F.lit(True).alias("edge"))
    both = rows.select("bucket", "key", "text", F.lit(False).alias("edge")).unionByName(edges)
    return both.repartitionById(r.size, "bucket").sortWithinPartitions("bucket", "edge", F.desc_nulls_last("key"), F.xxhash64("text").desc())


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last third is
    replaced by the beginning of the next text in descending key order."""
    tuned(df.sparkSession)
    ordered = in_neighbour_order(df, key, text).select("key", "text", "edge")

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for b in A.slices(batches, "text"):
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = b.slice(b.num_rows - 1)
            edge = b.column("edge").to_numpy(zero_copy_only=False)
            if b.num_rows < 2:
                continue
            own = [x or "" for x in b.column("text").to_pylist()]
            marks = fingerprints(pa.array(own, pa.large_string()))
            at = np.flatnonzero(~edge[:-1])
            if not len(at):
                continue
            made = []
            for i in at:
                cut = len(own[i]) // 3
                made.append(own[i][: len(own[i]) - cut] + own[i + 1][:cut])
            new = fingerprints(pa.array(made, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(pa.array(at)),
                    pa.array([len(own[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in made]),
                    pa.array([marks[i].tobytes().hex() for i in at]),
                    pa.array([x.tobytes().hex() for x in new]),
                    pa.array(likeness(marks[at], new)),
                    pa.array(likeness(marks[at], marks[at + 1])),
                ],
                names=[x.split()[0] for x in PAIR_SCHEMA.split(", ")],
            )

    return ordered.mapInArrow(A.lean(pairs), PAIR_SCHEMA)
