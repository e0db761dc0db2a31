"""SimHash near-duplicate linking with the pigeonring filter.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a
text's word shingles (repeats included).  Two fingerprints link at ``limit`` or
fewer differing bits.

The 64 bits are a ring of segments.  If two fingerprints differ in at most t
bits, there is a start on the ring from which every chain of l of the m segments
differs in at most floor(t l / m) bits (pigeonring principle).  For t = 3 and 16
segments of 4 bits: none in the first five, at most one in the next five; for
t = 7 and 8 segments of 8 bits: none in the first, at most one in the first two
and two in the first three.  So some nibbles after the start are equal, in one
of a few ways (``WAYS``); each distinct fingerprint is filed under (start, way,
those nibbles).  Candidates of a bucket must pass all chain budgets from that
start before the full Hamming check.

Equal fingerprints are one node, so groups of copies never become pairs; each
task hands on a spanning forest of the links it found.  Components are found
by alternating star contractions, checkpointed each round.

Null text counts as empty, and empty texts are copies of each other.  Rows of
one key are rows each; texts of any length are read whole; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._graph import components, forest, looked_up
from ._spark import materialize, partitions, tuned

SHINGLE, LIMIT, SEED = 3, 3, 42
#: By limit: nibbles of a segment, and the nibbles after a start (itself 0) of
#: which, in one way at least, all are equal if the chains keep their budgets.
WAYS = {
    3: (1, ((0, 1, 2, 3, 4, 5, 6), (0, 1, 2, 3, 4, 7, 8, 9))),
    7: (2, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 2, 5), (0, 1, 3, 4), (0, 1, 3, 5))),
}
BLOCK, SMALL = 2048, 64


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text; ASCII capitals count as small letters."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII blanks and case only
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(shingle, len(words))
    starts = [0, *end][: len(words) - k + 1]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s : e - 1], seed) for s, e in zip(starts, end[k - 1 :], strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_simhash(df: DataFrame, text: str = "text", out: str = "simhash", shingle: int = SHINGLE) -> DataFrame:
    """``df`` without its text, with the fingerprint as a signed long."""
    tuned(df.sparkSession)
    base = df.drop(out)
    rest = [c for c in base.columns if c != text]
    names = base.columns
    schema = base.drop(text).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        for b in A.slices(batches, text):
            v = np.array([simhash(x, shingle) for x in b.column(names.index(text)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in rest), pa.array(v, pa.int64())], names=[*rest, out])

    return base.mapInArrow(A.lean(run), schema)


def keys(v: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The bucket keys of each fingerprint, one row for each: start and way in
    the bits from 40 on, nibbles below."""
    width, ways = WAYS[limit]
    out = np.empty((len(v), 16 // width * len(ways)), np.uint64)
    for start in range(0, 16, width):
        for n, way in enumerate(ways):
            key = np.full(len(v), start * len(ways) + n, np.uint64) << np.uint64(40)
            for i, j in enumerate(way):
                key |= ((v >> np.uint64(4 * ((start + j) % 16))) & np.uint64(15)) << np.uint64(4 * i)
            out[:, start // width * len(ways) + n] = key
    return out


def turned(k: np.ndarray, v: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Fingerprints rotated to begin at the starts of their keys."""
    by = np.uint64(4) * ((k.view(np.uint64) >> np.uint64(40)) // np.uint64(len(WAYS[limit][1])))
    return np.where(by == 0, v, (v >> by) | (v << (np.uint64(64) - np.maximum(by, np.uint64(1)))))


def chained(x: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Whether differences keep the chain budgets from the lowest bit on, and
    then the limit."""
    width = WAYS[limit][0]
    budget = {n: limit * n // 16 for n in range(width, 17, width)}
    ok = np.ones(x.shape, bool)
    for n, most in budget.items():
        if n == 16 or budget[n + width] > most:  # the longest chain of each budget
            ok &= np.bitwise_count(x & np.uint64((1 << (4 * n)) - 1)) <= most
    return ok


def links_in_buckets(k: np.ndarray, v: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of distinct fingerprints of one key within the limit,
    keys ascending: buckets up to ``SMALL`` together, by the distance of the
    two, others alone by blocks."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if not len(k):
        return found[0]
    t = turned(k, v, limit)
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(edge, len(k)))
    end = np.repeat(np.where(size <= SMALL, edge + size, 0), size)
    i = np.flatnonzero(end > np.arange(len(k)) + 1)
    d = 1
    while len(i):
        ok = chained(t[i] ^ t[i + d], limit)
        found.append((i[ok], i[ok] + d))
        d += 1
        i = i[i + d < end[i]]
    for s, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = t[s : s + n]
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                ok = chained(own[i : i + BLOCK, None] ^ own[None, j : j + BLOCK], limit)
                a, b = np.nonzero(np.triu(ok, 1) if i == j else ok)
                found.append((s + i + a, s + j + b))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(nodes: DataFrame, column: str = "simhash", limit: int = LIMIT) -> DataFrame:
    """Edges (src, dst) that connect exactly the fingerprints that links at the
    limit connect; ``nodes`` holds distinct fingerprints."""
    spark = nodes.sparkSession

    def file(batches):
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(v), 4096):
                k = keys(v[at : at + 4096], limit)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()), pa.array(np.repeat(v[at : at + 4096].view(np.int64), k.shape[1]))], names=["k", "v"])

    def match(batches):
        found, held = [], None
        for b in _with_end(batches):
            if b is not None:
                k, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                if held is not None:
                    k, v = np.concatenate([held[0], k]), np.concatenate([held[1], v])
                cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
                held, k, v = (k[cut:], v[cut:]), k[:cut], v[:cut]
            elif held is None:
                break
            else:
                k, v = held
            i, j = links_in_buckets(k, v.view(np.uint64), limit)
            if len(i):
                found.append(forest(v[i], v[j]))
            if len(found) > 200:
                found = [forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))]
        if found:
            src, dst = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    filed = nodes.select(column).mapInArrow(A.lean(file), "k long, v long")
    return filed.repartition(partitions(spark), "k").sortWithinPartitions("k").mapInArrow(A.lean(match), "src long, dst long")


def _with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """Rows (key, fingerprint, component_id) for each row of ``df``: the
    component is named by its smallest key.  A component of null keys only has
    a null name.  ``limit`` is one of ``WAYS``."""
    tuned(df.sparkSession)
    marked = materialize(with_simhash(df.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle=shingle), "simhash")
    total = marked.count()
    nodes = materialize(marked.groupBy("simhash").agg(F.min("key").alias("least"), F.count("*").alias("n")), "nodes")
    joined = components(links(nodes, limit=limit))
    named = nodes.join(joined, F.col("simhash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "simhash")).drop("node")
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = looked_up(named.select(F.col("simhash").alias("mark"), "root", F.col("n").alias("copies")), "root", least, "of", nodes.count())
    got = looked_up(marked, "simhash", of.select("mark", "component_id", F.col("copies").alias("n")), "mark", total)
    return got.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
