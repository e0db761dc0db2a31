"""Nearest neighbours by a block matrix join.

Queries are dealt into groups, candidates too, and each task multiplies one
group of queries with one of candidates: it holds its queries and reads the
candidates block by block.  A tile of int8 products, with each vector's
quantisation residual, bounds every inner product; pairs whose upper bound does
not reach the best k lower bounds, or the k-th exact score so far, are dropped,
the others are recomputed in double precision.  Heaps keep each query's best k
in a task and merge them afterwards.  A vector travels once for each group of
the other side, and there are as many tasks as pairs of groups.

The result is exact.  Equal candidate vectors of a block are one vector with
its k + 1 smallest ids, which is all that can reach the best k.  Vectors that
are null, zero or hold null or non-finite components take no part, nor do
vectors of another length than the query's.  Repeated rows of one id count as
one if their vectors are equal.  Rows without an id take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import partitions

TOP = 20
#: Queries and candidates of a task at most (by count, dealt by a hash), and
#: candidates of a block.
QUERY_GROUP, GROUP, BLOCK = 16_384, 1 << 23, 8192
#: The sum of this many products of int8 codes is exact in float32.
EXACT_DIM = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes -127..127 (as float32), scales, and norms of the residuals."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes.astype(np.float32), scale, rest


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, a tile at a time."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIM):
        out += a[:, d : d + EXACT_DIM] @ b[:, d : d + EXACT_DIM].T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision; the order of the sum
    depends on the length only, so equal vectors score equally."""
    return (q * c).sum(axis=1)


class Block:
    """Distinct vectors of a block, quantised; ids of each, smallest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order] + 0.0  # no negative zero
        row = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, of = np.unique(row, return_index=True, return_inverse=True)
        self.x = x[first]
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(len(first) + 1))
        self.ids = [list(dict.fromkeys(ids[by[s:e]].tolist()))[:keep] for s, e in zip(cuts, cuts[1:], strict=False)]
        self.codes, self.scale, self.rest = quantise(self.x)
        self.norm = np.sqrt((self.x**2).sum(axis=1)) * (1 + 1e-9)


def tile(qid: np.ndarray, q: np.ndarray, block: Block, k: int, heaps: list[list]) -> None:
    """Fold the block into the queries' heaps of (score, -id)."""
    codes, scale, rest = quantise(q)
    near = products(codes, block.codes) * scale[:, None] * block.scale[None, :]
    norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
    # |q.c - near| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|
    slack = rest[:, None] * block.norm[None, :] + (norm + rest)[:, None] * block.rest[None, :] + 1e-12 * norm[:, None] * block.norm[None, :]
    low, high = near - slack, near + slack
    for i, heap in enumerate(heaps):
        bar = heap[0][0] if len(heap) == k else -np.inf
        if low.shape[1] > k:  # one of the k + 1 best may be the query itself
            bar = max(bar, np.partition(low[i], low.shape[1] - k - 1)[low.shape[1] - k - 1])
        at = np.flatnonzero(high[i] >= bar)
        scores = exact(np.broadcast_to(q[i], (len(at), q.shape[1])), block.x[at])
        for j in np.argsort(-scores, kind="stable"):
            s = float(scores[j])
            if len(heap) == k and s < heap[0][0]:
                break
            for v in block.ids[at[j]]:
                if v != qid[i]:
                    item = (s, -v)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    else:
                        break


class Task:
    """The queries of a task, by length, and the candidates not yet multiplied."""

    def __init__(self, k: int):
        self.k = k
        self.queries: dict[int, list] = {}
        self.waiting: dict[int, list] = {}
        self.ready: dict[int, tuple] = {}

    def add(self, ids: np.ndarray, vectors: pa.Array, kind: np.ndarray) -> None:
        size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dim in np.unique(size):
            for is_candidate, held in ((False, self.queries), (True, self.waiting)):
                at = np.flatnonzero((size == dim) & (kind.astype(bool) == is_candidate))
                if len(at):
                    held.setdefault(int(dim), []).append((ids[at], vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim))))
        for dim, parts in self.waiting.items():
            if sum(len(i) for i, _ in parts) >= BLOCK:
                self.multiply(dim)

    def multiply(self, dim: int) -> None:
        parts = self.waiting[dim]
        self.waiting[dim] = []
        if not parts or dim not in self.queries:
            return
        if dim not in self.ready:  # the queries come first, so they are complete
            qid, q = (np.concatenate(c) for c in zip(*self.queries[dim], strict=True))
            self.ready[dim] = (qid, q, [[] for _ in qid])
        qid, q, heaps = self.ready[dim]
        block = Block(np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts]), self.k + 1)
        for at in range(0, len(qid), 128):
            tile(qid[at : at + 128], q[at : at + 128], block, self.k, heaps[at : at + 128])

    def best(self):
        for dim in list(self.waiting):
            self.multiply(dim)
        for qid, _, heaps in self.ready.values():
            for at in range(0, len(qid), 1000):
                own = [sorted(h, reverse=True) for h in heaps[at : at + 1000]]
                yield pa.RecordBatch.from_arrays([pa.array(qid[at : at + 1000], pa.int64()), pa.array([[s for s, _ in x] for x in own], pa.list_(pa.float64())), pa.array([[-v for _, v in x] for x in own], pa.list_(pa.int64()))], names=["query_id", "scores", "ids"])


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """The ``k`` nearest of all other rows to each row where ``queries`` holds:
    query_id, rank, vec_id, score."""
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = df.withColumn("is_query", F.coalesce(queries, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("x"), "is_query").where(F.col("id").isNotNull() & F.col("x").isNotNull() & ok)
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    r = max(1, -(-size["q"] // QUERY_GROUP))
    c = max(1, -(-size["n"] // GROUP), min(-(-partitions(spark) // r), -(-size["n"] // BLOCK)))

    def dealt(n: int):  # the group of an id among n
        return F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")

    left = rows.where("is_query").select("id", "x").distinct().select(F.explode(F.sequence(dealt(r) * c, dealt(r) * c + c - 1)).alias("task"), F.lit(0).alias("kind"), "id", "x")
    right = rows.select(F.explode(F.sequence(dealt(c), F.lit((r - 1) * c) + dealt(c), F.lit(c))).alias("task"), F.lit(1).alias("kind"), "id", "x")
    met = left.unionByName(right).repartitionById(r * c, "task").sortWithinPartitions("kind")

    def tiles(batches):
        task = Task(k)
        for b in batches:
            if b.num_rows:
                task.add(b.column(2).to_numpy(zero_copy_only=False), b.column(3), b.column(1).to_numpy(zero_copy_only=False))
        yield from task.best()

    def merged(batches):
        held: dict[int, list] = {}
        for b in batches:
            for qid, s, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and qid not in held:
                    yield _ranked(held, k)
                    held = {}
                held.setdefault(qid, []).append([(-a, i) for a, i in zip(s, v, strict=True)])
        if held:
            yield _ranked(held, k)

    best = met.mapInArrow(A.lean(tiles), "query_id long, scores array<double>, ids array<long>")
    return best.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id").mapInArrow(A.lean(merged), "query_id long, rank int, vec_id long, score double")


def _ranked(lists: dict[int, list], k: int) -> pa.RecordBatch:
    out = []
    for qid, own in lists.items():
        seen, rank = set(), 0
        for s, v in heapq.merge(*own):
            if v not in seen:  # an id repeated with other vectors counts once, by its best
                seen.add(v)
                rank += 1
                out.append((qid, rank, v, -s))
                if rank == k:
                    break
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])
