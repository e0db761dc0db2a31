"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A logistic model over hashed words and word
beginnings (``PREFIXES`` bytes, so that inflected forms share one) scores each
sentence; the document's score is the noisy-or 1 - prod(1 - p).  Only
document labels train the model; the sentence scores then say where the
offence is.

``fit`` takes at most about ``per_class`` labelled documents of each class
(chosen by a hash of their id); their features lie in a written table, from
which the driver gets document counts by feature, and then the chosen features
only.  A toxic document weighs ``WEIGHT`` times as much as another.

Null or empty text has no sentence and scores 0.  Conflicting labels of one
document count as toxic; labels without a document, and null ids and labels, are
left out.  Texts of any length are read whole; repeated rows count and score
each.  Without labels every text scores near 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import materialize, tuned

BUCKETS = 1 << 18
PER_CLASS = 2000
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is learned if so many sample documents have it, toxic ones more
#: often than others by so many standard errors.
LEAST_DOCS, LEAST_Z = 5, 3.0
WEIGHT = 2.0
#: Sentence ends become a line feed, other ASCII punctuation a blank.
_FOLD = np.array([10 if chr(x) in ".!?\n\r" else x if x >= 128 or chr(x).isalnum() or chr(x) == "'" else 32 for x in range(256)], np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts; each sentence's first word; each document's
    first sentence (both with a last entry); each sentence's start byte."""
    data, off = A.buffers(column)
    data = _FOLD[data] if len(data) else data
    ws, we, _ = A.words(data, off)
    ss, se, sdoc = A.words(data, off, _BREAK)  # sentences: runs between breaks
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(off), np.int64), ss[:0]
    h = A.prefix_hash(data)
    whole = A.span_hash(h, ws, we) >> np.uint64(64 - 17)
    half = np.uint64(BUCKETS // 2)
    begins = [(A.span_hash(h, ws, np.minimum(we, ws + n)) >> np.uint64(64 - 17)) + half for n in PREFIXES]
    bucket = np.column_stack([whole, *begins]).ravel().astype(np.int64)
    first = (1 + len(PREFIXES)) * np.searchsorted(ws, ss)
    full = np.append(first[1:], len(bucket)) > first  # sentences with words
    sdoc = np.concatenate([[0], np.cumsum(full)])[sdoc]
    return bucket, np.append(first[full], len(bucket)), sdoc, ss[full]


def _segment(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x between consecutive bounds, empty ones being 0."""
    c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def sentence_scores(model: tuple[np.ndarray, float], bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    w, bias = model
    return 1 / (1 + np.exp(-np.clip(_segment(w[bucket], first) + bias, -30, 30)))


def noisy_or(p: np.ndarray, sdoc: np.ndarray) -> np.ndarray:
    return -np.expm1(_segment(np.log1p(-p), sdoc))


def select(a: np.ndarray, c: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features to learn: ``a`` of ``n1`` toxic and ``c`` of ``n0`` other
    documents have them."""
    n1, n0 = max(1, n1), max(1, n0)
    share = (a + c) / (n1 + n0)
    z = (a / n1 - c / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    return (a + c >= LEAST_DOCS) & (z >= LEAST_Z)


def fit_arrays(bucket: np.ndarray, first: np.ndarray, sdoc: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Adam on the bags' cross-entropy with a quadratic penalty; ``bucket``
    holds chosen features only, ``first`` and ``sdoc`` as in ``bags``."""
    w, bias = np.zeros(BUCKETS), -8.0
    if not len(bucket):
        return w.astype(np.float32), bias
    doc = np.repeat(np.arange(len(y)), np.diff(sdoc))
    sent = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seen, local = np.unique(bucket, return_inverse=True)
    weight = np.where(y > 0, WEIGHT, 1.0)[doc]
    m, v, x = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    x[-1] = -6.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_segment(x[local], first) + x[-1], -30, 30)))
        whole = np.clip(noisy_or(p, sdoc), 1e-9, 1 - 1e-12)
        g = weight * np.where(y[doc] > 0, -(1 - whole[doc]) / whole[doc], 1.0) * p
        d = np.append(np.bincount(local, g[sent], len(seen)), g.sum()) / len(y)
        d[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        x -= (0.15 if t < 0.7 * steps else 0.02) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    w[seen] = x[:-1]
    return w.astype(np.float32), float(x[-1])


def sample(df: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """Rows (y, w, s) of the documents to learn from: class, and the features
    and their number in each sentence as packed integers."""
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    share = {r["y"]: min(1.0, per_class / r["count"]) for r in known.groupBy("y").count().collect()}
    limit = F.create_map(*[x for k, v in (share or {0: 0.0}).items() for x in (F.lit(k), F.lit(int(v * (1 << 20))))])[F.col("y")]
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < limit)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("text", "y")  # at most about 2 x per_class labels

    def made(batches):
        for b in A.slices(batches, "text"):
            bucket, first, sdoc, _ = bags(b.column("text"))
            at = [first[sdoc[i] : sdoc[i + 1] + 1] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([bucket[x[0] : x[-1]].astype("<u4").tobytes() for x in at]), pa.array([np.diff(x).astype("<u4").tobytes() for x in at])], names=["y", "w", "s"])

    return materialize(rows.mapInArrow(A.lean(made), "y int, w binary, s binary"), "toxicity")


def fit(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on labelled documents whose ``key`` satisfies ``usable``."""
    tuned(df.sparkSession)
    rows = sample(df, labels, usable, key, text, label, per_class)

    def counted(batches):
        """Documents of either class by feature; all documents as feature -1."""
        for b in batches:
            own = [np.append(np.unique(np.frombuffer(w, "<u4")).astype(np.int64), -1) for w in b.column("w").to_pylist()]
            n = np.array([len(x) for x in own], np.int64)
            toxic = np.repeat(b.column("y").to_numpy(zero_copy_only=False) > 0, n)
            seen, of = np.unique(np.concatenate(own), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(np.bincount(of[x], minlength=len(seen))) for x in (toxic, ~toxic))], names=["f", "a", "c"])

    count = rows.mapInArrow(A.lean(counted), "f long, a long, c long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    f, a, c = (x.to_numpy() for x in count.where(F.col("a") + F.col("c") >= LEAST_DOCS).toArrow().columns)  # at most BUCKETS + 1 rows
    total = f == -1
    chosen = np.sort(f[~total][select(a[~total], c[~total], int(a[total].sum()), int(c[total].sum()))])

    def kept(batches):
        for b in batches:
            w, s = [], []
            for x, n in zip(b.column("w").to_pylist(), b.column("s").to_pylist(), strict=True):
                x, n = np.frombuffer(x, "<u4"), np.frombuffer(n, "<u4").astype(np.int64)
                has = np.isin(x, chosen)
                w.append(x[has].tobytes())
                s.append(np.diff(np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], np.cumsum(n)])]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(w, pa.binary()), pa.array(s, pa.binary())], names=["y", "w", "s"])

    got = sorted((r["y"], bytes(r["w"]), bytes(r["s"])) for r in rows.mapInArrow(A.lean(kept), "y int, w binary, s binary").toArrow().to_pylist())
    bucket = np.frombuffer(b"".join(w for _, w, _ in got), "<u4").astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(s for _, _, s in got), "<u4").astype(np.int64))])
    sdoc = np.concatenate([[0], np.cumsum([len(s) // 4 for _, _, s in got])]).astype(np.int64)
    return fit_arrays(bucket, first, sdoc, np.array([y for y, _, _ in got]))


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.5, out: str = "score", where: str = "offending") -> DataFrame:
    """``df`` with the document's score and the offending sentences: structs of
    start byte, and score, of each sentence whose own score reaches the
    threshold; if none does in a document that does, its highest one."""
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats
    base = df.drop(out, where)
    names = base.columns
    schema = base.withColumn(out, F.lit(0.0).cast("double")).withColumn(where, F.lit(None).cast("array<struct<start:long,score:double>>")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in A.slices(batches, text):
            column = b.column(names.index(text))
            bucket, first, sdoc, starts = bags(column)
            _, off = A.buffers(column)
            p = sentence_scores(sent.value, bucket, first)
            whole = noisy_or(p, sdoc)
            found = []
            for i in range(b.num_rows):
                if whole[i] < threshold:
                    found.append([])
                    continue
                own = np.arange(sdoc[i], sdoc[i + 1])
                bad = own[p[own] >= threshold]
                found.append([{"start": int(starts[k] - off[i]), "score": float(p[k])} for k in (bad if len(bad) else own[[p[own].argmax()]])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(whole, 0, 1), pa.float64()), pa.array(found, kind)], names=[*names, out, where])

    return base.mapInArrow(A.lean(run), schema)
