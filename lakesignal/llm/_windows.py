"""Exact search for repeated windows, shared by the two substring operators.

A text is a sequence of units (words or bytes); a window is ``size``
consecutive units of one text.  The minimiser of a window is the leftmost of its
``gram``-unit grams of least hash; consecutive windows with one minimiser form
a super-k-mer.

1. ``cut`` and ``meet``: the minimisers of all super-k-mers meet, without text.
   A window that occurs twice has a minimiser that occurs in two super-k-mers,
   so those with a lone minimiser are dropped, which loses nothing.  A task
   hands on each minimiser once and marks what it saw repeatedly itself, so a
   minimiser has at most one entry for each task.
2. ``collect``: the other super-k-mers travel as one packed string each to
   their minimiser's bucket.  A task sends equal strings once; what it can
   decide for its own copies it decides at once.
3. ``decide``: a bucket's distinct strings are sorted and repeated windows
   found exactly; the answers (start, windows) go back to the documents.  No
   window occurs twice in one string, since a string has one minimiser.

Documents are shuffled once, by (id, text hash), for steps 2 and 4 alike.
Hashes only bring candidates together; equality is decided on the units.
Entries of step 1 travel as columns packed for each pair of tasks.

Hot keys: a task sends a string once, so copies do not meet in a bucket.  A
passage shared by very many texts has boundary strings that differ and share a
minimiser; so minimisers are counted first, and those above a share of all
entries (a list that this share bounds) have their strings cut into windows,
each dealt by a hash of the whole of it.  A row that repeats above that share
(one id and text) is dealt over several tasks, which its answers also go to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import partitions, tuned

#: Super-k-mers, and bytes of packed strings, that a task holds at a time.
HELD_ROWS, HELD_BYTES = 500_000, 32 << 20
#: Bytes of packed strings that are sorted at a time (whole buckets).
SORT_BYTES = 4 << 20
#: Hot is what has over 1 / (SHARES x partitions) of all entries or rows.
SHARES = 4
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Scheme:
    size: int  # units of a window
    gram: int  # units of a gram
    #: bytes, offsets -> hash of each gram, first unit of each document
    grams: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: text bytes -> sequence of units that slices, and the packing of a slice
    units: Callable[[bytes], list]
    pack: Callable[[list], bytes]
    #: distinct packed strings of buckets that hold several, their ids, starts
    #: and weights -> arrays (string number, offset) of repeated windows
    decide: Callable
    #: whether the earliest copy stays (else all copies are repeated)
    keep_first: bool


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns, each in as few bytes as its values take."""
    out = []
    for c in columns:
        for code in ("<u1", "<u2", "<u4", "<i8"):
            if code == "<i8" or not len(c) or (c.min() >= 0 and c.max() <= np.iinfo(code).max):
                break
        c = c.astype(code)
        out.append(code[1:].encode() + len(c).to_bytes(4, "little") + c.tobytes())
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind = "<" + blob[at : at + 2].decode()
        n = int.from_bytes(blob[at + 2 : at + 6], "little")
        c = np.frombuffer(blob, kind, n, at + 6)
        out.append(c.astype(np.int64))
        at += 6 + c.nbytes
    return out


def by_target(target: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(p), [c[cuts[p] : cuts[p + 1]] for c in columns]


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "b"])


def width(df: DataFrame) -> int:
    """Partitions for the packed exchanges: those of shuffles, more if the size
    of the plan's inputs asks for it (inputs of unknown size say nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions(df.sparkSession), sum(x for x in sizes if x < 1 << 55) >> 25)


def super_kmers(s: Scheme, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, document, start unit and number of windows."""
    g, first = s.grams(data, off)
    many = np.maximum(0, np.diff(first) - s.size + 1)
    total = int(many.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    # the upper half of the hash, then the place: ties go to the leftmost gram,
    # so equal windows choose alike and each super-k-mer has one minimiser
    place = np.arange(len(g), dtype=np.uint64)
    low = A.sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | place, s.size - s.gram + 1) & np.uint64(0xFFFFFFFF)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.arange(total) - np.repeat(np.cumsum(many) - many, many)  # start in its document
    low = low[first[:-1][doc] + at].astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] == 0)
    begin = np.flatnonzero(new)
    return g[low[begin]].view(np.int64), doc[begin], at[begin], np.diff(np.append(begin, total))


def hot_minimisers(docs: DataFrame, scheme: Scheme, n: int) -> np.ndarray:
    """Sorted minimisers with over 2 / (SHARES x n) of all distinct strings of
    the tasks, and possibly some with over half of that: never more than
    SHARES x n.  A task reports those above the share among its own; so what
    it keeps to itself is less than the share of all."""
    share = 1 / (SHARES * n)

    def count(batches):
        held, rows, total = [], 0, 0
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold():
            # a string is told by its minimiser, windows and outer grams; a load's measure needs no more
            mz, many, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
            x = A.mix(mz.view(np.uint64) + A.mix(left + A.mix(right + many.astype(np.uint64))))
            _, at = np.unique(x, return_index=True)
            m, c = np.unique(mz[at], return_counts=True)
            return np.concatenate([kept[0], m]), np.concatenate([kept[1], c]), len(at)

        def merged(m, c, least):
            u, of = np.unique(m, return_inverse=True)
            c = np.bincount(of, c, len(u)).astype(np.int64)
            return u[c > least], c[c > least]

        for b in A.slices(batches, "text"):
            data, off = A.buffers(b.column(0))
            mz, doc, at, many = super_kmers(scheme, data, off)
            if len(mz):
                g, first = scheme.grams(data, off)
                s = first[:-1][doc] + at
                held.append((mz, many, g[s], g[s + many - 1 + scheme.size - scheme.gram]))
                rows += len(mz)
            if rows > HELD_ROWS:
                m, c, own = fold()
                total += own
                held, rows = [], 0
                kept = merged(m, c, share * own)  # a flush is a task's part: the same bound holds
        if held:
            m, c, own = fold()
            total += own
            kept = merged(m, c, share * own)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(kept[0], 0)), pa.array(np.append(kept[1], total)), pa.array(np.append(np.zeros(len(kept[0]), bool), True))], names=["mz", "c", "every"])

    got = docs.select("text").mapInArrow(A.lean(count), "mz long, c long, every boolean").groupBy("every", "mz").agg(F.sum("c").alias("c")).persist()
    try:
        total = (got.where("every").agg(F.sum("c")).first()[0] or 0) * share
        return np.sort(np.array([r.mz for r in got.where(~F.col("every") & (F.col("c") > max(1.0, total))).collect()], np.int64))
    finally:
        got.unpersist()


def hot_rows(docs: DataFrame, n: int) -> DataFrame | None:
    """Rows (k, h, places) of the documents that repeat above the share, at
    most SHARES x n; None without any."""
    most = max(1, docs.count() // (SHARES * n))
    found = docs.groupBy("k", "h").agg(F.count("*").alias("copies")).where(F.col("copies") > most).collect()
    return docs.sparkSession.createDataFrame([(r.k, r.h, -(-r.copies // most)) for r in found], "k long, h long, places long") if found else None


def _aside(mz: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A key that spreads rows which only pass through."""
    return A.mix(mz.astype(np.int64).view(np.uint64) + A.mix(salt.astype(np.int64).view(np.uint64))).view(np.int64)


def repeated_windows(df: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns k (id, LAST if null), h, text (never null), row (the columns of
    ``df``) and spans (start, n: runs of windows that are repeated)."""
    spark = tuned(df.sparkSession)
    n = width(df)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(body).alias("h"), body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"))

    def cut(batches):
        """Packed entries (p, b) for the partition that each minimiser goes to."""
        held, rows = [], 0
        for b in A.slices(batches, "text"):
            mz, doc, at, _ = super_kmers(scheme, *A.buffers(b.column(2)))
            if len(mz):
                k, h = (b.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
                held.append((mz, k, h, at))
                rows += len(mz)
            if rows > HELD_ROWS:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    def flush(held):
        mz, k, h, at = (np.concatenate(x) for x in zip(*held, strict=True))
        _, of, count = np.unique(mz, return_inverse=True, return_counts=True)
        local = (count[of] > 1).astype(np.int64)
        _, once = np.unique(A.mix(k.view(np.uint64) + A.mix(h.view(np.uint64) + A.mix(at.view(np.uint64)))), return_index=True)
        if len(once) < len(mz):  # rows that repeat are entered once, marked as seen repeatedly
            once.sort()
            mz, k, h, at, local = (x[once] for x in (mz, k, h, at, local))
        _, first, of = np.unique(mz, return_index=True, return_inverse=True)
        probe = first[of] == np.arange(len(mz))
        target = (A.mix(np.where(probe, mz, _aside(mz, k + at)).view(np.uint64)) % np.uint64(n)).astype(np.int64)
        out = []
        for p, (m, pr, lo, ks, hs, a) in by_target(target, n, mz, probe, local, k, h, at):
            ids, _, doc = _documents(ks, hs)
            out.append((p, packed(ids[0], ids[1], m[pr], lo[pr], doc[pr], a[pr], doc[~pr], a[~pr])))
        return blobs(out)

    def meet(batches):
        """Packed entries of documents whose minimisers occur elsewhere."""
        to, lo, k, h, at = [], [], [], [], []
        for b in batches:
            for blob in b.column(1).to_pylist():
                ids0, ids1, m, own, doc, a, more, c = unpacked(blob)
                to.append(m)
                lo.append(own)
                doc = np.concatenate([doc, more])
                k.append(ids0[doc])
                h.append(ids1[doc])
                at.append((a, c))
        if not to:
            return
        _, of, count = np.unique(np.concatenate(to), return_inverse=True, return_counts=True)
        keep = (count[of] > 1) | (np.concatenate(lo) > 0)
        marks, s = [], 0
        for m, (_, c) in zip(to, at, strict=True):
            marks += [keep[s : s + len(m)], np.ones(len(c), bool)]
            s += len(m)
        keep = np.concatenate(marks)
        k, h, at = np.concatenate(k)[keep], np.concatenate(h)[keep], np.concatenate([x for a in at for x in a])[keep]
        target = (A.mix(k.view(np.uint64) + A.mix(h.view(np.uint64))) % np.uint64(n)).astype(np.int64)
        out = []
        for p, (ks, hs, a) in by_target(target, n, k, h, at):
            ids, _, doc = _documents(ks, hs)
            out.append((p, packed(ids[0], ids[1], doc, a)))
        if out:
            yield blobs(out)

    def gather(batches):
        """One row for each document: the starts of its super-k-mers."""
        got = [unpacked(x) for b in batches for x in b.column(1).to_pylist()]
        if not got:
            return
        k, h = (np.concatenate([x[i][x[2]] for x in got]) for i in (0, 1))
        at = np.concatenate([x[3] for x in got])
        ids, _, doc = _documents(k, h)
        order = np.lexsort((at, doc))
        cuts = np.searchsorted(doc[order], np.arange(len(ids[0]) + 1))
        at = at[order]
        for s in range(0, len(ids[0]), 2000):
            e = min(len(ids[0]), s + 2000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][s:e]), pa.array(ids[1][s:e]), pa.array([packed(np.unique(at[cuts[i] : cuts[i + 1]])) for i in range(s, e)], pa.binary())], names=["k", "h", "parts"])

    met = docs.select("k", "h", "text").mapInArrow(A.lean(cut), "p int, b binary").repartitionById(n, "p").mapInArrow(A.lean(meet), "p int, b binary")
    lists = met.repartitionById(n, "p").mapInArrow(A.lean(gather), "k long, h long, parts binary")
    hot = hot_minimisers(docs, scheme, n)
    many_rows = hot_rows(docs, n)
    if many_rows is None:
        place = ["k", "h"]
        over = lambda rows: rows
    else:  # such a row has a place in each of its parts, and what is found for it goes to all
        place = ["k", "h", "part"]
        every = F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)).cast("int") - F.lit(1)))
        docs = docs.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(many_rows), ["k", "h"], "left").withColumn("part", F.pmod("_at", F.coalesce("places", F.lit(1))).cast("int")).drop("_at", "places")
        over = lambda rows: rows.join(F.broadcast(many_rows), ["k", "h"], "left").withColumn("part", every).drop("places")
    placed = docs.repartition(n, *place)

    def collect(batches):
        """Rows (to, k, h, at, many, weight, s); s is null where decided."""
        strings: dict[bytes, int] = {}
        held, size = [], 0
        for b in A.slices(batches, "text"):
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            mz, doc, at, many = super_kmers(scheme, *A.buffers(col["text"]))
            parts = [unpacked(x)[0] for x in col["parts"].to_pylist()]
            want = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            keep = np.isin(doc * (1 << 40) + at, want * (1 << 40) + np.concatenate(parts))
            mz, doc, at, many = mz[keep], doc[keep], at[keep], many[keep]
            if len(hot):
                mz, doc, at, many = _windows_of(hot, mz, doc, at, many, col["text"])
            sid, own, units = [], -1, None
            texts = col["text"]
            for d, s, e in zip(doc.tolist(), at.tolist(), (at + many + scheme.size - 1).tolist(), strict=True):
                if d != own:
                    own, units = d, scheme.units(texts[d].as_py().encode("utf-8", "replace"))
                x = scheme.pack(units[s:e])
                i = strings.setdefault(x, len(strings))
                if i == len(strings) - 1:
                    size += len(x)
                sid.append(i)
            k, h = (col[c].to_numpy(zero_copy_only=False)[doc] for c in ("k", "h"))
            held.append((np.array(sid, np.int64), mz, k, h, at, many))
            size += 150 * len(sid)
            if size > HELD_BYTES:
                yield from send(strings, held)
                strings, held, size = {}, [], 0
        yield from send(strings, held)

    def send(strings, held):
        if not strings:
            return
        sid, mz, k, h, at, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, at, k, sid))
        sid, mz, k, h, at, many = (x[order] for x in (sid, mz, k, h, at, many))
        first = np.ones(len(sid), bool)
        first[1:] = sid[1:] != sid[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(sid)), 0))
        count = np.bincount(sid)
        done = (k != k[head]) | (at != at[head]) if scheme.keep_first else count[sid] > 1
        texts = pa.array(list(strings), pa.binary())
        for s in range(0, len(texts), 20_000):
            i = np.flatnonzero(first)[s : s + 20_000]
            yield answers(mz[i], k[i], h[i], at[i], many[i], np.minimum(count[s : s + 20_000], 2), texts.slice(s, 20_000))
        i = np.flatnonzero(done)
        if len(i):
            i = i[np.lexsort((at[i], h[i], k[i]))]
            k, h, at, many = k[i], h[i], at[i], many[i]
            new = np.ones(len(i), bool)
            new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (at[1:] > at[:-1] + many[:-1])
            end = np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)
            b = np.flatnonzero(new)
            many = at[end] + many[end] - at[b]
            k, h, at = k[b], h[b], at[b]
            yield answers(_aside(k, at), k, h, at, many, np.zeros(len(b), np.int64), pa.nulls(len(b), pa.binary()))

    def answers(to, k, h, at, many, weight, s):
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (to, k, h, at, many, weight)), s], names=["to", "k", "h", "at", "many", "weight", "s"])

    def _windows_of(hot, mz, doc, at, many, texts):
        """The strings, those of hot minimisers cut into windows that are dealt
        by their own hash."""
        is_hot = np.isin(mz, hot)
        if not is_hot.any():
            return mz, doc, at, many
        n = np.where(is_hot, many, 1)
        of = np.repeat(np.arange(len(mz)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        cut_up = is_hot[of]
        g, first = scheme.grams(*A.buffers(texts))
        start = first[:-1][doc[of]] + at[of] + step
        # a window is told by its grams at 0, gram, 2 gram, ... and at its end
        x = A.mix(mz[of].view(np.uint64))
        for shift in [*range(0, scheme.size - scheme.gram, scheme.gram), scheme.size - scheme.gram]:
            x = A.mix(x + g[start + shift])
        return np.where(cut_up, x.view(np.int64), mz[of]), doc[of], at[of] + step, np.where(cut_up, 1, many[of])

    sent = placed.join(over(lists), place).mapInArrow(A.lean(collect), "to long, k long, h long, at long, many long, weight long, s binary")

    def decide(batches):
        held, size, was = [], 0, None
        for b in batches:
            for part in A.slices([b], "s", 1 << 20):
                if size > SORT_BYTES:  # whole buckets only
                    to = part.column(0).to_numpy(zero_copy_only=False)
                    cut_at = int(np.searchsorted(to, was, side="right"))
                    if cut_at:
                        held.append(part.slice(0, cut_at))
                        part = part.slice(cut_at)
                    if part.num_rows:
                        yield from answer(held)
                        held, size = [], 0
                if part.num_rows:
                    held.append(part)
                    size += part.nbytes
                    was = part.column(0)[-1].as_py()
        yield from answer(held)

    def answer(held):
        if not held:
            return
        t = pa.Table.from_batches(held)
        to, k, h, at, many, weight = (t[c].to_numpy() for c in ("to", "k", "h", "at", "many", "weight"))
        done = np.flatnonzero(weight == 0)
        i = np.flatnonzero(weight > 0)
        out = [(k[done], h[done], at[done], many[done])]
        if len(i):
            column = t["s"].combine_chunks()
            coded = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).take(pa.array(i)).dictionary_encode()
            sid = coded.indices.to_numpy()
            i = i[np.lexsort((h[i], at[i], k[i], sid))]
            sid = np.sort(sid)
            first = np.ones(len(i), bool)
            first[1:] = sid[1:] != sid[:-1]
            head = i[first]
            total = np.bincount(sid, weight[i])
            lone = np.bincount(np.unique(to[head], return_inverse=True)[1])[np.unique(to[head], return_inverse=True)[1]] == 1
            if scheme.keep_first:
                whole = i[(k[i] != k[head][sid]) | (at[i] != at[head][sid])]
            else:
                whole = i[(total > 1)[sid]]
            out.append((k[whole], h[whole], at[whole], many[whole]))
            several = np.flatnonzero(~lone)
            if len(several):
                d = coded.dictionary.take(pa.array(several)).to_pylist()
                s, o = scheme.decide(d, k[head][several], at[head][several], total[several])
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
                b = np.flatnonzero(new)
                s, o, run = several[s[b]], o[b], np.diff(np.append(b, len(new)))
                if scheme.keep_first:
                    r = head[s]
                    out.append((k[r], h[r], at[r] + o, run))
                else:  # a string that came once has one row; others are done
                    once = total[s] == 1
                    r = head[s[once]]
                    out.append((k[r], h[r], at[r] + o[once], run[once]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "h", "start", "n"])

    spans = sent.repartition(n, "to").sortWithinPartitions("to").mapInArrow(A.lean(decide), "k long, h long, start long, n long")
    per_doc = spans.groupBy("k", "h").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return placed.join(over(per_doc), place, "left")


def _documents(k: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int, np.ndarray]:
    """Distinct (k, h), their number, and each entry's place among them."""
    order = np.lexsort((h, k))
    new = np.ones(len(k), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    at = order[new]
    return (k[at], h[at]), len(at), of


def covered(spans: list | None, size: int, total: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of units that windows of the spans cover."""
    runs: list[list[int]] = []
    for s, e in sorted((x["start"], x["start"] + x["n"] - 1 + size) for x in spans or []):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, min(e, total)) for s, e in runs]


def gaps(runs: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """What the runs leave."""
    edges = [0, *(x for r in runs for x in r), total]
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e]
