"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Each partition runs its own in-memory DuckDB.  A recursive query holds one row
for each token position of each distinct word (``spot`` is the word's number
and the position); every step joins neighbouring tokens with the merge table,
contracts each word's leftmost pair of least rank and marks the words that have
none as done; those leave the recursion.  Decoding joins tokens with the
vocabulary and concatenates their bytes in an ordered aggregation.

Words are the matches of the split pattern; every distinct word of a slice of
texts goes through the query, those that are a token themselves included.  The
first words seen are remembered, up to ``MEMORY`` bytes; no result depends on it.

Words over ``LONG`` bytes are first cut between two bytes that no token holds
side by side, which no merge can cross.  What is still longer goes through a
second query, whose step contracts all occurrences of the least pair that do
not overlap, leftmost first.  That is the same as one at a time, as a token's
bytes by themselves merge into that token alone (true of ranks made by merging;
tested for the file): so no contraction gives a pair of lesser rank.  A word
takes as many steps as it uses different merges, not as it has bytes.

Null text counts as empty: no tokens, empty decoded text.  Repeated rows are
encoded each; texts of any length are encoded whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import tuned

#: Bytes of text that are encoded at a time; bytes, by estimate, of what a
#: worker remembers of words; bytes of distinct words in one recursive query;
#: bytes of a word that is contracted one pair at a step.
SLICE, MEMORY, QUERY_BYTES, LONG = 4 << 20, 96 << 20, 200_000, 48

# Plain characters by kind, as the split pattern's classes have them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = "!-/:-@\\[-`{-~\u00a1\u00ab\u00b0\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026\u20ac"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9 \t\n\r]*")

ENCODE = """
WITH RECURSIVE step(spot, tok, done) AS (
    SELECT spot, tok, false FROM bytes
  UNION ALL
    (WITH live AS (SELECT spot, tok FROM step WHERE NOT done),
     least AS (SELECT l.spot >> 32 AS w, min(m.id << 32 | (l.spot & 4294967295)) AS low
               FROM live l JOIN live r ON r.spot = l.spot + 1 JOIN merges m ON m.pair = (l.tok << 32 | r.tok) GROUP BY 1),
     aimed AS (SELECT spot, tok, w << 32 | (low & 4294967295) AS here, low >> 32 AS id FROM live LEFT JOIN least ON w = spot >> 32)
     SELECT CASE WHEN spot > here THEN spot - 1 ELSE spot END, CASE WHEN spot = here THEN id ELSE tok END, here IS NULL
     FROM aimed WHERE spot IS DISTINCT FROM here + 1)
)
SELECT spot, tok FROM step WHERE done ORDER BY spot
"""
ENCODE_LONG = """
WITH RECURSIVE step(spot, nxt, tok, done) AS (
    SELECT spot, spot + 1, tok, false FROM bytes
  UNION ALL
    (WITH live AS MATERIALIZED (SELECT spot, nxt, tok FROM step WHERE NOT done),
     pairs AS MATERIALIZED (SELECT l.spot, l.nxt, r.nxt AS after, m.id, l.tok = r.tok AS twin
               FROM live l JOIN live r ON r.spot = l.nxt JOIN merges m ON m.pair = (l.tok << 32 | r.tok)),
     least AS MATERIALIZED (SELECT spot >> 32 AS w, min(id) AS id FROM pairs GROUP BY 1),
     hits AS MATERIALIZED (SELECT p.* FROM pairs p JOIN least ON w = spot >> 32 AND least.id = p.id),
     twins AS (SELECT *, lag(nxt) OVER (ORDER BY spot) IS DISTINCT FROM spot AS head FROM hits WHERE twin),
     runs AS (SELECT *, sum(head::INT) OVER (ORDER BY spot) AS run FROM twins),
     picked AS MATERIALIZED (SELECT spot, nxt, after, id FROM hits WHERE NOT twin UNION ALL
               SELECT spot, nxt, after, id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY spot) AS n FROM runs) WHERE n % 2 = 1)
     SELECT l.spot, coalesce(p.after, l.nxt), coalesce(p.id, l.tok), a.w IS NULL
     FROM live l LEFT JOIN picked p ON p.spot = l.spot ANTI JOIN picked q ON q.nxt = l.spot LEFT JOIN least a ON a.w = l.spot >> 32)
)
SELECT spot, tok FROM step WHERE done ORDER BY spot
"""
DECODE = "SELECT t.w AS w, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS b FROM tokens t JOIN vocab v ON v.id = t.tok GROUP BY t.w ORDER BY t.w"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_form(pattern: str) -> re.Pattern | None:
    """The pattern over plain characters, its classes spelled out; None if it
    has others than letters, numbers and white space."""
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[{_MARKS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in p or "&&" in p else re.compile(p)


class Codec:
    """The vocabulary in DuckDB, with the bounded memory of words."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern, self.plain = regex.compile(pattern), plain_form(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, id_ = np.array(pairs, np.int64).T
        merges = pa.table({"pair": left << 32 | right, "id": id_})
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "hex": [t.hex() for t in self.ranks]})
        for name, t in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", t)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.inner = np.zeros((256, 256), bool)  # bytes that some token holds side by side
        for t in self.ranks:
            b = np.frombuffer(t, np.uint8)
            self.inner[b[:-1], b[1:]] = True
        self.text = [str(i) for i in range(1 + max(self.ranks.values()))]
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.size = 0

    def _parts(self, word: bytes) -> list[bytes]:
        """A long word cut where no merge can cross."""
        b = np.frombuffer(word, np.uint8)
        at = [0, *(np.flatnonzero(~self.inner[b[:-1], b[1:]]) + 1).tolist(), len(word)]
        return [word[s:e] for s, e in zip(at, at[1:], strict=False)]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct words, by the recursive queries."""
        cut = {w: self._parts(w) for w in words if len(w) > LONG}
        todo = list({*words, *chain.from_iterable(cut.values())}.difference([w for w, own in cut.items() if len(own) > 1], [b""])) if cut else [w for w in words if w]
        size = np.fromiter(map(len, todo), np.int64, len(todo))
        order = np.argsort(size, kind="stable")
        todo, size = [todo[i] for i in order.tolist()], size[order]
        short, upto, done = int(np.searchsorted(size, LONG, side="right")), np.cumsum(size), {b"": ()}
        at = 0
        while at < len(todo):
            long = at >= short
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + QUERY_BYTES, side="right")))
            end = end if long else min(end, short)
            part, length = todo[at:end], size[at:end]
            w = np.repeat(np.arange(len(part)), length)
            pos = np.arange(len(w)) - np.repeat(np.cumsum(length) - length, length)
            tok = self.byte[np.frombuffer(b"".join(part), np.uint8)]
            self.db.register("bytes", pa.table({"spot": w << 32 | pos, "tok": tok}))
            got = self.db.execute(ENCODE_LONG if long else ENCODE).fetchnumpy()
            self.db.unregister("bytes")
            cuts = np.searchsorted(got["spot"] >> 32, np.arange(len(part) + 1)).tolist()
            ids = tuple(got["tok"].tolist())
            done.update(zip(part, [ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], strict=True))
            at = end
        for w, own in cut.items():
            if len(own) > 1:
                done[w] = tuple(chain.from_iterable(map(done.__getitem__, own)))
        return [done[w] for w in words]

    def decode_lists(self, lists: list) -> list[bytes]:
        """Bytes of each list of ids, by the ordered aggregation."""
        length = np.array([len(x) for x in lists], np.int64)
        out, at = [b""] * len(lists), 0
        upto = np.cumsum(length)
        while at < len(lists):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * QUERY_BYTES, side="right")))
            n = length[at:end]
            w = np.repeat(np.arange(at, end), n)
            pos = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            self.db.register("tokens", pa.table({"w": w, "pos": pos, "tok": np.fromiter(chain.from_iterable(lists[at:end]), np.int64, int(n.sum()))}))
            for i, b in self.db.execute(DECODE).fetchall():
                out[i] = b
            self.db.unregister("tokens")
            at = end
        return out

    def words(self, text: str) -> list[str]:
        """The matches of the split pattern."""
        return (self.plain if self.plain and _PLAIN.fullmatch(text) else self.pattern).findall(text)

    def round_trips(self, texts: list[str | None]) -> list[tuple[str, bytes]]:
        """Decimal ids joined by a blank, and the decoded bytes, of each text."""
        cut = [self.words(x) if x else [] for x in texts]
        every = set().union(*cut)
        fresh = list(every.difference(self.ids))
        lists = self.encode_words([w.encode() for w in fresh])
        text = self.text
        new = dict(zip(fresh, [" ".join([text[i] for i in x]) for x in lists], strict=True))
        back = dict(zip(fresh, self.decode_lists(lists), strict=True))
        known = every.intersection(self.ids)
        ids, raw = ({w: m[w] for w in known} | n for m, n in ((self.ids, new), (self.raw, back)))
        for w, x in new.items():
            if self.size >= MEMORY:
                break
            self.ids[w], self.raw[w] = x, back[w]
            self.size += len(w) + len(x) + len(back[w]) + 350
        return [(" ".join(map(ids.__getitem__, own)), b"".join(map(raw.__getitem__, own))) for own in cut]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text (array of int)."""
    tuned(df.sparkSession)
    base = df.drop(out)
    names = base.columns
    schema = base.withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches):
        c = codec(path, pattern)
        for b in A.slices(batches, text, SLICE):
            ids = [np.array(x.split(), np.int32) for x, _ in c.round_trips(b.column(names.index(text)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, out])

    return base.mapInArrow(A.lean(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of ids stands for (binary; a null
    list is empty).  An id outside the vocabulary is an error."""
    base = df.drop(out)
    names = base.columns
    schema = base.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches):
        c = codec(path, pattern)
        known = set(c.ranks.values())
        for b in batches:
            lists = [x or [] for x in b.column(names.index(ids)).to_pylist()]
            if not known.issuperset(chain.from_iterable(lists)):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.decode_lists(lists), pa.binary())], names=[*names, out])

    return base.mapInArrow(A.lean(run), schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts, and digests of the ids and of the decoded bytes."""
    tuned(df.sparkSession)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        c = codec(path, pattern)
        for b in A.slices(batches, "text", SLICE):
            got = c.round_trips(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([a.count(" ") + 1 if a else 0 for a, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(a.encode()).hexdigest() for a, _ in got]),
                    pa.array([hashlib.sha256(x).hexdigest() for _, x in got]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(A.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
