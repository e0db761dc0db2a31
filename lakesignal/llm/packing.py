"""Best-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and a closing id.  Longer documents are cut into
full sequences and a last piece.  Pieces are packed by bounded-space online
best-fit: a fixed number of bins is open; a bitset keyed by free space finds
the tightest bin that still takes a piece; if none does and all bins are open,
the fullest closes first.

Pieces (not texts or ids) are dealt by a hash into packing groups of about
``GROUP`` pieces, each packed by itself in a fixed order, so a repeated task
gives the same result.  At most ``OPEN`` bins of a group stay partly filled.
Null text counts as empty (the closing id only); repeated rows are packed each;
texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _arrays as A
from ._spark import materialize, tuned

LENGTH, CLOSING = 2048, 0
OPEN = 256
GROUP = 30_000
#: Bytes of text that are encoded at a time; bytes, by estimate, of the units'
#: ids that a worker remembers.
SLICE, MEMORY = 4 << 20, 32 << 20

# Characters whose normal form and kind depend on nothing around
# them, and the tokenizer's split pattern over them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = "!-/:-@\\[-`{-~\u00a1\u00ab\u00b0\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026\u20ac"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9 \t\n\r]*")
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


def byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable Latin-1
    bytes are their own, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(rest)) for i in range(256)]


class WordIds:
    """Ids of texts by a tokenizer that composes, lower-cases, drops white space
    and merges byte letters within the matches of its split pattern.

    A text of plain characters (see the fixed values) is lower-cased and split
    here, and each distinct unit of a call goes through the merges once.  Other
    texts are cut at blanks, which no token crosses: plain pieces as before,
    any other piece is encoded whole by the tokenizer.  So are pieces with the
    string of a special token, which is that token, as the library has it
    (``special=False``: ordinary text).  The first units seen are remembered,
    up to ``MEMORY`` bytes; no result depends on it.
    """

    def __init__(self, path: str, special: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(added)) if added else None
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not (self.added and "<" in text and self.added.search(text))

    def _units(self, text: str) -> list[str]:
        """Keys of a text's ids: units, and pieces to be encoded whole behind a NUL."""
        if self._plain(text):
            return _UNIT.findall(text.lower())
        out: list[str] = []
        for piece in text.split(" "):
            if self._plain(piece):
                out += _UNIT.findall(piece.lower())
            else:
                out.append("\0" + piece)
        return out

    def _encoded(self, keys: list[str]) -> dict[str, bytes]:
        tokenize, four, letters, join = self.tokenizer.model.tokenize, self.bytes, self.letters, b"".join
        out = {}
        for key in keys:
            if key[0] == "\0":
                ids = self.tokenizer.encode(key[1:], add_special_tokens=False).ids
                out[key] = join([four[i] for i in ids])
            else:
                own = tokenize(key if key.isascii() else key.encode().decode("latin-1").translate(letters))
                out[key] = four[own[0].id] if len(own) == 1 else join([four[x.id] for x in own])
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self._units(x) if x else [] for x in texts]
        every = set().union(*cut)
        fresh = self._encoded(list(every.difference(self.known)))
        now = self.known | fresh if len(self.known) < len(every) else {x: self.known[x] for x in every.intersection(self.known)} | fresh
        out = [b"".join(map(now.__getitem__, x)) for x in cut]
        for x, ids in fresh.items():
            if self.size >= MEMORY:
                break
            self.known[x] = ids
            self.size += len(x) + len(ids) + 180
        return out


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document."""
    tuned(df.sparkSession)
    end = np.array([closing], "<u4").tobytes()

    def run(batches):
        encode = word_ids(path)
        for b in A.slices(batches, "text", SLICE):
            keys = b.column(0)
            row, piece, start, size, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[s : s + 4 * length]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(A.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Bounded-space online best-fit.  ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int = LENGTH, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if a bin with f free places is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.count = 0

    def _put(self, b: int, left: int) -> None:
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.open += 1

    def _take(self, left: int) -> int:
        own = self.bins[left]
        b = own.pop()
        if not own:
            self.free ^= 1 << left
        self.open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        fit = self.free >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = self._take(left)
        else:
            if n < self.capacity and self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            b, left = self.count, self.capacity
            self.count += 1
        self._put(b, left - n)
        return b, self.capacity - left


def pack(rows: DataFrame, capacity: int = LENGTH, most: int = OPEN, group: int = GROUP) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    n = max(1, -(-rows.count() // group))
    dealt = rows.repartitionById(n, F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)).cast("int"))
    ordered = dealt.sortWithinPartitions(F.xxhash64("piece", "doc_id"), "doc_id", "piece", "length", "ids_crc32")

    def run(batches):
        fit, base = BestFit(capacity, most), TaskContext.get().partitionId() << 40
        for b in batches:
            at = [fit.place(x) for x in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in at], pa.int64()), pa.array([x for _, x in at], pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    return ordered.mapInArrow(A.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Tokenise, cut and pack every document."""
    return pack(materialize(pieces(df, path, key, text, length), "pieces"), length)
