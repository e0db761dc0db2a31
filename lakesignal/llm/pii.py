"""Personal data by a semi-Markov conditional random field.

Base spans are exact pattern matches (email, ip, card, phone).  The field then
reads a window of tokens around every trigger (an at sign, an ``at``
in brackets, an email spelled with ``at`` and ``dot`` in any case, a run of seven digits with at most two
separators between them; a window reaches ``MARGIN`` characters further, and on
to the next white space within ``REACH``): candidate segments of up to
``MAX_TOKENS`` tokens are scored by features of the whole span (shape, digit
count, check sum, octets, separators, neighbours), and dynamic programming over
at most that many tokens for each entity chooses boundaries and types jointly,
over the whole window whatever its length (it holds two numbers a token).  Of
equal segmentations the one with fewer and earlier found segments is taken.
Base spans stay; segments that overlap none of them are added.

The field is trained by maximum likelihood on windows of a bounded sample of
the documents (``SAMPLE`` documents, of each the first ``TRAIN_WINDOWS``, none
of ``TRAIN_CHARS`` characters or more): their base spans are the labels, and
copies of the windows whose
email is respelled (``[at]``, `` dot ``), whose phone starts with 00 and whose
card has its groups set apart by dots carry the same labels, so that it learns
forms that the patterns miss.  Without any base span a small built-in set of
such windows is used.

Null text is empty.  Spans are code points, end exclusive.  Repeated rows are
read each; an empty table gives an empty result and a field of the built-in
windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import tuned

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
SAMPLE, TRAIN_WINDOWS, TRAIN_CHARS = 1500, 2, 400
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            low = m.end()
        else:
            low = at + 1  # no match holds this sign, so none starts before it
        at = text.find("@", max(low, at + 1))
    return out


def _digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# --- the field -----------------------------------------------------------

_TRIGGER = re.compile(r"[0-9](?:[ .()/-]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"(?i)\S{1,64} ?(?:\[at\]|\(at\)|\bat\b) ?\S{1,64} ?(?:\[dot\]|\(dot\)|\bdot\b)")
_BRACKETED = re.compile(r"(?i)[\[(]at[\])]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^\sA-Za-z0-9]")
_AT, _DOT = {"@", "at"}, {".", "dot"}
MARGIN, REACH = 24, 64


def windows(text: str) -> list[tuple[int, int]]:
    """Merged windows (start, end) around triggers."""
    marks = [m.span() for m in _TRIGGER.finditer(text)]
    at = text.find("@")
    while at >= 0:
        marks.append((at, at + 1))
        at = text.find("@", at + 1)
    low = text.lower()
    if "at]" in low or "at)" in low:
        marks += [m.span() for m in _BRACKETED.finditer(text)]
    if "dot" in low:
        marks += [m.span() for m in _SPELLED.finditer(text)]
    out: list[list[int]] = []
    for s, e in sorted(marks):
        s, e = _outward(text, s, e)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _outward(text: str, s: int, e: int) -> tuple[int, int]:
    s, e = max(0, s - MARGIN), min(len(text), e + MARGIN)
    least, most = max(0, s - REACH), min(len(text), e + REACH)
    while s > least and not text[s - 1].isspace():
        s -= 1
    while e < most and not text[e].isspace():
        e += 1
    return s, e


_PARTS = frozenset(" ().+/-")


N_FEATURES = 26


def features(kind: str, text: str, before: str, after: str) -> list[int]:
    """Indices of the binary features of a whole span."""
    d = _digits(text)
    low = text.lower()
    f = [0, 1 + min(7, max(0, len(d) - 9)) if kind != "ip" else 1]
    if before[-1:].isalnum() or before[-1:] in ("+", "@", "."):
        f.append(9)
    if after[:1].isalnum() or (after[:1] in ("@",)) or (after[:1] == "." and after[1:2].isalnum()):
        f.append(10)
    if before[-1:].isspace() or not before:
        f.append(11)
    if luhn(d) and d:
        f.append(12)
    if text.startswith("+"):
        f.append(13)
    elif text.startswith("00"):
        f.append(14)
    if re.search(r"[ (.-]", text):
        f.append(15)
    if "@" in text:
        f.append(16)
    if "[at]" in low or "(at)" in low:
        f.append(17)
    if re.search(r"\bat\b", low):
        f.append(18)
    if re.search(r"\bdot\b", low):
        f.append(19)
    if " " in text:
        f.append(20)
    if kind == "ip":
        parts = text.split(".")
        f.append(21 if all(p.isdigit() and int(p[:6]) <= 255 for p in parts) else 22)
    if re.fullmatch(r"\S+ ?(?:\[at\]|\(at\)|@| at ) ?\S+(?: ?(?:\[dot\]|\(dot\)|\.| dot ) ?\w+)+", low):
        f.append(23)
    if re.fullmatch(r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}", text):
        f.append(24)
    if re.fullmatch(r"(?:[0-9]{4}[ .-]?){3}[0-9]{2,4}", text):
        f.append(25)
    return f


def tokens(text: str) -> list[int]:
    """Token bounds of a window, with its end."""
    return [m.start() for m in _TOKEN.finditer(text)] + [len(text)]


def segments(text: str, bounds: list[int]):
    """Candidate segments (first token, last token + 1, kind) by first token.

    An email has one at, a dot, at most four blanks and no line feed, begins
    with a letter or digit and ends with letters.  The others are digits, plus
    signs, brackets, points, dashes, strokes and blanks, begin with a digit or
    a plus and end with a digit: four numbers for an ip, 12 to 19 digits for a
    card, 7 to 15 for a phone."""
    n = len(bounds) - 1
    words = [text[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]
    low = [w.lower() for w in words]
    at = np.concatenate([[0], np.cumsum([w in _AT for w in low])]).tolist()
    dot = np.concatenate([[0], np.cumsum([w in _DOT for w in low])]).tolist()
    point = np.concatenate([[0], np.cumsum([w == "." for w in words])]).tolist()
    blank = np.concatenate([[0], np.cumsum([w.isspace() for w in words])]).tolist()
    line = np.concatenate([[0], np.cumsum([w == "\n" for w in words])]).tolist()
    number = [w[0] in "0123456789" for w in words]
    digit = np.concatenate([[0], np.cumsum([len(w) if d else 0 for w, d in zip(words, number, strict=True)])]).tolist()
    for i in range(n):
        top = min(n, i + MAX_TOKENS)
        if words[i][0].isalnum() and at[top] > at[i]:
            for j in range(i + 5, top + 1):
                if at[j] - at[i] > 1 or blank[j] - blank[i] > 4 or line[j] > line[i]:
                    break
                if at[j] - at[i] == 1 and dot[j] > dot[i] and words[j - 1].isalpha():
                    yield i, j, 0
        if number[i] or words[i] == "+":
            for j in range(i + 1, top + 1):
                if not number[j - 1]:
                    if words[j - 1] in _PARTS:
                        continue
                    break
                d, p = digit[j] - digit[i], point[j] - point[i]
                if p == 3 and d >= 4:
                    yield i, j, 1
                if 12 <= d <= 19:
                    yield i, j, 2
                if 7 <= d <= 15:
                    yield i, j, 3
                if d > 19 and p > 3:
                    break


def described(text: str, bounds: list[int], i: int, j: int, k: int) -> list[int]:
    s, e = bounds[i], bounds[j]
    return features(KINDS[k], text[s:e], text[max(0, s - 2) : s], text[e : e + 2])


def lattice(text: str) -> tuple[list[int], list[tuple[int, int, int, list[int]]]]:
    """Token bounds of a window, and arcs (first token, last token + 1, kind,
    features)."""
    bounds = tokens(text)
    return bounds, [(i, j, k, described(text, bounds, i, j, k)) for i, j, k in segments(text, bounds)]


@dataclass
class Model:
    weights: np.ndarray  # kinds by features


def _scores(model: Model, arcs) -> np.ndarray:
    return np.array([model.weights[k][f].sum() for _, _, k, f in arcs])


def viterbi(n: int, arcs) -> list[tuple[int, int, int]]:
    """Segments (first token, last token + 1, kind) of the best segmentation of
    n tokens, a token outside scoring 0; ``arcs`` are (first token, last
    token + 1, kind, score) by first token, and may be a generator."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    to, t = [float("-inf")] * (n + 1), 0
    for i, j, k, score in arcs:
        while t < i:  # nothing more can end at tokens up to i
            t += 1
            best[t], back[t] = (to[t], back[t]) if to[t] > best[t - 1] else (best[t - 1], None)
        if best[i] + score > to[j]:
            to[j], back[j] = best[i] + score, (i, j, k)
    while t < n:
        t += 1
        best[t], back[t] = (to[t], back[t]) if to[t] > best[t - 1] else (best[t - 1], None)
    out = []
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            out.append(back[t])
            t = back[t][0]
    return out[::-1]


def _posterior(n: int, arcs, score: np.ndarray) -> np.ndarray:
    """Probability of each arc, by forward and backward sums over segments."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for a, (i, j, _, _) in enumerate(arcs):
        starts.setdefault(i, []).append(a)
        ends.setdefault(j, []).append(a)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        own = ends.get(t)
        fwd[t] = fwd[t - 1] if not own else np.logaddexp.reduce([fwd[t - 1], *(fwd[arcs[a][0]] + score[a] for a in own)])
    for t in range(n - 1, -1, -1):
        own = starts.get(t)
        bwd[t] = bwd[t + 1] if not own else np.logaddexp.reduce([bwd[t + 1], *(bwd[arcs[a][1]] + score[a] for a in own)])
    return np.array([np.exp(fwd[i] + score[a] + bwd[j] - fwd[n]) for a, (i, j, _, _) in enumerate(arcs)])


#: Windows used where the sample has no base span.
BUILT_IN = ("mail to ann.lee@example.com today", "host 10.0.0.12 is up", "card 4111 1111 1111 1111 ok", "call +1 (212) 555-0100 now", "order 1234567890123456 sent", "build 2024.10.31.5 of 20241031")


def _respelled(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """Copies of a window with one span written another way."""
    out = []
    for kind, s, e in spans:
        x = text[s:e]
        forms = {
            "email": [re.sub(r"\.(?=[^.@]*$)", " dot ", x.replace("@", " at ")), re.sub(r"\.(?=[^.@]*$)", "[dot]", x.replace("@", "[at]")), x.replace("@", " (at) "), x.replace("@", " [at] ")],
            "phone": ["00" + x[1:]],
            "card": [".".join(_digits(x)[i : i + 4] for i in range(0, len(_digits(x)), 4))],
        }.get(kind, [])
        out += [(text[:s] + y + text[e:], [(kind, s, s + len(y))]) for y in forms]
    return out


def _gold(text: str, spans: list[Span]) -> tuple | None:
    bounds, arcs = lattice(text)
    at = {b: i for i, b in enumerate(bounds)}
    want = {(at.get(s), at.get(e), KINDS.index(k)) for k, s, e in spans}
    gold = [a for a, (i, j, k, _) in enumerate(arcs) if (i, j, k) in want]
    taken, own = 0, []
    for a in sorted(gold, key=lambda a: arcs[a][:2]):
        if arcs[a][0] >= taken:
            own.append(a)
            taken = arcs[a][1]
    return (len(bounds) - 1, arcs, own) if arcs else None


def fit_windows(samples: list[tuple[str, list[Span]]], steps: int = 30) -> Model:
    """Maximum likelihood with an L2 penalty, by scaled gradient ascent."""
    if not any(spans for _, spans in samples):
        samples = samples + [(x, base_spans(x)) for x in BUILT_IN]
    samples = samples + [y for t, spans in samples for y in _respelled(t, spans)]
    data = [g for t, spans in samples if (g := _gold(t, spans))]
    w, gain = np.full((len(KINDS), N_FEATURES), 0.0), np.full((len(KINDS), N_FEATURES), 1e-8)
    w[:, 0] = -2.0
    model = Model(w)
    for _ in range(steps):
        g = -0.5 * w
        for n, arcs, gold in data:
            p = -_posterior(n, arcs, _scores(model, arcs))
            p[gold] += 1
            for x, (_, _, k, f) in zip(p, arcs, strict=True):
                if abs(x) > 1e-4:
                    g[k, f] += x
        gain += g * g
        w += 1.0 * g / np.sqrt(gain)
    return model


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Train on the windows of about ``sample`` documents, chosen by a hash of
    their id: of each the first ``TRAIN_WINDOWS``, if under ``TRAIN_CHARS``."""
    tuned(df.sparkSession)
    total = df.count()
    share = min(1.0, sample / max(1, total))
    rows = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(text).alias("text"))

    def run(batches):
        for b in A.slices(batches, "text"):
            out = []
            for t in b.column(0).to_pylist():
                base = base_spans(t or "")
                for s, e in [x for x in windows(t or "") if x[1] - x[0] < TRAIN_CHARS][:TRAIN_WINDOWS]:
                    own = [(k, x - s, y - s) for k, x, y in base if s <= x and y <= e]
                    out.append((t[s:e], [k for k, _, _ in own], [x for _, x, _ in own], [y for _, _, y in own]))
            if out:
                a, k, x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k, pa.list_(pa.string())), pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))], names=["w", "k", "s", "e"])

    got = rows.mapInArrow(A.lean(run), "w string, k array<string>, s array<int>, e array<int>").collect()
    return fit_windows(sorted((r["w"], list(zip(r["k"], r["s"], r["e"], strict=True))) for r in got))


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans."""
    text = text or ""
    base = base_spans(text)
    known, added = set(base), []
    for a, e in windows(text):
        part = text[a:e]
        bounds = tokens(part)

        def scored(part=part, bounds=bounds, a=a):
            for i, j, k in segments(part, bounds):
                certain = 1e6 if (KINDS[k], a + bounds[i], a + bounds[j]) in known else 0.0
                yield i, j, k, float(model.weights[k][described(part, bounds, i, j, k)].sum()) + certain

        for i, j, k in viterbi(len(bounds) - 1, scored()):
            s, t = a + bounds[i], a + bounds[j]
            if not any(x < t and s < y for _, x, y in base):
                added.append((KINDS[k], s, t))
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect(df: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with the spans found: structs of kind, start, end, base."""
    base_df = df.drop(out)
    return _reading(base_df, model, text, base_df.withColumn(out, F.lit(None).cast(_SPANS)).schema, out)


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in capitals and
    brackets; overlapping spans are replaced as one.  A null text stays null."""
    return _reading(df, model, text, df.schema, None)


def _reading(df: DataFrame, model: Model, text: str, schema, out: str | None) -> DataFrame:
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    names = df.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in A.slices(batches, text):
            texts = b.column(names.index(text)).to_pylist()
            if out is None:
                new = pa.array([t and masked(t, find(t, sent.value)[1]) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text else b.column(i) for i, c in enumerate(names)], names=names)
                continue
            found = []
            for t in texts:
                own, every = find(t, sent.value)
                own_set = set(own)
                found.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own_set} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, out])

    return df.mapInArrow(A.lean(run), schema)


def masked(text: str, spans: list[Span]) -> str:
    at, parts = 0, []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if parts else text


def digests(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans by kind, a digest of the base spans, and all spans."""
    found = detect(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), model, "text")
    base = F.filter("pii", lambda x: x["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
