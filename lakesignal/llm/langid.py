"""Language identification by hierarchical discrimination.

A softmax classifier first predicts the language family; within the family,
one-versus-one linear support vector machines separate the related languages
and vote.  Features are square roots of the relative frequencies of hashed
byte 1- to 3-grams of the lower-cased letters.

``fit`` reads at most about ``per_language`` labelled texts of each language
(chosen by a hash of their id), features being made on the executors; only
those rows of ``DIM`` half floats reach the driver.  Null or letterless text
is ``und`` with score 0; with no labelled text everything is ``und``.

Within a family the most votes win, ties going to the greater sum of the
pairs' probabilities and then to the first language by name.  Repeated rows
count and are predicted each; texts of any length are read whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import tuned

DIM = 4096
PER_LANGUAGE = 800
UND = "und"
#: Language families by ISO 639-1 code; a code not listed is a
#: family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of unit length (zero for texts without letters)."""
    folded = [b" " + b" ".join((x or "").lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" " for x in texts]
    data = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in folded])
    one = (data * np.uint32(2654435761)) >> np.uint32(20)
    two, three = one.copy(), one.copy()
    if len(data) > 2:
        two[:-1] = ((data[:-1] * np.uint32(0x9E3779B1)) ^ (data[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        x = (data[:-2] * np.uint32(0x27D4EB2F) + data[1:-1]) * np.uint32(0x165667B1) + data[2:]
        three[:-2] = ((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(20)
    out = np.zeros((len(texts), DIM), np.float32)
    begin = 0
    for i, end in enumerate(ends):
        if end - begin > 2:
            parts = np.concatenate([one[begin + 1 : end - 1], two[begin : end - 1], three[begin : end - 2]])
            out[i] = np.sqrt(np.bincount(parts, minlength=DIM))
        begin = end
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages of each family
    softmax: np.ndarray  # DIM + 1 by families
    pairs: list[tuple[int, int, int]]  # family, language a, language b
    svm: np.ndarray  # DIM + 1 by pairs
    slope: np.ndarray  # of each pair's margin to log odds

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        spoken = np.array([has_letter(x) for x in texts])
        if not self.families or not len(texts):
            return [UND] * len(texts), np.zeros(len(texts))
        x = features(texts)
        z = x @ self.softmax[:-1] + self.softmax[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        margins = x @ self.svm[:-1] + self.svm[-1] if self.pairs else np.zeros((len(texts), 0))
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        for f, names in enumerate(self.members):
            rows = np.flatnonzero((best == f) & spoken)
            votes, sure = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.ones((len(rows), len(names)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margins[rows, k]
                    q = 1 / (1 + np.exp(-np.clip(self.slope[k] * m, -40, 40)))
                    votes[:, a] += m > 0
                    votes[:, b] += m <= 0
                    sure[:, a] += q
                    sure[:, b] += 1 - q
                    least[:, a] = np.minimum(least[:, a], q)
                    least[:, b] = np.minimum(least[:, b], 1 - q)
            won = (votes + sure / (1 + sure.sum(axis=1, keepdims=True))).argmax(axis=1) if len(rows) else rows
            for i, w in zip(rows, won, strict=True):
                lang[i] = names[w]
            score[rows] = p[rows, f] * least[np.arange(len(rows)), won]
        return lang, np.clip(score, 0, 1)


def _descend(x: np.ndarray, grad, width: int, steps: int = 150, rate: float = 2.0) -> np.ndarray:
    """Full-batch descent with Nesterov momentum; the last row is the bias."""
    w, v = np.zeros((x.shape[1] + 1, width), np.float32), np.zeros((x.shape[1] + 1, width), np.float32)
    for _ in range(steps):
        ahead = w + np.float32(0.9) * v
        g = grad(x @ ahead[:-1] + ahead[-1]).astype(np.float32)
        d = np.vstack([(g.T @ x).T + np.float32(1e-4) * ahead[:-1], g.sum(axis=0)])
        v = np.float32(0.9) * v - np.float32(rate) * d
        w = w + v
    return w


def fit_arrays(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    families = sorted({family(n) for n in names})
    members = [[n for n in names if family(n) == f] for f in families]
    y = np.array([families.index(family(n)) for n in langs])
    x = x.astype(np.float32)

    def softmax_grad(z):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        return p / len(y)

    soft = _descend(x, softmax_grad, len(families), rate=30.0, steps=250) if len(families) > 1 else np.zeros((x.shape[1] + 1, 1))
    pairs, ws, slopes = [], [], []
    of = np.array(langs)
    for f, own in enumerate(members):
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                rows = np.flatnonzero((of == own[a]) | (of == own[b]))
                t = np.where(of[rows] == own[a], 1.0, -1.0)[:, None]
                share = np.where(t > 0, 0.5 / (t > 0).sum(), 0.5 / (t < 0).sum())  # either language weighs the same
                w = _descend(x[rows], lambda z, t=t, s=share: -2 * s * t * np.maximum(0, 1 - t * z), 1)  # squared hinge
                m = ((x[rows] @ w[:-1] + w[-1]) * t)[:, 0]
                grid = np.geomspace(0.5, 32, 25)
                slopes.append(float(grid[np.argmin([np.logaddexp(0, -s * m).mean() + 1e-4 * s for s in grid])]))
                pairs.append((f, a, b))
                ws.append(w[:, 0])
    return Model(families, members, soft.astype(np.float32), pairs, np.array(ws, np.float32).T if ws else np.zeros((x.shape[1] + 1, 0), np.float32), np.array(slopes))


def fit(df: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on rows where ``usable`` holds and ``lang`` is not null."""
    tuned(df.sparkSession)
    rows = df.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Model([], [], np.zeros((DIM + 1, 0)), [], np.zeros((DIM + 1, 0)), np.zeros(0))
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 20))))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < limit).select("text", "lang")

    def made(batches):
        for b in A.slices(batches, "text"):
            texts = b.column("text").to_pylist()
            x = features(texts).astype(np.float16)
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(keep, pa.int64())), pa.array([x[i].tobytes() for i in keep], pa.binary())], names=["lang", "x"])

    got = sorted(((r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(A.lean(made), "lang string, x binary").collect()))
    if not got:
        return Model([], [], np.zeros((DIM + 1, 0)), [], np.zeros((DIM + 1, 0)), np.zeros(0))
    return fit_arrays(np.array([np.frombuffer(x, np.float16) for _, x in got], np.float32), [x for x, _ in got])


def identify(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score."""
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # DIM rows for each family and pair of languages
    base = df.drop(pred, score)
    names = base.columns
    schema = base.withColumn(pred, F.lit("").cast("string")).withColumn(score, F.lit(0.0).cast("double")).schema

    def run(batches):
        for b in A.slices(batches, text):
            lang, p = sent.value.predict(b.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*names, pred, score])

    return base.mapInArrow(A.lean(run), schema)
