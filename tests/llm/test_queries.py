"""The registered queries themselves, on the smallest tables, against plain versions;
and columns with clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakesignal.llm import bpe, langid, minhash, packing, pii, queries, simhash, superkmer, toxicity
from test_operators import plain_simhash, plain_suffix, plain_words, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def got(spark):
    known = entry.queries()
    held = {}

    def of(name):
        if name not in held:
            held[name] = known[name](spark, SF).collect()
        return held[name]

    return of


def by(got, *columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in got)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and "op4_nearest" in entry.oracle_sql()


def test_op1(got, rows):
    order, want = sorted(rows, key=lambda r: -r[0]), []
    for i, (d, t) in enumerate(order):
        cut = len(t) // 3
        want.append((d, len(t), sha(t[: len(t) - cut] + order[(i + 1) % len(order)][1][:cut])))
    assert by(got("op1_minhash"), "doc_id", "n_chars", "edited_sha256") == sorted(tuple(map(repr, w)) for w in want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got("op1_minhash"))


def test_op2_op9(got, rows):
    assert by(got("op2_substring_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_words(rows)
    assert by(got("op9_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_suffix(rows, 100)


def test_op3_op7(got, rows):
    three, seven = got("op3_language_id"), got("op7_toxicity")
    assert len(three) == len(seven) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in three)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in seven)


def test_op4(spark, got):
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = []
    for q in (i for i in v if i % 20 == 0):
        s = sorted((-float((v[q] * v[i]).sum()), i) for i in v if i != q)[:20]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(s)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got("op4_nearest")) == sorted(want)


def test_op5(got, rows):
    assert {r.doc_id: r.fingerprint for r in got("op5_simhash")} == {d: f"{plain_simhash(t):016x}" for d, t in rows}
    assert all(r.component_id <= r.doc_id for r in got("op5_simhash"))


def test_op6(got, rows):
    texts = dict(rows)
    for r in got("op6_pii"):
        base = pii.base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def test_op8(got, rows):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(queries.WORD_BPE), []
    for d, x in rows:
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        want += [tuple(map(repr, (d, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())))) for k, s in enumerate(range(0, len(ids), 2048))]
    assert by(got("op8_packing"), "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want)


def test_op10(got, rows):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BYTE_BPE), special_tokens={})
    want = sorted(tuple(map(repr, (d, len(ids), sha(" ".join(map(str, ids))), sha(t)))) for d, t in rows for ids in [enc.encode_ordinary(t)])
    assert by(got("op10_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_columns_with_clashing_names(spark, rows):
    names = ["k", "h", "row", "spans", "part", "parts", "places", "p", "b", "s", "at", "to", "key", "tie", "bucket", "edge", "simhash", "mark", "root", "n", "score", "lang_pred", "pii", "ids", "fingerprint", "offending", "y", "w"]
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    model = langid.fit(docs.withColumn("lang", F.lit("en")), F.lit(True))
    n = docs.count()
    cut = superkmer.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.where(F.col("places") != names.index("places")).count() == 0 and cut.count() == n
    assert langid.identify(docs, model).where("lang_pred <> 'en'").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")), F.lit(True))).count() == n
    assert pii.redact(docs, pii.fit(docs)).columns == docs.columns and pii.detect(docs, pii.fit(docs)).count() == n
    assert minhash.fingerprint(docs).count() == minhash.edited_pairs(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n and packing.pack_documents(docs, queries.WORD_BPE).count() >= n
    assert bpe.encode(docs, queries.BYTE_BPE, "\\S+").count() == n
