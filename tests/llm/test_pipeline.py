"""The pipeline's stages on the smallest documents, against what they promise."""

from collections import Counter

import corpus_pipeline as P
from lakesignal.llm import pii
from lakesignal.llm.queries import WORD_BPE
from test_operators import plain_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = P.language(spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() > 0.95 * docs.count()
    two = P.near_copies(spark, one, SF).cache()
    kept = {r.doc_id for r in two.collect()}
    marks = {d: plain_simhash(texts[d], 5) for d in (r.doc_id for r in one.collect())}
    for a in marks:
        near = [b for b in marks if (marks[a] ^ marks[b]).bit_count() <= 7]
        assert (a in kept) or any(b < a for b in near)
        assert not (a in kept and any(b in kept and b < a for b in near))
    three = P.passages(spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} == kept
    words = {r.doc_id: r.text.encode().split() for r in two.collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in three.collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r.text.encode().split() == [x for j, x in enumerate(w) if j not in gone]
        assert r.n_chars == len(r.text)
    four = P.personal_data(spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == len(kept)
    assert not any(pii.base_spans(r.text) for r in four.collect())
    five = P.sequences(spark, four, SF).collect()
    assert {r.doc_id for r in five} == kept and max(r.offset + r.length for r in five) <= 2048
    assert [n for n, _ in P.STAGES] == ["language", "near_copies", "passages", "personal_data", "sequences"] and WORD_BPE


def test_run_with_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows through run(); nothing crashes, and what goes is what the stages say."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    text = rows[0][1]
    rows += [rows[3], rows[3], (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", None, None, 5), (None, text, "en", None, None), (9004, text, None, None, None), (9005, "mail ann.lee@example.com " + rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {9001, 9002, 9003}.isdisjoint(r.doc_id for r in got) and None in {r.doc_id for r in got}
    assert len([r for r in got if r.doc_id == rows[3][0] and r.piece == 0]) <= 1
    assert not {9004, rows[0][0]} <= {r.doc_id for r in got}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
