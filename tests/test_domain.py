"""Record parsing, the lake, the stream and the statistics on synthetic input."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lakesignal.functions import records as R
from lakesignal.operators import checks, lake, matching, spikes
from lakesignal.operators import statistics as T
from lakesignal.sources import archive
from lakesignal.streaming import monitor


def raw(i, **over):
    row = [""] * 27
    fields = {"id": f"20260930120000-{i}", "ts": "20260930120000", "domain": "www.Site1.RU", "url": f"https://site1.ru/{i}", "themes": "MILITARY,10;TAX_WEAPONS_MISSILE,22;EDUCATION,5", "places2": "1#Lithuania#LH#LH#55#24#LH#0", "persons1": "a b;c d", "persons2": "A B,10;Smith, J,12", "tone": "-3.5,1,4.5", "extras": "<PAGE_TITLE> T &amp; U </PAGE_TITLE>"} | over
    for k, v in fields.items():
        row[R.COLUMN[k]] = v
    return row


def put(root, feed, day, stamp, rows, tail=b""):
    at = root / f"feed={feed}" / f"dt={day}"
    at.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(at / f"{stamp}.zip", "w") as z:
        z.writestr("x.csv", "\n".join("\t".join(r) for r in rows).encode() + tail)


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rows = [raw(1), raw(2, places2="", places1="1#Riga#LG#LG#56#24#LG", translation="srclc:rus;eng:x", domain="delfi.lv"), raw(3, places2="1#Paris#FR#FR#1#2#FR", tone="n/a,1"), raw(1, url="https://site1.ru/other")]
    put(root, "en", "20260930", "20260930120000", [*rows, ["short"] * 5], b"\n\xff\xfe")
    put(root, "tr", "20260930", "20260930121500", [raw(1), raw(4, extras='"quoted\ttab" none', tone="")])
    return R.parse(archive.read_archive(spark, str(root))).cache()


def test_parse(parsed):
    rows = {(r.id[-1], r.url, r.feed): r for r in parsed.collect()}
    assert len(rows) == 6
    a = rows["1", "https://site1.ru/1", "en"]
    assert (a.domain, a.group, a.title, a.tone, a.lang) == ("www.site1.ru", "ru_by", "T & U", -3.5, "eng")
    assert a.countries == ["LH"] and a.about_baltic and a.security
    assert a.themes == ["EDUCATION", "MILITARY", "TAX_WEAPONS_MISSILE"] and a.persons == ["A B", "Smith, J"]
    b = rows["2", "https://site1.ru/2", "en"]
    assert b.group == "baltic_rus" and b.countries == ["LG"] and b.lang == "rus"
    c = rows["3", "https://site1.ru/3", "en"]
    assert c.tone is None and not c.about_baltic
    d = rows["4", "https://site1.ru/4", "tr"]
    assert d.title == "" and d.tone is None


def test_lake(spark, parsed, tmp_path):
    lake.write(parsed, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/articles").count() == 4  # one repeat, one not relevant
    assert spark.read.parquet(f"{tmp_path}/domain_day").agg(F.sum("n_rows")).first()[0] == 6
    assert (tmp_path / "series_15m" / "_SUCCESS").exists()
    assert spark.read.parquet(f"{tmp_path}/series_15m").agg(F.sum("count")).first()[0] == 4


def test_archive_days_and_mirror(spark, tmp_path):
    for day in ("20260929", "20260930"):
        put(tmp_path, "en", day, f"{day}000000", [raw(1)])
    assert archive.read_archive(spark, str(tmp_path), "20260930").count() == 1
    wanted = archive.jobs(spark, spark.createDataFrame([("20260930000000",), ("20260930001500",), ("20261001000000",)], "slot string"))
    have = spark.createDataFrame([("en", "20260930000000")], "feed string, slot string")
    got = archive.outcomes(archive.mirror(wanted, have, lambda f, s: None if f == "tr" else b"x", "20261001000000")).collect()
    assert {r.outcome: r.n for r in got} == {"stored": 1, "missing": 2}


def test_sheets_and_lines(spark, tmp_path):
    archive.write_sheet(spark.createDataFrame([("1", ""), ("2", "y")], "item string, label string"), f"{tmp_path}/s")
    assert sorted(map(tuple, archive.read_sheet(spark, f"{tmp_path}/s").collect())) == [("1", ""), ("2", "y")]
    (tmp_path / "l.json").write_text('{"slot": "20260930000000", "n": 1}\nnot json\n')
    assert archive.read_lines(spark, f"{tmp_path}/l.json", "slot string, n int").count() == 1


def messages(slot, n, feeds=("en", "tr"), announce=None):
    out = [{"kind": "article", "slot": slot, "feed": f, "id": str(i), "url": "u", "about": True, "security": i % 2 == 0, "group": "other", "ids": None, "sent_at": None} for f in feeds for i in range(n)]
    return out + [{"kind": "done", "slot": slot, "feed": f, "id": None, "url": None, "about": None, "security": None, "group": None, "ids": n if announce is None else announce, "sent_at": 1.0} for f in feeds]


def run(ms, **kw):
    a = monitor.Assembler(**kw)
    return a, [x for m in ms for x in a.add(m)]


def test_assembler_rules():
    one, two = "20260930000000", "20260930001500"
    a, out = run(messages(one, 3) + messages(one, 3) + messages(two, 1))
    assert [(x["slot"], x["rows"], json.loads(x["security"])) for x in out] == [(one, 6, {"other": 4}), (two, 2, {"other": 2})]
    late = monitor.Assembler()
    late.closed = two
    assert late.add(messages(one, 1)[0]) == []
    assert run(messages(one, 2, announce=3))[1] == []  # more announced than came
    assert run(messages(one, 1)[:2] + messages(monitor.ahead(one, 96), 0))[1] == []
    forced = run(messages(one, 1)[:2] + messages(monitor.ahead(one, 97), 0))[1]
    assert [x["slot"] for x in forced] == [one, monitor.ahead(one, 97)]
    b = monitor.Assembler().load(run(messages(one, 3)[:2])[0].dump())
    assert [x["rows"] for m in messages(one, 3) for x in b.add(m)] == [6]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    all_messages = [m for i in range(6) for m in messages(monitor.ahead("20260930000000", i), 2)]
    for n, m in enumerate(all_messages):
        m["seq"] = n
    for part, cut in enumerate((all_messages[:11], all_messages[8:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(m) for m in cut))
        q = monitor.closed_slots(monitor.read_messages(spark, f"{tmp_path}/in")).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(monitor.CLOSED).json(f"{tmp_path}/out").orderBy("slot").collect()
    assert [(r.slot, r["rows"]) for r in got] == [(monitor.ahead("20260930000000", i), 4) for i in range(6)]


def test_detectors_agree(spark):
    rng = random.Random(2)
    slots = [monitor.ahead("20260901000000", i) for i in range(96 * 10)]
    cells = {(s, g): (rng.randint(0, 4) + (40 if rng.random() < 0.004 else 0)) for s in slots for g in ("a", "b")}
    d = monitor.Detector()
    want = [x for s in slots for x in d.feed(s, {g: cells[s, g] for g in ("a", "b")})]
    df = spark.createDataFrame([(s, g, n) for (s, g), n in cells.items()], "s string, group string, count long").select(F.to_timestamp("s", "yyyyMMddHHmmss").alias("ts"), "group", "count")
    got = spikes.detect(df, ["a", "b"]).select("group", F.date_format("slot", "yyyyMMddHHmmss").alias("slot"), "observed", "expected", "score").collect()
    assert want and sorted((r.group, r.slot, r.observed, r.expected) for r in got) == sorted((x["group"], x["slot"], x["observed"], x["expected"]) for x in want)
    warm = monitor.Assembler().load(monitor.warm_start([(s, g, n) for (s, g), n in cells.items()], slots[-1]))
    assert warm.closed == slots[-1] and warm.detector.dump() == d.dump()


def test_statistics(spark):
    one = spark.range(1).select(*[c.alias(n) for c, n in zip(T.wilson(F.lit(8), F.lit(10)), "plh")]).first()
    assert (round(one.p, 3), round(one.l, 4), round(one.h, 4)) == (0.8, 0.4902, 0.9433)
    rng = random.Random(1)
    table = spark.createDataFrame([(g, c, rng.randint(0, 20) + 20 * (g == "a"), 100) for g in "ab" for c in range(30)], "group string, cluster int, num long, den long")
    r = T.ratio_difference(table, "a", "b", resamples=300).first()
    assert r.low < r.value < r.high and r.low > 0
    verdicts = [T.equivalence(F.lit(lo), F.lit(hi)) for lo, hi in ((-0.1, 0.2), (-1.0, 2.0), (0.6, 0.9))]
    assert list(spark.range(1).select(*verdicts).first()) == ["same within the margin", "no detectable difference", "different"]
    labels = spark.createDataFrame([("x", "y"), ("x", " Yes"), ("x", "n"), ("x", "not sure"), ("z", None)], "stratum string, label string")
    p = T.precision(labels).collect()
    assert [(r.stratum, r.k, r.n) for r in p] == [("x", 2, 3)]


def test_matching_edges(spark):
    src = spark.createDataFrame([(1, 100, [1.0, 0.0], ["e", "f"]), (2, 1000, [1.0, 0.0], [])], "id long, t long, vec array<double>, entities array<string>")
    dst = spark.createDataFrame([(10, 52, [1.0, 0.0], ["e", "f"]), (11, 148, [1.0, 0.0], ["e", "f"]), (12, 51, [2.0, 0.0], ["e", "f"])], "id long, t long, vec array<double>, entities array<string>")
    assert sorted(map(tuple, matching.top_by_vector(src, dst, 48).collect())) == [(1, 10, 1.0), (2, None, -1.0)]
    assert sorted(map(tuple, matching.top_by_entities(src, dst, 48, rare=2.0).collect())) == [(1, 10, 2), (2, None, 0)]


def test_reconcile(spark):
    ref = spark.createDataFrame([("d1", 10, 1000), ("d2", 5, 10)], "day string, n_rows long, relevant long")
    got = spark.createDataFrame([("d1", 10, 1004)], "day string, n_rows long, relevant long")
    assert {r.day: r.ok for r in checks.reconcile(got, ref).collect()} == {"d1": True, "d2": False}
