"""The producer, the commands and the studies on a small synthetic archive."""

import io
import json
import random
import sys
import urllib.error
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lakesignal import __main__ as cli
from lakesignal.operators import checks, evaluation, hypotheses, matching, reports
from lakesignal.sources import archive, feeds
from lakesignal.streaming import monitor, producer
import test_domain
from test_domain import raw

for _m in (sys.modules[__name__], test_domain):  # workers do not see the tests
    cloudpickle.register_pickle_by_value(_m)

FIRST = "20260901000000"


def zipped(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", "\n".join("\t".join(r) for r in rows))
    return out.getvalue()


def file(feed, slot):
    """A deterministic file: none in every eleventh slot of the second feed."""
    rng = random.Random(f"{feed}{slot}")
    n = int(slot[8:10]) * 4 + int(slot[10:12]) // 15
    if feed == "tr" and n % 11 == 5:
        return None
    rows = []
    for i in range(6):
        domain = rng.choice(["rt.com", "x.ru", "y.ru", "delfi.lv", "lrt.lt", "postimees.ee", "yle.fi", "onet.pl", "bbc.com", "cnn.com"])
        rows.append(raw(i, id=f"{slot}-{feed}-{i}", ts=slot, domain=domain, url=f"https://{domain}/{slot}/{i}", tone=f"{rng.uniform(-6, 4):.3f},1", persons2=";".join(f"Name {rng.randint(0, 120)},1" for _ in range(4)), themes="MILITARY,1" if rng.random() < 0.5 else "EDUCATION,1", extras=f"<PAGE_TITLE>{rng.choice(['Riga', 'Vilnius', 'Tallinn'])} port news number {rng.randint(0, 20)}</PAGE_TITLE>", translation="srclc:rus;eng:x" if domain == "delfi.lv" and i % 2 else ""))
    return zipped(rows)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """An archive that the producer made, slot by slot, with what it published."""
    at = tmp_path_factory.mktemp("data")
    sent = []

    def publish(df):
        sent.append([r.asDict() for r in df.collect()])

    p = producer.Producer(spark, f"{at}/raw", lambda: {"en": monitor.ahead(FIRST, 5), "tr": monitor.ahead(FIRST, 5)}, file, publish, FIRST, grace=2)
    assert p.poll() == 11  # the last slot of the second feed is not there yet
    order = [(m[-1]["slot"], m[-1]["feed"]) for m in sent]
    assert order == sorted(order) and all(m[-1]["kind"] == "done" and m[-1]["ids"] == len(m) - 1 for m in sent)
    assert p.poll() == 0
    p.newest = lambda: {"en": monitor.ahead(FIRST, 8), "tr": monitor.ahead(FIRST, 8)}
    assert p.poll() == 7 and (at / "raw/feed=tr/dt=20260901" / f"{monitor.ahead(FIRST, 5)}.missing").exists()
    assert [m for m in sent if m[-1]["slot"] == monitor.ahead(FIRST, 5) and m[-1]["feed"] == "tr"][0][0]["ids"] == 0
    todo = spark.createDataFrame([(f, monitor.ahead(FIRST, i)) for f in ("en", "tr") for i in range(96 * 2)], "feed string, slot string")
    have = producer.settled(todo, f"{at}/raw")
    assert have.count() == 18 and p.poll() == 0  # the missing one is remembered
    producer.store(archive.mirror(todo, have, file), f"{at}/raw")
    return str(at)


def test_producer_repeats_what_the_sink_did_not_take(spark, tmp_path):
    def broken(df):
        raise RuntimeError("no broker")

    p = producer.Producer(spark, f"{tmp_path}/raw", lambda: {"en": FIRST, "tr": FIRST}, lambda f, s: zipped([raw(1)]), broken, FIRST)
    assert p.serve(passes=1, sleep=lambda s: None) == 0
    assert producer.settled(producer.wanted(spark, FIRST, {"en": FIRST}), f"{tmp_path}/raw").count() == 0
    p.publish = lambda df: df.count()
    assert p.serve(passes=1, sleep=lambda s: None) == 2 and p.since == FIRST
    q = producer.Producer(spark, f"{tmp_path}/raw", lambda: {"en": monitor.ahead(FIRST, 9), "tr": FIRST}, lambda f, s: None, p.publish)
    assert q.poll() == 0 and q.since == monitor.ahead(FIRST, 2)


def test_http(monkeypatch):
    tries, waits = [], []

    def opened(request, timeout):
        tries.append(request.full_url)
        code = [503, 500, 404][min(len(tries) - 1, 2)]
        raise urllib.error.HTTPError(request.full_url, code, "", {}, None)

    monkeypatch.setattr(feeds.urllib.request, "urlopen", opened)
    assert feeds.fetched(feeds.file_url("http://x/", "tr", FIRST), sleep=waits.append) is None
    assert tries == [f"http://x/{FIRST}.translation.gkg.csv.zip"] * 3 and waits == [2.0, 4.0]
    assert feeds.newest_slot("1 2 http://x/20260901001500.translation.gkg.csv.zip") == "20260901001500"


def test_days_are_pruned(spark, root):
    df = archive.read_archive(spark, f"{root}/raw", "20260902", "20260902")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.path.split("dt=")[1][:8] for r in df.select("path").distinct().collect()} == {"20260902"}


@pytest.fixture(scope="module")
def built(spark, root):
    assert cli.main(["--data", root, "etl", "2026-09-01", "2"]) == 0
    assert cli.main(["--data", root, "etl", "2026-09-01", "2", "--live"]) == 0
    return root


def test_lake_report_and_evaluation(spark, built):
    read = lambda n: spark.read.parquet(f"{built}/lake/{n}")
    days = {r.day: {"rows": r.n_rows, "relevant": r.relevant} for r in checks.lake_days(read("domain_day"), read("articles")).collect()}
    with open(f"{built}/days.json", "w") as f:
        json.dump(days, f)
    assert len(days) == 2 and cli.main(["--data", built, "reconcile", f"{built}/days.json"]) == 0
    days["20260901"]["rows"] += 1
    with open(f"{built}/days.json", "w") as f:
        json.dump(days, f)
    assert cli.main(["--data", built, "reconcile", f"{built}/days.json"]) == 1
    assert cli.main(["--data", built, "match"]) == 0 and cli.main(["--data", built, "sample"]) == 0
    sheet = archive.read_sheet(spark, f"{built}/ai/labels_pairs")
    assert sheet.count() > 10 and "stratum" not in sheet.columns and {r.label for r in sheet.collect()} == {""}
    for name in ("pairs", "slots"):
        labelled = archive.read_sheet(spark, f"{built}/ai/labels_{name}").withColumn("label", F.when(F.col("item").cast("int") % 2 == 0, "y").otherwise("n")).collect()
        archive.write_sheet(spark.createDataFrame(labelled), f"{built}/ai/labels_{name}") if labelled else None
    assert cli.main(["--data", built, "evaluate"]) == 0
    found = json.load(open(f"{built}/report/evaluation.json"))
    assert {r["stratum"] for r in found["precision"]} >= {"emb_top", "ent"} and found["matching"][0]["accepted"] in (True, False)
    cli.main(["--data", built, "measure", "2026-09-01", "1", "--workers", "8"])
    assert archive.read_runs(spark, f"{built}/bench").count() == 1
    assert cli.main(["--data", built, "bench", "2026-09-01"]) == 0
    assert cli.main(["--data", built, "seed"]) == 0
    assert cli.main(["--data", built, "report"]) == 0
    summary = json.load(open(f"{built}/report/summary.json"))
    assert {"shares", "attention", "framing", "tone_security", "themes", "scaling"} <= set(summary)
    assert summary["framing"][0]["verdict"] and {r["reference"] for r in summary["attention"]} == {"other", "regional"}


def test_stream_against_batch(spark, built, tmp_path):
    """The archive's messages through the stream agree with the batch; a planted
    difference, a lost slot and a repeated line are seen."""
    files = archive.read_archive(spark, f"{built}/raw")
    parsed = cli.R.parse(files)
    own = parsed.withColumnRenamed("about_baltic", "about").withColumn("kind", F.lit("article")).withColumn("slot", F.col("ts"))
    marks = monitor.announce(own).withColumn("sent_at", F.lit(1.0))
    body = own.unionByName(marks, allowMissingColumns=True).withColumn("seq", F.col("slot").cast("long") * 10 + F.when(F.col("kind") == "done", 1).otherwise(0))
    every = spark.createDataFrame([(f, monitor.ahead(FIRST, i)) for f in ("en", "tr") for i in range(192)], "feed string, slot string")
    none = producer.settled(every, f"{built}/raw").join(marks, ["feed", "slot"], "left_anti").select("feed", "slot", F.lit("done").alias("kind"), F.lit(0).alias("ids"), (F.col("slot").cast("long") * 10 + 1).alias("seq"), F.lit(1.0).alias("sent_at"))
    body.unionByName(none, allowMissingColumns=True).select("seq", "kind", "slot", "feed", "id", "url", "about", "security", "group", "ids", "sent_at").write.json(f"{tmp_path}/in")
    stream = monitor.closed_slots(monitor.read_messages(spark, f"{tmp_path}/in")).writeStream.format("json").option("path", f"{built}/monitor/slots").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    end = monitor.ahead(FIRST, 191)
    done = cli.main(["--data", built, "stream-vs-batch", end, "--start", FIRST])
    assert done == 0, open(f"{built}/report/stream_vs_batch.json").read()
    closed = spark.read.schema(monitor.CLOSED).json(f"{built}/monitor/slots").cache()
    series = spark.read.parquet(f"{built}/lake-live/series_15m")
    row = checks.agreement(closed, series, FIRST, end).first()
    assert (row.slots, row.duplicates, row.missing, row.differ, row.ok) == (192, 0, 0, 0, True) and row.security_stream == row.security_batch > 0
    some = closed.where("security LIKE '%:%'").orderBy("slot").limit(1).collect()[0]
    wrong = closed.withColumn("security", F.when(F.col("slot") == some.slot, '{"ru_by": 99}').otherwise(F.col("security")))
    assert checks.agreement(wrong, series, FIRST, end).first().differ == 1
    assert checks.agreement(closed.where(F.col("slot") != some.slot), series, FIRST, end).first().missing == 1
    twice = checks.agreement(closed.union(closed.where(F.col("slot") == some.slot)), series, FIRST, end).first()
    assert twice.duplicates == 1 and twice.ok
    assert not checks.agreement(closed.limit(0), series, FIRST, end).first().ok
    live = reports.live(closed).first()
    assert live.slots == 192 and live.first == FIRST and live.steady_slots == 0 and live.lag_p50_s is None
    assert monitor.lag(closed).first().n == 192
    assert reports.alert_lines(closed).columns == ["group", "slot", "observed", "expected", "score"]


def test_steady_slots(spark):
    rows = [("20260901000000", 5, 2, 1000.0, None)]
    end = spark.range(1).select(F.unix_seconds(F.to_timestamp(F.lit(FIRST), "yyyyMMddHHmmss")) + 900).first()[0]
    rows = [(FIRST, 5, 2, end + 1.0, end + 11.0), (monitor.ahead(FIRST, 1), 7, 4, end + 901.0, end + 921.0), (monitor.ahead(FIRST, 2), 9, 6, end + 1800.0, end + 9000.0)]
    got = reports.live(spark.createDataFrame(rows, "slot string, rows long, about long, sent_at double, closed_at double")).first()
    assert (got.slots, got.steady_slots, got.lag_p50_s, got.rows_per_slot) == (3, 2, 15.0, 7.0)


def test_hypotheses_by_hand(spark):
    rng = random.Random(3)
    rows = [(g, f"{g}{i}", f, rng.gauss(m, 0.1), True, s) for g, f, m in (("ru_by", "tr", -2.0), ("other", "tr", 0.0), ("other", "en", 9.0), ("baltic_rus", "en", 0.5)) for i in range(12) for s in (True, False)]
    rows += [("ru_by", "z", "tr", None, True, False), ("ru_by", "z", "tr", float("nan"), True, True), ("other", "z", "tr", 50.0, False, True)]
    articles = spark.createDataFrame(rows, "`group` string, domain string, feed string, tone double, about_baltic boolean, security boolean")
    got = {r.reference: r for r in hypotheses.tone_differences(articles, False, resamples=200).collect()}
    assert set(got) == {"other (translated)", "baltic_rus"} and abs(got["baltic_rus"].value + 2.5) < 0.2
    one = hypotheses.framing(articles, resamples=200).first()
    assert one.lower_accepted and one.verdict == "different"
    assert {r.group for r in hypotheses.mean_tone(articles).collect()} == {"ru_by", "other", "baltic_rus"}


def test_embedding_and_sheets(spark):
    rows = spark.createDataFrame([("a", "Same title here"), ("b", "Same title here"), ("c", "Another one")], "id string, title string")
    got = matching.embedded(rows, feeds.hashed_encoder(16)).collect()
    assert len(got) == 3 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-3 for r in got)
    items = spark.createDataFrame([("s1", "x", "y"), ("s2", "x", "y"), ("s1", "x", None)], "stratum string, src_title string, dst_title string")
    sheet, key = evaluation.blind(items, evaluation.SHOWN_PAIR)
    assert sheet.count() == 2 and key.count() == 3 and sheet.columns == ["item", "src_title", "dst_title", "label"]
