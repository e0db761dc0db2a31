"""Commands over one data root: python -m lakesignal COMMAND [...].

    root/raw            zips by feed and day       root/lake, lake-live   the tables
    root/monitor        the stream's slots         root/ai                pairs, sheets, keys
    root/report         JSON documents             root/bench             one document a run
"""

from __future__ import annotations

import argparse
import json
import os
import time
import uuid

from pyspark.sql import functions as F

from lakesignal.functions import records as R
from lakesignal.functions import slots as S
from lakesignal.operators import checks, evaluation, hypotheses, lake, matching, reports, spikes
from lakesignal.operators import statistics as T
from lakesignal.session import session, shared_dir
from lakesignal.sources import archive, feeds
from lakesignal.streaming import monitor as M
from lakesignal.streaming import producer as P


def _days(a):
    first = a.day.replace("-", "")
    return first, M.ahead(f"{first}000000", 96 * a.days - 1)[:8]


def _lake(spark, root, name, which="lake"):
    return spark.read.parquet(f"{root}/{which}/{name}")


def _replay(spark, root):
    """The dense series of the lake and its alerts."""
    rows = _lake(spark, root, "series_15m").withColumn("ts", S.to_time(F.col("ts")))
    return spikes.dense(rows, list(R.GROUPS)), spikes.detect(rows, list(R.GROUPS))


def produce(spark, a):
    """Poll the feeds and publish what is new."""
    at = {f: f"{a.base}lastupdate{'-translation' if f == 'tr' else ''}.txt" for f in M.FEEDS}
    return P.Producer(spark, f"{a.data}/raw", lambda: {f: feeds.newest(u) for f, u in at.items()}, feeds.download(a.base), lambda df: M.to_kafka(df, a.kafka, a.topic), a.since).serve(passes=a.passes)


def monitor(spark, a):
    """Close slots of the topic, from a warm start if the batch history is there."""
    start = f"{a.data}/monitor/start.json"
    warm = open(start).read() if os.path.exists(start) else None
    q = M.closed_slots(M.from_kafka(spark, a.kafka, a.topic), start=warm).writeStream.format("json").option("path", f"{a.data}/monitor/slots").option("checkpointLocation", f"{a.data}/monitor/state").start()
    q.awaitTermination()


def seed(spark, a):
    """Write the monitor's starting state after the lake's history; a running monitor keeps its own."""
    rows = _lake(spark, a.data, "series_15m")
    last = rows.agg(F.max("ts")).first()[0]
    cells = ((r.ts, r.group, r["count"]) for r in rows.toLocalIterator())
    reports.write_atomic(f"{a.data}/monitor/start.json", M.warm_start(cells, last).encode())


def mirror(spark, a):
    """Fetch days of files that are not archived yet."""
    first, last = _days(a)
    slots = spark.sql(f"SELECT date_format(explode(sequence(to_timestamp('{first}', 'yyyyMMdd'), to_timestamp('{last}2345', 'yyyyMMddHHmm'), interval 15 minutes)), '{S.STAMP}') AS slot")
    jobs = archive.jobs(spark, slots)
    at = f"{shared_dir(spark).rstrip('/')}/fetched-{uuid.uuid4().hex[:12]}"
    archive.mirror(jobs, P.settled(jobs, f"{a.data}/raw"), feeds.download(a.base)).write.parquet(at)
    P.store(spark.read.parquet(at), f"{a.data}/raw")
    print({r.outcome: r.n for r in archive.outcomes(spark.read.parquet(at)).collect()})


def etl(spark, a):
    """Build the lake's tables from the archive."""
    began = time.time()
    rows = R.parse(archive.read_archive(spark, f"{a.data}/raw", *_days(a)))
    print(lake.write(rows, f"{a.data}/{'lake-live' if a.live else 'lake'}", single=True) | {"wall_s": round(time.time() - began, 2)})


def measure(spark, a):
    """Time one run of the job without writing."""
    began = time.time()
    t = lake.tables(R.parse(archive.read_archive(spark, f"{a.data}/raw", *_days(a))))
    n = {name: df.count() for name, df in t.items()}
    out = {"engine": "spark", "days": a.days, "workers": a.workers, "repeat": a.repeat, "day": a.day, "relevant": n["articles"], "wall_s": round(time.time() - began, 2)}
    reports.write_atomic(f"{a.data}/bench/spark-{a.days}-{a.workers}-r{a.repeat}.json", json.dumps(out).encode())
    return out


def bench(spark, a):
    """Which runs are still to do, in their order."""
    configs = spark.createDataFrame([("spark", d, w) for d in a.all_days for w in a.cores], "engine string, days int, workers int")
    have = archive.read_runs(spark, f"{a.data}/bench") if os.path.isdir(f"{a.data}/bench") else spark.createDataFrame([], "engine string, days int, workers int, repeat int")
    for r in archive.pending(spark, configs, have, os.cpu_count() or 1, a.repeats).collect():
        print(f"python -m lakesignal --data {a.data} measure {a.day} {r.days} --workers {r.workers} --repeat {r.repeat}")


def match(spark, a):
    """Pair articles with their closest counterparts."""
    src, dst = matching.sides(_lake(spark, a.data, "articles"))
    encode = feeds.remote_encoder(a.embedder) if a.embedder else feeds.hashed_encoder()
    matching.match(src, dst, encode).write.mode("overwrite").parquet(f"{a.data}/ai/pairs")
    print(evaluation.match_summary(spark.read.parquet(f"{a.data}/ai/pairs")).first().asDict())


def sample(spark, a):
    """Write the blind sheets and their keys."""
    dense, alerts = _replay(spark, a.data)
    articles = _lake(spark, a.data, "articles").withColumn("ts", S.to_time(F.col("ts")))
    for name, (sheet, key) in {"pairs": evaluation.pair_sheet(spark.read.parquet(f"{a.data}/ai/pairs")), "slots": evaluation.slot_sheet(dense, alerts, articles)}.items():
        archive.write_sheet(sheet, f"{a.data}/ai/labels_{name}")
        archive.write_sheet(key, f"{a.data}/ai/labels_{name}.key")


def evaluate(spark, a):
    """Score the filled-in sheets."""
    read = lambda n: archive.read_sheet(spark, f"{a.data}/ai/labels_{n}")
    pairs = evaluation.scored(read("pairs"), read("pairs.key"), "stratum")
    return reports.write_json(f"{a.data}/report/evaluation.json", {"precision": pairs, "matching": T.better(pairs, "emb_top", "ent"), "detector": evaluation.scored(read("slots"), read("slots.key"), "alert")})


def reconcile(spark, a):
    """Compare the lake's days with independent counts."""
    got = checks.reconcile(checks.lake_days(_lake(spark, a.data, "domain_day"), _lake(spark, a.data, "articles")), checks.reference_days(spark, a.reference))
    rows = got.collect()
    return 0 if rows and all(r.ok for r in rows) else 1


def stream_vs_batch(spark, a):
    """Compare the stream's slots with the live lake."""
    series = _lake(spark, a.data, "series_15m", "lake-live")
    start = a.start or series.agg(F.min("ts")).first()[0]
    closed = spark.read.schema(M.CLOSED).json(f"{a.data}/monitor/slots")
    found = reports.write_json(f"{a.data}/report/stream_vs_batch.json", {"totals": checks.agreement(closed, series, start, a.horizon)})
    return 0 if found["totals"][0]["ok"] else 1


def report(spark, a):
    """Every part whose input is there, as one JSON document."""
    parts = {}
    if lake.done(spark, f"{a.data}/lake"):
        days, articles, (dense, alerts) = _lake(spark, a.data, "domain_day"), _lake(spark, a.data, "articles"), _replay(spark, a.data)
        parts |= {"shares": hypotheses.shares(days), "attention": hypotheses.attention(days), "attention_accepted": hypotheses.attention_accepted(days), "framing": hypotheses.framing(articles)}
        parts |= {"tone_other": hypotheses.tone_differences(articles, False), "tone_security": hypotheses.tone_differences(articles, True), "mean_tone": reports.tone_frame(articles)}
        parts |= {"themes": reports.theme_frame(_lake(spark, a.data, "theme_group")), "backtest": alerts, "slots": dense.agg(F.count_distinct("ts").alias("n"))}
    if os.path.isdir(f"{a.data}/bench"):
        parts["scaling"], parts["beats"] = reports.scaling_frame(archive.read_runs(spark, f"{a.data}/bench"))
    if os.path.isdir(f"{a.data}/monitor/slots"):
        closed = spark.read.schema(M.CLOSED).json(f"{a.data}/monitor/slots")
        parts |= {"live": reports.live(closed), "alerts": reports.alert_counts(reports.alert_lines(closed))}
    return reports.write_json(f"{a.data}/report/summary.json", parts)


def status(spark, a):
    """The last closed slots."""
    spark.read.schema(M.CLOSED).json(f"{a.data}/monitor/slots").orderBy(F.desc("slot")).limit(5).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakesignal", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data", default=os.environ.get("DATA_DIR", "data"))
    p.add_argument("--kafka", default=os.environ.get("KAFKA", "localhost:9092"))
    p.add_argument("--topic", default=os.environ.get("TOPIC", "records"))
    p.add_argument("--base", default=os.environ.get("FEED_BASE", ""), help="address of the feeds' files")
    sub = p.add_subparsers(required=True, metavar="command")

    def command(f, *arguments):
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for name, options in arguments:
            c.add_argument(name, **options)
        c.set_defaults(run=f)

    day, days = ("day", {"help": "first day, YYYY-MM-DD"}), ("days", {"type": int})
    command(produce, ("--since", {"default": os.environ.get("SINCE")}), ("--passes", {"type": int}))
    command(monitor)
    command(seed)
    command(mirror, day, days)
    command(etl, day, days, ("--live", {"action": "store_true"}))
    command(measure, day, days, ("--workers", {"type": int, "default": os.cpu_count()}), ("--repeat", {"type": int, "default": 1}))
    command(bench, day, ("--all-days", {"type": int, "nargs": "+", "default": [1, 7, 30]}), ("--cores", {"type": int, "nargs": "+", "default": [1, 2, 4, 8]}), ("--repeats", {"type": int, "default": 3}))
    command(match, ("--embedder", {"default": os.environ.get("EMBEDDER", ""), "help": "service address; without one, hashed words"}))
    command(sample)
    command(evaluate)
    command(reconcile, ("reference", {"help": "JSON of independent daily counts"}))
    command(stream_vs_batch, ("horizon", {"help": "last slot to compare"}), ("--start", {"default": ""}))
    command(report)
    command(status)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    done = a.run(session(), a)
    return done if isinstance(done, int) and a.run in (reconcile, stream_vs_batch) else 0


if __name__ == "__main__":
    raise SystemExit(main())
