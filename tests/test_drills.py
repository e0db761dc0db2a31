"""A killed stream catches up from its checkpoint; slots that never close."""

import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from lakesignal.operators import checks, spikes
from lakesignal.streaming import monitor
from test_domain import messages

FIRST = "20260930000000"
ROOT = Path(__file__).resolve().parents[1]
SERVICE = """
import sys
from lakesignal.session import session
from lakesignal.streaming import monitor
spark = session(**{"spark__master": "local[2]", "spark__ui__enabled": "false", "spark__sql__shuffle__partitions": "2"})
at = sys.argv[1]
monitor.closed_slots(monitor.read_messages(spark, at + "/in")).writeStream.format("json").option("path", at + "/out").option("checkpointLocation", at + "/state").trigger(processingTime="1 second").start().awaitTermination()
"""


def put(at, name, ms, first):
    for n, m in enumerate(ms):
        m["seq"] = first + n
    beside = at / f".{name}"
    beside.write_text("\n".join(json.dumps(m) for m in ms))
    beside.rename(at / "in" / f"{name}.json")


def test_killed_stream_catches_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    slots = [monitor.ahead(FIRST, i) for i in range(8)]
    put(tmp_path, "a", [m for s in slots[:3] for m in messages(s, 2)], 0)
    service = subprocess.Popen([sys.executable, "-c", SERVICE, str(tmp_path)], env=os.environ | {"PYTHONPATH": str(ROOT)}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        until = time.time() + 90
        while time.time() < until and not list((tmp_path / "out").glob("*.json")):
            time.sleep(0.5)
    finally:
        os.killpg(service.pid, signal.SIGKILL)  # no clean stop
        service.wait()
    assert list((tmp_path / "out").glob("*.json"))
    put(tmp_path, "b", [m for s in slots[3:] for m in messages(s, 2)], 1000)
    q = monitor.closed_slots(monitor.read_messages(spark, str(tmp_path / "in"))).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(monitor.CLOSED).json(str(tmp_path / "out"))
    assert sorted(r.slot for r in got.collect()) == slots and {r["rows"] for r in got.collect()} == {4}
    series = spark.createDataFrame([(s, "other", 2) for s in slots], "ts string, group string, count long")
    row = checks.agreement(got, series, slots[0], slots[-1]).first()
    assert row.ok and row.duplicates == 0 and row.security_stream == row.security_batch == 16


def test_slots_without_markers_part_the_two_rolling_hours(spark):
    """The stream's hour is its last four closed slots, the backtest's its last
    four dense ones: equal where every slot closes, and only there."""
    slots = [monitor.ahead(FIRST, i) for i in range(12)]
    cells = {s: i + 1 for i, s in enumerate(slots)}

    def rolled(seen):
        d, out = monitor.Detector(), {}
        for s in seen:
            d.feed(s, {"g": cells[s]})
            out[s] = sum(d.hour["g"])
        return out

    def dense(seen):
        df = spark.createDataFrame([(s, "g", cells[s]) for s in seen], "s string, group string, count long").select(F.to_timestamp("s", "yyyyMMddHHmmss").alias("ts"), "group", "count")
        rows = spikes.rolling(spikes.dense(df, ["g"])).select(F.date_format("ts", "yyyyMMddHHmmss").alias("s"), "observed").collect()
        return {r.s: r.observed for r in rows}

    assert rolled(slots) == dense(slots)
    gap = [s for s in slots if s != slots[6]]
    stream, batch = rolled(gap), dense(gap)
    assert [s for s in gap if stream[s] != batch[s]] == slots[7:10] and stream[slots[7]] == 8 + 6 + 5 + 4 and batch[slots[7]] == 8 + 6 + 5
