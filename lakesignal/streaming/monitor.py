"""Slots closed by completeness markers, as a stateful streaming query.

Messages are article records and done markers.  A slot is complete once every
feed's marker has come and as many distinct records as it announced; slots
close oldest first, and an older one is forced once the newest slot is more
than ``grace`` slots ahead.  Messages of closed slots are late and dropped;
repeated records of a feed in a slot count once.  Closed slots are fed to the
spike detector.  The rules see one message at a time in the order of ``seq``,
whatever the batch limits.  State lives in the checkpoint; a query that starts
over continues without repeating a slot.

A single state key orders the slots, so per-slot counting may be done in a
keyed stage before this one where one key is not enough.
"""

from __future__ import annotations

import json
import time
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakesignal.operators import spikes

MESSAGE = "seq long, kind string, slot string, feed string, id string, url string, about boolean, security boolean, group string, ids int, sent_at double"
CLOSED = "slot string, rows long, about long, security string, feeds string, sent_at double, closed_at double, alerts string"
FEEDS = ("en", "tr")
GRACE = 96
STAMP = "%Y%m%d%H%M%S"


def ahead(slot: str, n: int) -> str:
    return (datetime.strptime(slot, STAMP) + timedelta(minutes=15 * n)).strftime(STAMP)


class Detector:
    """The window detector, one slot at a time."""

    def __init__(self, z: float = spikes.Z, min_count: int = spikes.MIN_COUNT):
        self.z, self.min_count = z, min_count
        self.history: dict[str, deque] = defaultdict(lambda: deque(maxlen=spikes.HISTORY))
        self.hour: dict[str, deque] = defaultdict(lambda: deque(maxlen=spikes.SLOTS_PER_HOUR))
        self.active: set[str] = set()

    def feed(self, slot: str, counts: dict[str, int]) -> list[dict]:
        at = datetime.strptime(slot, STAMP)
        found = []
        for group in sorted({*counts, *self.hour}):
            self.hour[group].append(counts.get(group, 0))
            seen = sum(self.hour[group])
            past = self.history[f"{group}|{at.weekday() >= 5}|{at.hour}"]
            if len(past) >= spikes.MIN_HISTORY:
                mid = median(past)
                score = (seen - mid) / (spikes.MAD_SCALE * median(abs(x - mid) for x in past) + 1)
                high = score >= self.z and seen >= self.min_count
                if high and group not in self.active:
                    found.append({"group": group, "slot": slot, "observed": seen, "expected": float(mid), "score": round(score, 2)})
                (self.active.add if high else self.active.discard)(group)
            if at.minute == 45:
                past.append(seen)
        return found

    def dump(self) -> dict:
        return {"history": {k: list(v) for k, v in self.history.items()}, "hour": {k: list(v) for k, v in self.hour.items()}, "active": sorted(self.active)}

    def load(self, d: dict) -> None:
        for name in ("history", "hour"):
            for k, v in d.get(name, {}).items():
                getattr(self, name)[k].extend(v)
        self.active = set(d.get("active", ()))


class Assembler:
    def __init__(self, feeds: tuple[str, ...] = FEEDS, grace: int = GRACE, detector: Detector | None = None):
        self.feeds, self.grace, self.detector = feeds, grace, detector or Detector()
        self.slots: dict[str, dict] = {}
        self.closed = ""

    def add(self, m: dict) -> list[dict]:
        if m["slot"] <= self.closed:
            return []
        s = self.slots.setdefault(m["slot"], {"feeds": {}, "about": 0, "security": {}, "sent_at": None})
        f = s["feeds"].setdefault(m["feed"], {"keys": {}, "announced": None})
        if m["kind"] == "done":
            f["announced"] = int(m["ids"] or 0)
            s["sent_at"] = max(x for x in (s["sent_at"], m["sent_at"], float("-inf")) if x is not None)
        elif (key := f"{m['id']}\t{m['url']}") not in f["keys"]:
            f["keys"][key] = 1
            s["about"] += bool(m["about"])
            s["security"][m["group"]] = s["security"].get(m["group"], 0) + bool(m["about"] and m["security"])
        return list(self._ready())

    def _complete(self, s: dict) -> bool:
        return all(f in s["feeds"] and s["feeds"][f]["announced"] is not None and len(s["feeds"][f]["keys"]) >= s["feeds"][f]["announced"] for f in self.feeds)

    def _ready(self) -> Iterator[dict]:
        while self.slots:
            slot = min(self.slots)
            if not self._complete(self.slots[slot]) and max(self.slots) <= ahead(slot, self.grace):
                return
            s = self.slots.pop(slot)
            self.closed = slot
            yield {
                "slot": slot, "rows": sum(len(f["keys"]) for f in s["feeds"].values()), "about": s["about"], "security": json.dumps(s["security"], sort_keys=True),
                "feeds": ",".join(sorted(k for k, f in s["feeds"].items() if f["announced"] is not None)), "sent_at": s["sent_at"], "closed_at": time.time(), "alerts": json.dumps(self.detector.feed(slot, s["security"])),
            }

    def dump(self) -> str:
        return json.dumps({"slots": self.slots, "closed": self.closed, "detector": self.detector.dump()})

    def load(self, text: str) -> Assembler:
        d = json.loads(text)
        self.slots, self.closed = d["slots"], d["closed"]
        self.detector.load(d["detector"])
        return self


def warm_start(series: Iterable[tuple[str, str, int]], last_slot: str) -> str:
    """State after a batch history of (slot, group, count) up to a slot: the
    detector has seen every slot, none is open."""
    by: dict[str, dict] = defaultdict(dict)
    for slot, group, n in series:
        by[slot][group] = n
    a = Assembler()
    groups = {g for c in by.values() for g in c}
    slot = min(by, default=last_slot)
    while slot <= last_slot and by:
        a.detector.feed(slot, {g: by.get(slot, {}).get(g, 0) for g in groups})
        slot = ahead(slot, 1)
    a.closed = last_slot
    return a.dump()


def closed_slots(messages: DataFrame, feeds: tuple[str, ...] = FEEDS, grace: int = GRACE, start: str | None = None) -> DataFrame:
    """Closed slots of a stream of messages (see MESSAGE); ``start`` is a state
    from warm_start, used only where the query has none of its own."""

    def step(key, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = Assembler(feeds, grace)
        if state.exists:
            a.load(state.get[0])
        elif start:
            a.load(start)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        out = [x for m in rows.to_dict("records") for x in a.add(m)]
        state.update((a.dump(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    keyed = messages.where("kind IS NOT NULL AND slot IS NOT NULL").withColumn("one", F.lit(0))
    return keyed.groupBy("one").applyInPandasWithState(step, CLOSED, "state string", "append", GroupStateTimeout.NoTimeout)


def read_messages(spark, path: str) -> DataFrame:
    """The file form of the topic: JSON lines with the message schema."""
    return spark.readStream.schema(MESSAGE).json(path)


def from_kafka(spark, servers: str, topic: str) -> DataFrame:
    """The topic itself; seq is the offset, so use one partition."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    parsed = raw.where("value IS NOT NULL").select("offset", F.from_json(F.col("value").cast("string"), MESSAGE).alias("m"))
    return parsed.select("m.*", "offset").withColumn("seq", F.col("offset")).drop("offset")


def to_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Publish messages keyed by slot, acknowledged by all replicas."""
    rows = df.select(F.col("slot").cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.compression.type", "zstd").option("kafka.linger.ms", "50").save()


def announce(articles: DataFrame) -> DataFrame:
    """Done markers: distinct (id, url) of each slot and feed."""
    return articles.groupBy("slot", "feed").agg(F.count_distinct("id", "url").cast("int").alias("ids")).withColumn("kind", F.lit("done"))


def lag(closed: DataFrame, closed_at: str = "closed_at", sent_at: str = "sent_at") -> DataFrame:
    """Median and 95 % point of the time from marker to closing."""
    d = F.col(closed_at) - F.col(sent_at)
    return closed.agg(F.median(d).alias("p50"), F.percentile(d, F.lit(0.95)).alias("p95"), F.count(d).alias("n"))
