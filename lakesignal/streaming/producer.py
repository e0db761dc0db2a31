"""The polling producer: from the feeds to the topic, then to the archive.

A pass takes every file from a fixed start to the newest slot that is neither
archived nor known to be missing, slot by slot, both feeds of each, oldest
first.  Files are fetched in parallel into a written table; they are published
one after the other and archived only once the sink has taken them, so a crash
repeats one file and skips none.  A file that is not there yet and younger than
``grace`` slots ends the pass; an older one is published as an empty file and
remembered as missing.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.functions import records as R
from lakesignal.functions.slots import STAMP
from lakesignal.session import shared_dir
from lakesignal.sources import archive
from lakesignal.streaming.monitor import FEEDS, GRACE, ahead

BACKLOG = 8
ARTICLE = "id string, ts string, feed string, domain string, lang string, `group` string, url string, title string, countries array<string>, about_baltic boolean, security boolean, themes array<string>, persons array<string>, orgs array<string>, tone double"
Publish = Callable[[DataFrame], None]
log = logging.getLogger(__name__)


def _place(root: str):
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def settled(files: DataFrame, root: str) -> DataFrame:
    """(feed, slot) of every archived or missing file in the folders of the days
    of ``files`` (feed, slot), listed by name in tasks (markers are empty, and
    readers skip empty files)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _place(root)
        for p in parts:
            for r in p.itertuples(index=False):
                found = fs.get_file_info(pafs.FileSelector(f"{base}/feed={r.feed}/dt={r.dt}", allow_not_found=True))
                slots = sorted({f.base_name[:14] for f in found if f.base_name[14:] in (".zip", ".missing")})
                if slots:
                    yield pd.DataFrame({"feed": [r.feed] * len(slots), "slot": slots})

    days = files.select("feed", F.left("slot", F.lit(8)).alias("dt")).distinct()
    return days.mapInPandas(run, "feed string, slot string")


def wanted(spark: SparkSession, since: str, newest: dict[str, str]) -> DataFrame:
    """(feed, slot, place) from ``since`` to each feed's newest slot."""
    ends = spark.createDataFrame([(f, n, since, newest[f]) for n, f in enumerate(FEEDS) if f in newest and newest[f] >= since], "feed string, place int, a string, z string")
    grid = ends.select("feed", "place", F.explode(F.sequence(F.to_timestamp("a", STAMP), F.to_timestamp("z", STAMP), F.expr("interval 15 minutes"))).alias("t"))
    return grid.select("feed", F.date_format("t", STAMP).alias("slot"), "place")


def store(files: DataFrame, root: str) -> int:
    """Write each file's zip, or its empty missing marker, under
    root/feed=/dt=/ by name and rename; ``root`` must be shared by all machines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _place(root)
        for p in parts:
            for r in p.itertuples(index=False):
                at = f"{base}/feed={r.feed}/dt={r.slot[:8]}"
                fs.create_dir(at, recursive=True)
                name = f"{at}/{r.slot}.{'zip' if r.outcome == 'stored' else 'missing'}"
                beside = f"{at}/.{r.slot}-{uuid.uuid4().hex[:8]}.tmp"
                with fs.open_output_stream(beside) as out:
                    out.write(r.content if r.outcome == "stored" else b"")
                fs.move(beside, name)
            yield pd.DataFrame({"n": [len(p)]})

    return files.select("feed", "slot", "outcome", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def messages(file: DataFrame, feed: str, slot: str) -> DataFrame:
    """Article messages of one fetched file, then its done marker (seq orders
    them).  Fetched columns: feed, slot, outcome, content."""
    spark = file.sparkSession

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p.content:
                rows = list(archive.rows_of(content))
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame({"path": "", "feed": feed, "cols": rows[at : at + 5000]})

    rows = file.where("outcome = 'stored'").select("content").mapInPandas(unzip, archive.ROWS)
    parsed = R.parse(rows)
    number = F.monotonically_increasing_id()
    own = parsed.withColumnRenamed("about_baltic", "about").select(number.alias("seq"), F.lit("article").alias("kind"), F.lit(slot).alias("slot"), "*", F.lit(None).cast("int").alias("ids"), F.lit(None).cast("double").alias("sent_at"))
    done = parsed.agg(F.count_distinct("id", "url").cast("int").alias("ids"))
    empty = spark.createDataFrame([], own.schema)
    mark = done.select(F.lit((1 << 62) + 1).alias("seq"), F.lit("done").alias("kind"), F.lit(slot).alias("slot"), F.lit(feed).alias("feed"), "ids", F.lit(time.time()).alias("sent_at"))
    return own.unionByName(empty.unionByName(mark, allowMissingColumns=True)).orderBy("seq")


class Producer:
    """``newest`` gives each feed's newest slot, ``fetch`` a file's bytes or None,
    ``publish`` takes the messages of a file and returns once all are taken."""

    def __init__(self, spark: SparkSession, root: str, newest: Callable[[], dict[str, str]], fetch: Callable[[str, str], bytes | None], publish: Publish, since: str | None = None, grace: int = GRACE):
        self.spark, self.root, self.newest, self.fetch, self.publish, self.since, self.grace = spark, root, newest, fetch, publish, since, grace

    def poll(self) -> int:
        """One pass; the number of files published."""
        newest = self.newest()
        self.since = self.since or ahead(max(newest.values()), 1 - BACKLOG)  # fixed once: no slot slips out of view
        todo = wanted(self.spark, self.since, newest)
        at = f"{shared_dir(self.spark).rstrip('/')}/fetched-{uuid.uuid4().hex[:12]}"
        archive.mirror(todo, settled(todo, self.root), self.fetch).join(F.broadcast(todo), ["feed", "slot"]).write.parquet(at)  # two rows a slot
        got = self.spark.read.parquet(at)
        limit = self.spark.createDataFrame([(f, ahead(s, -self.grace)) for f, s in newest.items()], "feed string, oldest string")
        young = got.where("outcome = 'missing'").join(F.broadcast(limit), "feed").where("slot > oldest")
        stop = young.agg(F.min(F.struct("slot", "place")).alias("s")).first()["s"]
        ready = got if stop is None else got.where(F.struct("slot", "place") < F.struct(F.lit(stop["slot"]), F.lit(stop["place"])))
        if stop is not None:
            log.warning("waiting for %s", dict(stop.asDict()))
        keys = ready.select("slot", "place", "feed").orderBy("slot", "place").collect()  # names of the backlog's files
        for k in keys:
            file = got.where((F.col("slot") == k.slot) & (F.col("feed") == k.feed))
            self.publish(messages(file, k.feed, k.slot))
            store(file, self.root)
        return len(keys)

    def serve(self, every: float = 60.0, passes: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
        """Poll for ever (or ``passes`` times); a failed pass is logged and the
        next one tries again.  Gives the number of files published."""
        done = n = 0
        while passes is None or n < passes:
            n += 1
            try:
                done += self.poll()
            except Exception:  # the service outlives whatever a poll meets
                log.exception("the pass failed")
            sleep(every)
        return done
