"""The raw archive: zipped tab-separated files by feed and day, and small
text, JSON and CSV tables around it."""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, feed string, cols array<string>"


def rows_of(content: bytes) -> Iterator[list[str]]:
    """Rows of the first member of a zip; default quoting, bad UTF-8 dropped."""
    csv.field_size_limit(min(sys.maxsize, (1 << 31) - 1))
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as raw:
        yield from csv.reader(io.TextIOWrapper(raw, "utf-8", errors="ignore", newline=""), delimiter="\t")


def read_archive(spark: SparkSession, root: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Every row of the zips under root/feed=*/dt=YYYYMMDD/; days outside the
    range are pruned as partitions, so their files are neither opened nor read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root)
    day = F.col("dt").cast("string")
    if first_day:
        files = files.where(day >= first_day)
    if last_day:
        files = files.where(day <= last_day)

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, feed, content in part.itertuples(index=False):
                held: list[list[str]] = []
                for row in rows_of(content):
                    held.append(row)
                    if len(held) == 5000:
                        yield pd.DataFrame({"path": path, "feed": feed, "cols": held})
                        held = []
                if held:
                    yield pd.DataFrame({"path": path, "feed": feed, "cols": held})

    return files.select("path", "feed", "content").mapInPandas(unzip, ROWS)


def jobs(spark: SparkSession, slots: DataFrame, feeds: tuple[str, ...] = ("en", "tr")) -> DataFrame:
    """(feed, slot) for every slot."""
    return slots.select(F.explode(F.array(*map(F.lit, feeds))).alias("feed"), F.col("slot"))


def mirror(wanted: DataFrame, have: DataFrame, fetch: Callable[[str, str], bytes | None], until: str | None = None) -> DataFrame:
    """Fetch what is wanted, not yet there and older than ``until``: feed, slot,
    outcome (stored or missing), content.  Any error of ``fetch`` but a missing
    file fails the task, which Spark repeats."""
    todo = wanted.join(have, ["feed", "slot"], "left_anti")
    if until:
        todo = todo.where(F.col("slot") < until)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [fetch(f, s) for f, s in zip(p.feed, p.slot, strict=True)]
            yield p.assign(outcome=["missing" if g is None else "stored" for g in got], content=got)

    return todo.select("feed", "slot").mapInPandas(run, "feed string, slot string, outcome string, content binary")


def outcomes(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("outcome").agg(F.count("*").alias("n"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; lines that are not JSON are dropped."""
    row = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(row.alias("r")).where("r._bad IS NULL").select("r.*").drop("_bad")


def write_sheet(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet: every column text, empty cells kept."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.fillna("")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The result files of all benchmark runs, one JSON document each."""
    return spark.read.schema("engine string, days int, workers int, tag string, repeat int, day string, files long, rows long, relevant long, wall_s double").option("multiLine", True).json(f"{root}/*-r*.json")


def pending(spark: SparkSession, configs: DataFrame, done: DataFrame, cores: int, repeats: int = 3, seed: str = "1") -> DataFrame:
    """Runs (engine, days, workers, repeat) still to do on a machine with so
    many cores, each distinct configuration ``repeats`` times, in a fixed random order."""
    wanted = configs.distinct().where(F.col("workers") <= cores).select("engine", "days", "workers", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    left = wanted.join(done.select("engine", "days", "workers", "repeat"), ["engine", "days", "workers", "repeat"], "left_anti")
    return left.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "engine", "days", "workers", "repeat").cast("binary")))
