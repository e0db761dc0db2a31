"""Agreement of independent results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.functions.slots import STAMP


def reconcile(lake: DataFrame, reference: DataFrame, tolerance: float = 0.005, day: str = "day") -> DataFrame:
    """Rows equal and relevant within the tolerance, for each reference day."""
    a = lake.select(day, F.col("n_rows").alias("lake_rows"), F.col("relevant").alias("lake_relevant"))
    got = reference.join(a, day, "left").fillna(0, ["lake_rows", "lake_relevant"])
    off = F.abs(F.col("lake_relevant") - F.col("relevant"))
    return got.withColumn("ok", (F.col("lake_rows") == F.col("n_rows")) & (off <= tolerance * F.col("relevant")))


def compare_series(stream: DataFrame, batch: DataFrame, spine: DataFrame, keys: tuple[str, ...] = ("slot", "group"), value: str = "count") -> DataFrame:
    """Stream and batch cells over a full spine, gaps 0, and whether they differ."""
    a = stream.select(*keys, F.col(value).alias("in_stream"))
    b = batch.select(*keys, F.col(value).alias("in_batch"))
    return spine.join(a, list(keys), "left").join(b, list(keys), "left").fillna(0, ["in_stream", "in_batch"]).withColumn("differ", F.col("in_stream") != F.col("in_batch"))


def missing(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(seen.select(key), key, "left_anti")


def between(df: DataFrame, start: str, horizon: str, slot: str = "slot") -> DataFrame:
    """Slots from start to horizon, both included (stamps order as text)."""
    return df.where(F.col(slot).between(start, horizon))


def agreement(closed: DataFrame, batch: DataFrame, start: str, horizon: str) -> DataFrame:
    """One row of totals of the stream's closed slots against the batch series
    (ts, group, count) from start to horizon: slots, duplicates (a slot closed
    again after a crash, its last line counts), missing, differ, sums, ok.

    ``closed`` has slot, security (JSON of counts by group) and closed_at."""
    lines = between(closed, start, horizon)
    last = lines.groupBy("slot").agg(F.max_by("security", F.struct("closed_at", "security")).alias("security"), F.count("*").alias("lines"))
    cells = last.select("slot", F.explode(F.from_json("security", "map<string, bigint>")).alias("group", "in_stream"))
    other = batch.select(F.col("ts").alias("slot"), "group", F.col("count").alias("in_batch")).join(last.select("slot"), "slot", "left_semi")
    both = cells.join(other, ["slot", "group"], "full").fillna(0, ["in_stream", "in_batch"])
    sums = both.groupBy("slot").agg(F.bool_or(F.col("in_stream") != F.col("in_batch")).alias("differs"), F.sum("in_stream").alias("s"), F.sum("in_batch").alias("b"))
    ends = closed.sparkSession.range(1).select(F.to_timestamp(F.lit(start), STAMP).alias("a"), F.to_timestamp(F.lit(horizon), STAMP).alias("z"))
    wanted = ends.where("a <= z").select(F.explode(F.sequence("a", "z", F.expr("interval 15 minutes"))).alias("t")).select(F.date_format("t", STAMP).alias("slot"))
    every = wanted.join(last, "slot", "full").join(sums, "slot", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = every.agg(
        F.count("lines").alias("slots"), zero(F.sum(F.col("lines") - 1)).alias("duplicates"), F.count_if(F.col("lines").isNull()).alias("missing"),
        F.count_if(F.coalesce("differs", F.lit(False))).alias("differ"), zero(F.sum("s")).alias("security_stream"), zero(F.sum("b")).alias("security_batch"), F.count("*").alias("_n"),
    )
    return totals.withColumn("ok", (F.col("_n") > 0) & (F.col("missing") == 0) & (F.col("differ") == 0)).drop("_n")


def reference_days(spark: SparkSession, path: str) -> DataFrame:
    """Independent daily counts from a JSON document {day: {rows, relevant}}:
    day (YYYYMMDD), n_rows, relevant."""
    text = spark.read.option("wholetext", True).text(path)
    days = text.select(F.explode(F.from_json("value", "map<string, struct<rows: bigint, relevant: bigint>>")).alias("day", "x"))
    return days.select("day", F.col("x.rows").alias("n_rows"), "x.relevant")


def lake_days(domain_day: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows and relevant articles of the lake by day (YYYYMMDD)."""
    rows = domain_day.groupBy(F.date_format("dt", "yyyyMMdd").alias("day")).agg(F.sum("n_rows").alias("n_rows"))
    kept = articles.groupBy(F.date_format("dt", "yyyyMMdd").alias("day")).agg(F.count("*").alias("relevant"))
    return rows.join(kept, "day", "full").fillna(0, ["n_rows", "relevant"])
