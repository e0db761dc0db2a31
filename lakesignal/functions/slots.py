"""Fifteen-minute slots: 14-character UTC stamps and their timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"
MINUTES = 15


def slot_of(ts: Column, minutes: int = MINUTES) -> Column:
    """Start of the slot that holds a timestamp."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * minutes)))


def to_time(stamp: Column) -> Column:
    return F.to_timestamp(stamp, STAMP)


def to_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def shift(ts: Column, n: Column | int, minutes: int = MINUTES) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts) + F.lit(60 * minutes) * n)


def day_of(stamp: Column) -> Column:
    return F.to_date(F.substring(stamp, 1, 8), "yyyyMMdd")


def spine(df: DataFrame, ts: str = "ts", minutes: int = MINUTES) -> DataFrame:
    """Every slot from the first to the last of ``df``: one aggregated row,
    exploded (no cross join)."""
    step = F.expr(f"interval {minutes} minutes")
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b", step)).alias(ts))
