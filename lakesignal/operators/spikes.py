"""Spike detector as window expressions.

Score of a slot: (observed - median) / (1.4826 MAD + 1), observed being the
count of the last four slots, and median and MAD those of the last 14 hourly
values of the same group, weekend flag and hour.  An alert is the rising edge
of a high score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesignal.functions.slots import spine

Z, MIN_COUNT, HISTORY, MIN_HISTORY, SLOTS_PER_HOUR = 4.0, 8, 14, 5, 4
MAD_SCALE = 1.4826


def dense(series: DataFrame, groups: list[str], slot: str = "ts", group: str = "group", value: str = "count") -> DataFrame:
    """Every slot and group, gaps 0."""
    grid = spine(series, slot).select(slot, F.explode(F.array(*map(F.lit, groups))).alias(group))
    return grid.join(series, [slot, group], "left").select(slot, group, F.coalesce(value, F.lit(0)).alias(value))


def rolling(df: DataFrame, slot: str = "ts", group: str = "group", value: str = "count", width: int = SLOTS_PER_HOUR, strict: bool = False) -> DataFrame:
    """Sum of the last ``width`` rows; null until there are as many if strict."""
    w = Window.partitionBy(group).orderBy(slot).rowsBetween(1 - width, 0)
    total = F.sum(value).over(w)
    return df.withColumn("observed", F.when(F.count("*").over(w) == width, total) if strict else total)


def median_of(a):
    """Median of a sorted array of numbers."""
    n = F.size(a)
    high = F.get(a, F.floor(n / 2).cast("int")).cast("double")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, high).otherwise((F.get(a, (F.floor(n / 2) - 1).cast("int")).cast("double") + high) / 2)


def seasonal(df: DataFrame, slot: str = "ts", group: str = "group", history: int = HISTORY) -> DataFrame:
    """Median and MAD of the last ``history`` hourly values before each slot."""
    w = Window.partitionBy(group, "weekend", "hour").orderBy(slot).rowsBetween(-4 * history - 4, -1)
    keyed = df.withColumn("weekend", F.weekday(slot) >= 5).withColumn("hour", F.hour(slot))
    past = F.slice(F.reverse(F.collect_list(F.when(F.minute(slot) == 45, F.col("observed"))).over(w)), 1, history)
    got = keyed.withColumn("past", F.array_sort(past)).withColumn("n_history", F.size("past")).withColumn("median", median_of(F.col("past")))
    return got.withColumn("mad", median_of(F.array_sort(F.transform("past", lambda x: F.abs(x - F.col("median")))))).drop("past")


def scores(df: DataFrame, z: float = Z, min_count: int = MIN_COUNT, min_history: int = MIN_HISTORY) -> DataFrame:
    """Evaluated slots with their score."""
    rows = df.where(F.col("n_history") >= min_history)
    rows = rows.withColumn("score", (F.col("observed") - F.col("median")) / (MAD_SCALE * F.col("mad") + 1))
    return rows.withColumn("high", (F.col("score") >= z) & (F.col("observed") >= min_count))


def alerts(scored: DataFrame, slot: str = "ts", group: str = "group") -> DataFrame:
    w = Window.partitionBy(group).orderBy(slot)
    return scored.withColumn("was", F.lag("high", 1, False).over(w)).where("high AND NOT was").drop("was")


def detect(series: DataFrame, groups: list[str], slot: str = "ts", group: str = "group", value: str = "count", z: float = Z, min_count: int = MIN_COUNT) -> DataFrame:
    """Alerts of a sparse series: group, slot, observed, expected, score."""
    full = rolling(dense(series, groups, slot, group, value), slot, group, value)
    found = alerts(scores(seasonal(full, slot, group), z, min_count), slot, group)
    return found.select(group, F.col(slot).alias("slot"), F.col("observed").cast("long").alias("observed"), F.col("median").alias("expected"), F.round("score", 2).alias("score"))
