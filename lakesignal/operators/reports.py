"""The frames behind the report's figures and its summary; drawing is left out."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.records import GROUPS
from lakesignal.functions.slots import STAMP
from lakesignal.operators import hypotheses, spikes
from lakesignal.operators import statistics as T

#: A slot closed within so many seconds of its end was not catching up.
STEADY = 3600
LEAST, LABEL = 100, 40
# Prefixes of themes that name a language or a people.
LEXICAL = ("TAX_WORLDLANGUAGES_", "TAX_ETHNICITY_")


def attention_frame(domain_day: DataFrame, groups: tuple[str, ...] = ("ru_by", "regional", "other")) -> DataFrame:
    """Percentage of each group's rows about the region."""
    return hypotheses.shares(domain_day).where(F.col("group").isin(*groups)).select("group", (100 * F.col("share")).alias("percent"))


def theme_ratios(counts: DataFrame, one: str = "ru_by", other: str = "other", least: int = LEAST, also: tuple[str, ...] = ("baltic",), without: tuple[str, ...] = LEXICAL) -> DataFrame:
    """ln of the theme's share in one group over that in the other, of themes
    that come ``least`` times in both and in ``also``; shares are of all themes.
    ``counts``: group, theme, count."""
    wanted = (one, other, *also)
    wide = counts.groupBy("theme").pivot("group", list(wanted)).agg(F.sum("count")).fillna(0)
    total = counts.agg(*[F.sum(F.when(F.col("group") == g, F.col("count"))).alias(f"_{n}") for n, g in enumerate((one, other))])  # one row
    often = wide.where(F.least(*[F.col(f"`{g}`") for g in wanted]) >= least if len(wanted) > 1 else F.col(f"`{one}`") >= least)
    for p in without:
        often = often.where(~F.col("theme").startswith(p))
    got = often.join(F.broadcast(total))
    return got.select("theme", *[F.col(f"`{g}`") for g in wanted], F.ln((F.col(f"`{one}`") / F.col("_0")) / (F.col(f"`{other}`") / F.col("_1"))).alias("log_ratio"))


def both_ends(rows: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n least and the n greatest rows; two ordered limits, no global window."""
    low, high = rows.orderBy(by, tie).limit(n), rows.orderBy(F.desc(by), F.desc(tie)).limit(n)
    return low.union(high).distinct()


def theme_frame(counts: DataFrame, top: int = 8) -> DataFrame:
    """The themes at either end, with their label as drawn."""
    return both_ends(theme_ratios(counts), "log_ratio", "theme", top).select("theme", F.left("theme", F.lit(LABEL)).alias("label"), F.round("log_ratio", 3).alias("log_ratio"))


def tone_frame(articles: DataFrame) -> DataFrame:
    """Mean tone by group, in the fixed order of groups; groups without any go."""
    got = hypotheses.mean_tone(articles).where("other_stories IS NOT NULL OR security IS NOT NULL")
    return got.withColumn("place", F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group")))


def scaling_frame(runs: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Times by engine, days and workers with speed-up and efficiency; and the
    rule, decided on ``days`` days."""
    got = T.scaling(runs)
    return got, T.beats(got.where(F.col("days") == days))


def detector_frame(dense: DataFrame, alerts: DataFrame, slot: str = "ts", group: str = "group", value: str = "count") -> DataFrame:
    """Rolling hour of each group and slot (null until four slots), and whether
    an alert stands there."""
    line = spikes.rolling(dense, slot, group, value, strict=True).select(slot, group, "observed")
    hit = alerts.select(F.col("slot").alias(slot), group).distinct().withColumn("_a", F.lit(True))
    return line.join(hit, [slot, group], "left").withColumn("alert", F.col("_a").isNotNull()).drop("_a")


def steady(closed: DataFrame, seconds: int = STEADY) -> DataFrame:
    """Closed slots whose closing came within ``seconds`` of their end."""
    end = F.unix_seconds(F.to_timestamp("slot", STAMP)) + 900
    return closed.where(F.col("closed_at") - end < seconds)


def live(closed: DataFrame) -> DataFrame:
    """One row: slots, first, last, steady slots with their lag's median and
    95 % point, and medians of rows by slot; a slot's last line counts."""
    last = closed.groupBy("slot").agg(F.max_by(F.struct("rows", "about", "sent_at", "closed_at"), "closed_at").alias("x")).select("slot", "x.*")
    whole = last.agg(F.count("*").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.median("rows").alias("rows_per_slot"), F.median("about").alias("about_per_slot"))
    lag = F.col("closed_at") - F.col("sent_at")
    calm = steady(last).agg(F.count("*").alias("steady_slots"), F.median(lag).alias("lag_p50_s"), F.percentile(lag, F.lit(0.95)).alias("lag_p95_s"))
    return whole.join(F.broadcast(calm))  # one row each


def alert_counts(lines: DataFrame, group: str = "group") -> DataFrame:
    """Alerts by group; repeated lines count each."""
    return lines.groupBy(group).agg(F.count("*").alias("alerts"))


def alert_lines(closed: DataFrame) -> DataFrame:
    """The alerts that closed slots carry, one row each."""
    kind = "array<struct<`group`: string, slot: string, observed: bigint, expected: double, score: double>>"
    return closed.select(F.explode(F.from_json("alerts", kind)).alias("a")).select("a.*")


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the file and rename, so no reader sees half of it."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    beside = at.with_name(at.name + ".tmp")
    beside.write_bytes(data)
    os.replace(beside, at)


def write_json(path: str, parts: dict[str, DataFrame]) -> dict:
    """A JSON document of small results (sheets, one-row totals), each a list of rows."""
    found = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in parts.items()}
    write_atomic(path, json.dumps(found, indent=1, default=str).encode())
    return found
