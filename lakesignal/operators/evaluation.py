"""Blind evaluation: strata of matched pairs, sheets without their keys, and
slots with and without an alert.

Random draws are orders by md5 of a seed and the item, so they repeat.  Sheets
are samples (n rows a stratum), so their numbering is over few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesignal.operators import matching, spikes
from lakesignal.operators import statistics as T

SEED, BUSY, HIGH_COS, MID_COS, MIN_SHARED = "7", 8, 0.7, 0.5, 2
SHOWN_PAIR, SHOWN_SLOT = ("src_title", "dst_title"), ("group", "ts", "headlines")


def _hash(*columns: str, seed: str = SEED):
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def strata(pairs: DataFrame) -> DataFrame:
    """Rows (stratum, src_id, src_title, dst_title): as many best cosines as there are
    entity matches, high cosines, middle ones, and the entity matches."""
    ent = pairs.where(F.col("ent_shared") >= MIN_SHARED)
    emb = pairs.where(F.col("emb_cos") >= 0)

    def titled(df: DataFrame, name: str, method: str) -> DataFrame:
        return df.select(F.lit(name).alias("stratum"), "src_id", "src_title", F.col(f"{method}_title").alias("dst_title"))

    parts = [
        titled(matching.equal_coverage(emb, "emb_cos", ent, "src_id"), "emb_top", "emb"),
        titled(emb.where(F.col("emb_cos") >= HIGH_COS), "emb_high", "emb"),
        titled(emb.where((F.col("emb_cos") >= MID_COS) & (F.col("emb_cos") < HIGH_COS)), "emb_mid", "emb"),
        titled(ent, "ent", "ent"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def draw(items: DataFrame, stratum: str, by: str, n: int, seed: str = SEED) -> DataFrame:
    """n rows of each stratum, in a random order of the column ``by``."""
    w = Window.partitionBy(stratum).orderBy(_hash(by, seed=seed), by)
    return items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def blind(items: DataFrame, shown: tuple[str, ...], seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): the distinct items numbered in a random order with an
    empty label, and all columns of the items with their number."""
    order = Window.orderBy(_hash(*shown, seed=seed), *shown)  # a drawn sample: few rows
    numbered = items.select(*shown).distinct().withColumn("item", F.row_number().over(order))
    same = None
    for c in shown:
        one = F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
        same = one if same is None else same & one
    key = items.alias("i").join(F.broadcast(numbered.alias("s")), same).select("i.*", "s.item")
    return numbered.select("item", *shown, F.lit("").alias("label")), key


def pair_sheet(pairs: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Sheet and key of n pairs a stratum; a pair of two strata is one item."""
    return blind(draw(strata(pairs), "stratum", "src_id", n), SHOWN_PAIR)


def hours(dense: DataFrame, alerts: DataFrame, slot: str = "ts", group: str = "group", value: str = "count") -> DataFrame:
    """Every (slot, group) of a dense series with its rolling hour, and whether
    the detector alerted there (``alerts``: slot, group)."""
    rolled = spikes.rolling(dense, slot, group, value).select(slot, group, F.col("observed").alias(value))
    hit = alerts.select(F.col("slot").alias(slot), group).distinct().withColumn("_a", F.lit(True))
    return rolled.join(hit, [slot, group], "left").withColumn("alert", F.col("_a").isNotNull()).drop("_a")


def strongest(alerts: DataFrame, n: int, group: str = "group") -> DataFrame:
    """The n alerts of the highest score, ties to the earlier slot."""
    return alerts.orderBy(F.desc("score"), "slot", group).limit(n)


def quiet(table: DataFrame, n: int, busy: int = BUSY, slot: str = "ts", group: str = "group", value: str = "count", seed: str = SEED) -> DataFrame:
    """n busy hours without an alert."""
    return table.where(~F.col("alert") & (F.col(value) >= busy)).orderBy(_hash(slot, group, seed=seed), slot, group).limit(n)


def slot_items(dense: DataFrame, alerts: DataFrame, n: int = 10, busy: int = BUSY, slot: str = "ts", group: str = "group", value: str = "count") -> DataFrame:
    """The hours of the n strongest alerts and n busy hours without one."""
    table = hours(dense, alerts, slot, group, value)
    picked = table.join(F.broadcast(strongest(alerts, n, group).select(F.col("slot").alias(slot), group)), [slot, group])
    return picked.unionByName(quiet(table, n, busy, slot, group, value))


def slot_sheet(dense: DataFrame, alerts: DataFrame, articles: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sheet and key of slots, each with the first headlines of its hour."""
    items = slot_items(dense, alerts, n).withColumn("t", F.unix_seconds("ts"))
    titles = articles.where("about_baltic AND security").select("group", F.unix_seconds("ts").alias("t"), "title")
    shown = items.join(matching.headlines(items.select("group", "t"), titles, 2700, 8), ["group", "t"], "left")
    return blind(shown.drop("t").withColumn("headlines", F.coalesce("headlines", F.lit(""))), SHOWN_SLOT)


def scored(sheet: DataFrame, key: DataFrame, by: str) -> DataFrame:
    """Precision of the labelled items by a column of the key."""
    return T.precision(key.join(sheet.select("item", "label"), "item"), by, "label")


def match_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, the share with a high cosine, and with shared names."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg((F.col("emb_cos") >= HIGH_COS).cast("double")).alias("share_cos"), F.avg((F.col("ent_shared") >= MIN_SHARED).cast("double")).alias("share_ent"))
