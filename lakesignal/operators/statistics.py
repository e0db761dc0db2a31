"""Intervals and decision rules."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesignal.operators import draws

#: Ranges into which the resamples of each group are dealt.
PARTS = 16
#: 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """Share and its Wilson 95 % limits; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    mid, bottom = p + Z95**2 / (2 * n), 1 + Z95**2 / n
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    return p, (mid - half) / bottom, (mid + half) / bottom


def above(low: Column, value: float = 0.0) -> Column:
    return low > value


def below(high: Column, value: float = 0.0) -> Column:
    return high < value


def within(low: Column, high: Column, margin: float) -> Column:
    return (low > -margin) & (high < margin)


def clusters(df: DataFrame, group: str, cluster: str, num: Column, den: Column, *by: str) -> DataFrame:
    """Numerator and denominator of each cluster."""
    return df.groupBy(*by, group, cluster).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))


def ratio_differences(table: DataFrame, one: str, others: tuple[str, ...] | None, group: str = "group", cluster: str = "cluster", resamples: int = 2000, by: str | None = None) -> DataFrame:
    """Difference of one group's ratio of sums to each other's (None: every
    other's), with its cluster-bootstrap 95 % percentile interval: reference,
    value, low, high.  With ``by``, a column without nulls, for each of its
    values, which comes first; their draws are of the same digests, made once.

    Draw k of resample b picks the cluster numbered md5(b, k, group) modulo the
    group's number of clusters.  The numbered sums go to PARTS ranges of the
    resamples; the draws are made there in arrays (see ``draws``) and summed at
    once, so they are rows nowhere, whatever the number of clusters.
    """
    wanted = F.col(group).isNotNull() if others is None else F.col(group).isin(one, *others)
    own = table.where(wanted).select((F.lit(0) if by is None else F.col(by)).alias("s"), F.col(group).alias("g"), F.col(cluster).alias("c"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    total = own.groupBy("s", "g").agg((F.sum("num") / F.sum("den")).alias("p"))
    numbered = own.select("s", "g", (F.row_number().over(Window.partitionBy("s", "g").orderBy("c")) - 1).alias("i"), "num", "den")
    parts = min(PARTS, resamples)
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "g", "part")  # a stated number, as so few bytes would else go to one task

    def resampled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("s", "ascending"), ("i", "ascending")])
        g, part = (x.as_py() for x in key)
        first, end = (x * resamples // parts for x in (part, part + 1))
        each = rows["s"].unique()
        tables = [rows.filter(pc.equal(rows["s"], s)).combine_chunks() for s in each]
        sums = draws.sums(first, end, str(g), [[x[c].combine_chunks() for c in ("num", "den")] for x in tables])
        found = [pa.table({"s": pa.array([s.as_py()] * (end - first), s.type), "g": pa.array([g] * (end - first), key[0].type), "b": range(first, end), "num": pa.array(num, pa.float64()), "den": pa.array(den, pa.float64())}) for s, (num, den) in zip(each, sums, strict=True)]
        return pa.concat_tables(found)

    study, kind = (own.schema[x].dataType.simpleString() for x in ("s", "g"))
    ratios = dealt.groupBy("g", "part").applyInArrow(resampled, f"s {study}, g {kind}, b bigint, num double, den double").select("s", "g", "b", (F.col("num") / F.col("den")).alias("r"))
    mine = F.max(F.when(F.col("g") == one, F.col("r"))).over(Window.partitionBy("s", "b"))
    spread = ratios.withColumn("r1", mine).where(F.col("g") != one).groupBy("s", "g").agg(F.percentile(F.col("r1") - F.col("r"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    first = total.where(F.col("g") == one).select("s", F.col("p").alias("p1"))  # one row a study
    point = total.where(F.col("g") != one).join(F.broadcast(first), "s").select("s", "g", (F.col("p1") - F.col("p")).alias("value"))
    return point.join(spread, ["s", "g"]).select(*([] if by is None else [F.col("s").alias(by)]), F.col("g").alias("reference"), "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def ratio_difference(table: DataFrame, a: str, b: str, group: str = "group", cluster: str = "cluster", resamples: int = 2000) -> DataFrame:
    """``ratio_differences`` to one group: value, low, high (one row)."""
    return ratio_differences(table, a, (b,), group, cluster, resamples).select("value", "low", "high")


def all_above(differences: DataFrame, value: float = 0.0) -> DataFrame:
    """One row: whether every interval lies above the value."""
    return differences.agg(F.bool_and(above(F.col("low"), value)).alias("accepted"))


def all_below(differences: DataFrame, value: float = 0.0) -> DataFrame:
    """One row: whether every interval lies below the value."""
    return differences.agg(F.bool_and(below(F.col("high"), value)).alias("accepted"))


def equivalence(low: Column, high: Column, margin: float = 0.5) -> Column:
    """Three-way verdict; being within the margin is asked first."""
    return F.when(within(low, high, margin), "same within the margin").when((low <= 0) & (high >= 0), "no detectable difference").otherwise("different")


def joint_verdict(low: Column, high: Column, margin: float = 0.5) -> Column:
    """The verdict over all references; all within the margin is asked first,
    then whether all intervals hold 0."""
    inside, straddle = F.bool_and(within(low, high, margin)), F.bool_and((low <= 0) & (high >= 0))
    return F.when(inside, "same within the margin").when(straddle, "no detectable difference").otherwise("different")


def joint_equivalence(differences: DataFrame, margin: float = 0.5) -> DataFrame:
    """One row: the verdict over all references."""
    return differences.agg(joint_verdict(F.col("low"), F.col("high"), margin).alias("verdict"))


def normal_label(c: Column) -> Column:
    """y, n or null."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("y", "yes"), "y").when(x.isin("n", "no"), "n")


def precision(labelled: DataFrame, stratum: str = "stratum", label: str = "label") -> DataFrame:
    """k of n with the Wilson interval of each stratum; unlabelled rows drop out."""
    rows = labelled.withColumn("_y", normal_label(F.col(label))).where("_y IS NOT NULL")
    got = rows.groupBy(stratum).agg(F.count_if(F.col("_y") == "y").alias("k"), F.count("*").alias("n"))
    value, low, high = wilson(F.col("k"), F.col("n"))
    return got.select(stratum, "k", "n", value.alias("value"), low.alias("low"), high.alias("high"))


def better(precisions: DataFrame, one: str, other: str, stratum: str = "stratum") -> DataFrame:
    """Whether the first stratum's low limit exceeds the other's high one; null
    if either is missing."""
    return precisions.agg((F.max(F.when(F.col(stratum) == one, F.col("low"))) > F.max(F.when(F.col(stratum) == other, F.col("high")))).alias("accepted"))


def scaling(runs: DataFrame, keys: tuple[str, ...] = ("engine", "days"), workers: str = "workers", seconds: str = "wall_s") -> DataFrame:
    """Median, least and most time, speed-up over one worker, and efficiency."""
    got = runs.groupBy(*keys, workers).agg(F.median(seconds).alias("median"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.count("*").alias("n"))
    one = got.where(F.col(workers) == 1).select(*keys, F.col("median").alias("one"))
    return got.join(one, list(keys), "left").withColumn("speed_up", F.col("one") / F.col("median")).withColumn("efficiency", F.col("speed_up") / F.col(workers)).drop("one")


def beats(scaled: DataFrame, one: str = "spark", other: str = "python", engine: str = "engine", workers: str = "workers") -> DataFrame:
    """One row: whether the first engine's median is under the other's fastest
    run, both at the other's most workers; null if either did not run so."""
    top = scaled.where(F.col(engine) == other).agg(F.max_by(F.struct(workers, "min"), workers).alias("o")).select("o.*")
    same = scaled.where(F.col(engine) == one).select(F.col(workers).alias("w"), "median").join(F.broadcast(top), F.col("w") == F.col(workers))
    return same.agg(F.max(F.col("median") < F.col("min")).alias("beats"))
