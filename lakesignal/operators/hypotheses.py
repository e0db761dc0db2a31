"""The hypotheses over the lake's tables: attention and tone of one source group
against others, each a rule over cluster-bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.operators import statistics as T

ONE, FOREIGN = "ru_by", ("other", "regional")
MARGIN = 0.5


def shares(domain_day: DataFrame) -> DataFrame:
    """Each group's share of rows that are about the region, and its sources."""
    got = domain_day.groupBy("group").agg(F.sum("n_about").alias("n_about"), F.sum("n_rows").alias("n_rows"), F.count_distinct("domain").alias("domains"))
    return got.withColumn("share", F.col("n_about") / F.col("n_rows"))


def attention(domain_day: DataFrame, one: str = ONE, others: tuple[str, ...] = FOREIGN, resamples: int = 2000) -> DataFrame:
    """The group's share less each other group's: reference, value, low, high."""
    table = T.clusters(domain_day, "group", "domain", F.col("n_about"), F.col("n_rows"))
    return T.ratio_differences(table, one, others, "group", "domain", resamples)


def attention_accepted(domain_day: DataFrame, **more) -> DataFrame:
    """One row: the share is larger than every other group's."""
    return T.all_above(attention(domain_day, **more))


def toned(articles: DataFrame) -> DataFrame:
    """Articles about the region that have a tone."""
    return articles.where(F.col("about_baltic") & F.col("tone").isNotNull() & ~F.isnan("tone"))


def reference_of() -> Column:
    """The comparison group of an article: foreign outlets of the translated
    feed, and local outlets in the same language; null for others."""
    return F.when((F.col("group") == "other") & (F.col("feed") == "tr"), "other (translated)").when(F.col("group") == "baltic_rus", "baltic_rus")


def sided(articles: DataFrame, one: str = ONE, named: Column | None = None) -> DataFrame:
    """Articles of the group and of the comparison groups that have a tone."""
    side = F.when(F.col("group") == one, one).otherwise(reference_of() if named is None else named)
    return toned(articles).withColumn("side", side).where("side IS NOT NULL")


def tone_differences(articles: DataFrame, security: bool, one: str = ONE, named: Column | None = None, resamples: int = 2000) -> DataFrame:
    """The group's mean tone less each comparison group's, on security stories
    or on the others: reference, value, low, high."""
    table = T.clusters(sided(articles, one, named).where(F.col("security") == security), "side", "domain", F.col("tone"), F.lit(1))
    return T.ratio_differences(table, one, None, "side", "domain", resamples)


def mean_tone(articles: DataFrame) -> DataFrame:
    """Mean tone of each group on security stories and on the others."""
    got = articles.where("about_baltic").groupBy("group").pivot("security", [False, True]).agg(F.avg(F.nanvl("tone", F.lit(None).cast("double"))))
    return got.select("group", F.col("false").alias("other_stories"), F.col("true").alias("security"))


def framing(articles: DataFrame, margin: float = MARGIN, one: str = ONE, named: Column | None = None, resamples: int = 2000) -> DataFrame:
    """One row: tone is lower than every reference's on other stories; and the
    verdict on security stories.  Both studies are of the same draws."""
    table = T.clusters(sided(articles, one, named).where("security IS NOT NULL"), "side", "domain", F.col("tone"), F.lit(1), "security")
    differences = T.ratio_differences(table, one, None, "side", "domain", resamples, by="security")
    on_security, on_others = ([F.when(x, F.col(c)) for c in ("low", "high")] for x in (F.col("security"), ~F.col("security")))
    return differences.agg(F.bool_and(T.below(on_others[1])).alias("lower_accepted"), T.joint_verdict(*on_security, margin).alias("verdict"))
