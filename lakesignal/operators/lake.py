"""Silver and gold tables of the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.functions.records import is_relevant
from lakesignal.functions.slots import day_of


def silver(records: DataFrame) -> DataFrame:
    """Relevant articles, one for each (id, url), with their day."""
    kept = records.where(is_relevant(F.col("about_baltic"), F.col("domain")))
    return kept.dropDuplicates(["id", "url"]).drop("url").withColumn("dt", day_of(F.col("ts")))


def domain_day(records: DataFrame, day="dt", keys: tuple[str, ...] = ("group", "domain"), about: str = "about_baltic") -> DataFrame:
    """Rows and relevant rows by day and source; repeated rows count each."""
    return records.groupBy(day, *keys).agg(F.count("*").alias("n_rows"), F.count_if(about).alias("n_about"))


def theme_group(articles: DataFrame, themes: str = "themes", group: str = "group") -> DataFrame:
    one = articles.select(group, F.explode(themes).alias("theme"))
    return one.groupBy(group, "theme").agg(F.count("*").alias("count"))


def series(events: DataFrame, slot: str = "ts", group: str = "group") -> DataFrame:
    return events.groupBy(slot, group).agg(F.count("*").alias("count"))


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """All tables in the order of writing; the last one's success marks the set."""
    articles = silver(records)
    about = articles.where("about_baltic")
    return {
        "articles": articles,
        "domain_day": domain_day(records.withColumn("dt", day_of(F.col("ts")))),
        "theme_group": theme_group(about),
        "series_15m": series(about.where("security")),
    }


def write(records: DataFrame, root: str, single: bool = False) -> dict[str, int]:
    """Parse once, write four tables; ``single``: one file each but for the
    articles.  Gives rows read and relevant articles (see ``totals``)."""
    records = records.persist()
    try:
        for name, df in tables(records).items():
            if name == "articles":
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{root}/{name}")
            else:
                (df.coalesce(1) if single else df).write.mode("overwrite").parquet(f"{root}/{name}")
    finally:
        records.unpersist()
    spark = records.sparkSession
    return totals(spark.read.parquet(f"{root}/domain_day"), spark.read.parquet(f"{root}/articles")).first().asDict()


def totals(by_day: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: all rows read, and the relevant articles."""
    return by_day.agg(F.sum("n_rows").alias("rows")).join(F.broadcast(articles.agg(F.count("*").alias("relevant"))))


def done(spark: SparkSession, root: str) -> bool:
    """Whether the table written last is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/series_15m/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate (a partial one first)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")
