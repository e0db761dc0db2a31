"""Session helpers: shared checkpoint folder, written tables, batch size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakesignal.session import shared_dir

BATCH_BYTES = 4 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for Python workers whatever a text's length;
    a bound on memory only, on which no result depends."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: its
    lineage is cut and it survives lost executors.  The folder
    ``lakesignal-<application id>`` may be deleted once the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakesignal-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
