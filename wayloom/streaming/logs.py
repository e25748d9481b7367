"""Edit logs as streams: the chains of ``wayloom.operators.oplog`` as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "log_id long, seq long, key long, type string, before long, after long, ts timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of path as they arrive, with the columns of LOG."""
    return spark.readStream.schema(LOG).parquet(path)


def windowed_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Operations by log, type and window of time; a window is final when ``late`` has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "log_id", "type").agg(F.count("*").alias("n")).select("log_id", "type", F.col("window.start").alias("start"), "n")


def latest(stream: DataFrame) -> DataFrame:
    """For each key so far: how many operations, the first state before and the last one after."""
    return stream.groupBy("log_id", "key").agg(F.count("*").alias("n"), F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"), F.max_by("type", "seq").alias("type"))
