"""Metrics of scores as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream; files that come later are read as they come."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_values(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean, largest) of each window; rows later than `late` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("largest")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "largest")


def running_confusion(scored: DataFrame) -> DataFrame:
    """(relation, tp, fp, tn, fn) so far, of a stream of label and p_yes; state is one row a relation."""
    said, true = F.col("p_yes") >= 0.5, F.col("label") == 1
    return scored.groupBy("relation").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))
