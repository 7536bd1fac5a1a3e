"""Streaming intake: new files once, objects once within a horizon, counts per source and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_captures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def once_per_object(stream: DataFrame, keys: list[str], time: str, horizon: str = "7 days") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark is past them."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), by, "n")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs until all that is there now is taken in, exactly once, into a Parquet table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
