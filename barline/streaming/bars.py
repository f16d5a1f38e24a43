"""Bars from a stream of ticks: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_ticks(spark: SparkSession, folder: str, schema: str = TICKS, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_bars(ticks: DataFrame, unit: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and volume of `value` by event_type and window; ticks later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", unit), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("ticks"))
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "ticks")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet, exactly once; runs over what is there and stops."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
