"""Windows over event streams: the streaming forms of gap merging and fixed-bin summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, layout: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files with a time column ``ts``."""
    out = spark.readStream.schema(layout).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Events of a key at most ``gap`` apart, as sessions: start, end, n and the sum of ``value``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def bins(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", value: str = "value") -> DataFrame:
    """Tumbling (or sliding) windows: n, total, mean, least and most of ``value``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(key, window.alias("w")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "mean", "least", "most")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all there is and append it to Parquet, once each."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
