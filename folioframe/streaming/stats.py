"""Running statistics of operations, as a batch query and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running(events: DataFrame, *by) -> DataFrame:
    """Count, total, least and most thousandths of each event type; the same plan over a batch or a stream."""
    v = F.floor(F.col("value") * 1000).cast("long")
    return events.where("value is not null").groupBy(*by, "event_type").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New event files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics by event-time window; events later than the watermark are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return running(events.withWatermark("ts", late), F.window("ts", width))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
