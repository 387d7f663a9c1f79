"""Incremental counts on Structured Streaming, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, kind: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/tallyfield-shared"
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def to_end(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Process all available input; each batch's rows are written under its number, so a batch that runs twice counts once, and the last one of a key wins."""
    spark = stream.sparkSession
    out, log = _folder(spark, "stream-out"), _folder(spark, "stream-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the integer part of values, by event type, kept as state."""
    events = events_stream(spark, sf_dir).select("event_type", F.floor("value").cast("int").alias("n"))
    return to_end(events.groupBy("event_type", "n").agg(F.count("*").alias("c")), "update", ["event_type", "n"])


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals under a watermark."""
    windows = events_stream(spark, sf_dir).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("k"), F.sum("value").alias("total"))
    done = to_end(windows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "k", "total"), "update", ["day", "event_type"])
    return done.withColumn("total", F.round("total", 4))
