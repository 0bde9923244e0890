"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of an events table; its times have no zone, so they are cast in that of the session."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_in_window(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Exact duplicates that arrive within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user_id, started, ended, n)`` per session of activity."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    made = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(started, event_type, n, value)`` per tumbling or sliding window."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    made = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return made.select(F.col("w.start").alias("started"), "event_type", "n", "value")


def unanswered(asked: DataFrame, answers: DataFrame, seconds: int = 15, late: str = "10 minutes") -> DataFrame:
    """Rows of one stream without a near row of the other: a stream-stream outer join, then the nulls."""
    a = asked.withWatermark("ts", late)
    b = answers.withWatermark("ts", late).select(F.col("user_id").alias("_user"), F.col("ts").alias("_ts"))
    near = F.expr(f"user_id = _user and _ts between ts - interval {int(seconds)} seconds and ts + interval {int(seconds)} seconds")
    return a.join(b, near, "leftOuter").where("_ts is null").drop("_user", "_ts")


def emit(stream: DataFrame, write, checkpoint: str, **trigger):
    """Results as they come: ``write(batch, id)`` for each micro-batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
