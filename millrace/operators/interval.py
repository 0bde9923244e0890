"""Anti-joins over an interval of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_near(rows: DataFrame, others: DataFrame, seconds: int = 15, key: list[str] | None = None, time: str = "ts", row_id: str = "id") -> DataFrame:
    """The ``rows`` without one of ``others`` at most ``seconds`` away (with an equal ``key``).

    Time is cut in buckets of that width, so a near pair lies in the same or in
    neighbouring buckets: an equality join, where the plain condition would meet every
    pair. Of each bucket of ``others`` only the first and the last time are kept: in a
    row's own bucket all are near, of the bucket before the last is the nearest and of
    the bucket after the first. A hot bucket thus meets one row and the join cannot
    multiply. Rows with a null time or key have no neighbour and stay.
    """
    key = key or []
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    bucket = lambda at: F.floor(at / F.lit(max(width, 1))).cast("long")
    ends = (
        others.where(F.col(time).isNotNull()).withColumn("_at", micros(time))
        .groupBy(*key, bucket(F.col("_at")).alias("_bucket")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    asked = rows.where(F.col(time).isNotNull()).select(*key, F.col(row_id).alias("_id"), micros(time).alias("_at"))
    asked = asked.withColumn("_bucket", F.explode(F.array(*[bucket(F.col("_at")) + d for d in (-1, 0, 1)])))
    # In its own bucket every member is under a bucket's width away; to the left the last is nearest, to the right the first.
    near = (F.abs(F.col("_at") - F.col("_first")) <= width) | (F.abs(F.col("_at") - F.col("_last")) <= width)
    found = asked.join(ends, [*key, "_bucket"]).where(near).select(F.col("_id").alias(row_id)).distinct()
    return rows.join(found, row_id, "left_anti")


def drop_near_plain(rows: DataFrame, others: DataFrame, seconds: int = 15, key: list[str] | None = None, time: str = "ts") -> DataFrame:
    """The same as a plain condition, for a small ``others`` and for tests."""
    o = others.select(*[F.col(k).alias(f"_{k}") for k in key or []], F.col(time).alias("_time"))
    gap = F.expr(f"interval {int(seconds)} seconds")
    on = F.col("_time").between(F.col(time) - gap, F.col(time) + gap)
    for k in key or []:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(o, on, "left_anti")


def segment_order() -> list:
    """Segments by time, live before background, then row id."""
    return [F.col("captured_at"), F.when(F.col("source") == "live", 0).otherwise(1), F.col("id")]


def screen_segments(df: DataFrame, hallucinated: list[str] = ()) -> DataFrame:
    """Without empty text, cloud-only audio and speakers known to be hallucinated."""
    speaker = F.lower(F.coalesce("speaker_name", F.lit("")))
    return df.where((F.trim(F.coalesce("transcript", F.lit(""))) != "") & ~F.coalesce("cloud_only", F.lit(False)) & ~speaker.isin(*[h.lower() for h in hallucinated or ["\0"]]))


def within(df: DataFrame, start, end, time: str = "captured_at") -> DataFrame:
    """Rows inside a window of time, both ends included; pushed down to the scan."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))
