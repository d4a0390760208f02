"""The daily platform-usage table (``platform_use`` + ``volume_use``)
maintained from an event stream with Structured Streaming.

Days are one-day tumbling event-time windows on ``datetime`` (its
wall-clock calendar day, independent of the session time zone), so
with a watermark each day is emitted once in append mode when it can no
longer change, and its state is dropped.  Events without a timestamp
cannot be placed in a window and are not counted here (the batch report
counts them under their ``date``).  The per-day counts are ordinary
streaming aggregations (partial aggregation before the state shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import PLATFORMS


def wall_clock_as_utc(c: str) -> F.Column:
    """The TIMESTAMP_NTZ wall-clock time as the same wall-clock time in UTC,
    so one-day windows are calendar days whatever the session time zone."""
    t = F.col(c)
    return F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t),
                            F.date_part(F.lit("SECOND"), t), F.lit("UTC"))


def platform_use_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming DataFrame: date, web, android, ios, volume — one row per day."""
    agg = (events.withColumn("_ts", wall_clock_as_utc("datetime"))
           .withWatermark("_ts", watermark)
           .groupBy(F.window("_ts", "1 day").alias("_day"))
           .agg(*[F.count(F.when(F.col("platform") == p, F.lit(1))).alias(p) for p in PLATFORMS],
                F.sum("volume").alias("volume")))
    # the window starts at a UTC midnight; its calendar date from epoch days
    day = F.date_add(F.lit("1970-01-01").cast("date"),
                     F.floor(F.unix_seconds(F.col("_day.start")) / 86400).cast("int"))
    return agg.select(day.alias("date"), *PLATFORMS, "volume")


def start_platform_use(events: DataFrame, path: str, checkpoint: str, watermark: str = "1 day",
                       trigger: dict | None = None) -> StreamingQuery:
    """Append finished days to Parquet at ``path``; ``checkpoint`` must be on
    shared, reliable storage so the query survives driver and executor loss."""
    w = (platform_use_stream(events, watermark).writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
