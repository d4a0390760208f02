"""The anchored session recalculation (``events_updated`` without ids) kept over an
event stream.

The state of a (user, platform, day) is a list of the day's event times with the
sums at each: an earlier event that comes late moves the anchor, and with it the
edge of every bucket, so sums per bucket would not be enough.  When the watermark
passes the end of the day, no event of it can come any more: the buckets are cut
from the anchor, emitted once (append mode), and the state is dropped.  Events
later than the watermark are left out by Spark, and events without a user or a
timestamp here (the batch report has none of the former and puts the latter into
the last bucket).  A day is the calendar day of ``datetime``.

State lies in RocksDB, so it need not fit a task's memory; a day is cut in two
passes over its list with at most ``max_bucket`` sums at hand.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..params import DEFAULT, Params
from .usage import wall_clock_as_utc

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000           # microseconds
TIMES = "micros long, volume double, fee decimal(28,2)"
BUCKETS = "user_id long, platform string, date date, bucket int, micros long, volume double, fee decimal(28,2), events long"
EPOCH = dt.date(1970, 1, 1)


def _plus(a, b):
    """SUM of two values that may be null."""
    return b if a is None else a if b is None else a + b


class DaySessions(StatefulProcessor):
    """Buckets of one (user, platform, day) at the end of that day."""

    def __init__(self, params: Params):
        self.width, self.last = params.bucket_minutes * MINUTE, params.max_bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", TIMES + ", events long")

    def bucket(self, offset: int) -> int:
        """1 below one width, k up to and including k widths, the last beyond."""
        if offset < self.width:
            return 1
        return min(max(2, -(-offset // self.width)), self.last)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            sums: dict[int, tuple] = {}
            for micros, volume, fee in zip(part["micros"], part["volume"], part["fee"]):
                known = sums.get(int(micros), (None, None, 0))
                sums[int(micros)] = (_plus(known[0], None if pd.isna(volume) else float(volume)),
                                     _plus(known[1], None if pd.isna(fee) else fee), known[2] + 1)
            self.times.appendList([(micros, *s) for micros, s in sums.items()])
        day_end = (key[2] - EPOCH).days + 1
        self.handle.registerTimer(day_end * 86_400_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        anchor = min(row[0] for row in self.times.get())
        cut: dict[int, list] = {}
        for micros, volume, fee, n in self.times.get():
            at = cut.setdefault(self.bucket(micros - anchor), [micros, None, None, 0])
            at[:] = min(at[0], micros), _plus(at[1], volume), _plus(at[2], fee), at[3] + n
        self.times.clear()
        rows = [(*key, k, *v) for k, v in sorted(cut.items())]
        names = ["user_id", "platform", "date", "bucket", "micros", "volume", "fee", "events"]
        yield pd.DataFrame(rows, columns=names).astype({"bucket": "int32", "volume": "float64"})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, params: Params = DEFAULT, watermark: str = "1 day") -> DataFrame:
    """Streaming DataFrame user_id, date, datetime, platform, volume, fee, bucket, events
    of every closed day; the session's state store must be RocksDB."""
    if events.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"session_stream needs {PROVIDER}={ROCKSDB}")
    timed = (events.filter(F.col("user_id").isNotNull() & F.col("datetime").isNotNull())
             .withColumn("_ts", wall_clock_as_utc("datetime")).withWatermark("_ts", watermark)
             .select("user_id", "platform", F.to_date("datetime").alias("date"), F.unix_micros("_ts").alias("micros"),
                     "volume", F.col("fee").cast("decimal(28,2)").alias("fee"), "_ts"))
    out = (timed.groupBy("user_id", "platform", "date")
           .transformWithStateInPandas(DaySessions(params), BUCKETS, "append", "EventTime"))
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return out.select("user_id", "date", F.timestamp_add("MICROSECOND", F.col("micros"), start).alias("datetime"),
                      "platform", "volume", "fee", "bucket", "events")


def start_sessions(events: DataFrame, path: str, checkpoint: str, params: Params = DEFAULT,
                   watermark: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Append the sessions of closed days to Parquet at ``path``; ``checkpoint`` must be on
    shared, reliable storage, from which the state is restored after a loss."""
    w = (session_stream(events, params, watermark).writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(**trigger) if trigger else w).start()
