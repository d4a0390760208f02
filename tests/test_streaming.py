"""The streamed daily usage table equals the batch report."""

import os
import time

from cohortlens.operators import platform
from cohortlens.sources import testdata
from cohortlens.sources.tables import EVENTS_SCHEMA
from cohortlens.streaming.usage import platform_use_stream, start_platform_use

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    testdata.events(spark, SF).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (platform_use_stream(stream).writeStream.format("memory").queryName("daily_usage")
         .outputMode("complete").option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.date: (r.web, r.android, r.ios, r.volume) for r in spark.table("daily_usage").collect()}
    batch_events = spark.read.parquet(src)
    counts = {r.date: (r.web, r.android, r.ios) for r in platform.platform_use(batch_events).collect()}
    volume = {r.date: r.volume for r in platform.volume_use(batch_events).collect()}
    want = {d: counts[d] + (volume[d],) for d in counts}
    assert got == want


def test_append_mode_writes_closed_days(spark, tmp_path):
    src = str(tmp_path / "events")
    testdata.events(spark, SF).write.parquet(src)
    stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(src)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = start_platform_use(stream, out, ckpt, watermark="1 hour", trigger={"availableNow": True})
    q.awaitTermination(120)
    deadline = time.time() + 30
    while not os.path.exists(out) and time.time() < deadline:
        time.sleep(0.5)
    written = spark.read.parquet(out).collect() if os.path.exists(out) else []
    batch = {r.date: r.web for r in platform.platform_use(spark.read.parquet(src)).collect()}
    # every emitted day is final and equals the batch value
    assert all(batch[r.date] == r.web for r in written)


def test_stream_days_do_not_depend_on_session_time_zone(spark, tmp_path):
    src = str(tmp_path / "events")
    testdata.events(spark, SF).write.parquet(src)
    want = {r.date: r.web for r in platform.platform_use(spark.read.parquet(src)).collect()}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for i, tz in enumerate(("America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", tz)
            stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(src)
            q = (platform_use_stream(stream).writeStream.format("memory").queryName(f"tz_usage_{i}")
                 .outputMode("complete").option("checkpointLocation", str(tmp_path / f"ckpt{i}")).start())
            q.processAllAvailable()
            q.stop()
            assert {r.date: r.web for r in spark.table(f"tz_usage_{i}").collect()} == want, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
