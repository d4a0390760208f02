"""Sessions kept over a stream equal the batch recalculation."""

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import T, events
from pyspark.sql import functions as F

from cohortlens.operators.sessions import session_buckets
from cohortlens.params import Params
from cohortlens.sources.tables import EVENTS_SCHEMA
from cohortlens.streaming.sessions import PROVIDER, ROCKSDB, DaySessions, session_stream, start_sessions

P = Params()
COLUMNS = ["user_id", "date", "datetime", "platform", "volume", "fee", "bucket", "events"]


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    yield
    spark.conf.set(PROVIDER, before)


def _batch(spark, rows, before):
    """The batch sessions of the days before ``before``."""
    out = session_buckets(events(spark, rows), P).withColumnsRenamed({"_grp": "bucket", "_events": "events"})
    return Counter(tuple(r) for r in out.filter(F.col("date") < F.lit(before)).select(*COLUMNS).collect())


def _feed(spark, src, out, ckpt, rows):
    """Add the rows as one file and run the stream until it has read it."""
    events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_sessions(stream, out, ckpt, P, "6 hours", {"availableNow": True})
    q.awaitTermination(180)
    assert q.exception() is None
    state = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) if q.lastProgress else 0
    return Counter(tuple(r) for r in spark.read.parquet(out).select(*COLUMNS).collect()), state


def test_buckets_as_batch(spark):
    d = DaySessions(P)
    offsets = [0, 1, 359, 360, 361, 720, 721, 1080, 1081, 1439]
    got = session_buckets(events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 1) + dt.timedelta(minutes=k), volume=float(k))
                                         for k in offsets]), P).collect()
    want = Counter()
    for k in offsets:
        want[d.bucket(k * 60_000_000)] += k
    assert {r["_grp"]: r["volume"] for r in got} == dict(want)


def test_stream_equals_batch_over_restarts_and_late_events(spark, rocksdb, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    rng = random.Random(2)
    day = lambda d, n, lo=0: [dict(user_id=rng.choice([1, 1, 1, 2, 3]), platform=rng.choice(["web", "ios", None]),      # noqa: E731
                                   datetime=T(2023, 1, d, rng.randrange(lo, 24), rng.randrange(60), rng.randrange(60), rng.randrange(10 ** 6)),
                                   volume=rng.choice([None, 1.0, 2.5]), fee=rng.choice([None, 1, 2.5])) for _ in range(n)]
    first = day(1, 40, lo=12) + [dict(user_id=1, platform="web", datetime=T(2023, 1, 1, 23, 59, 59, 999999))]
    first += [dict(user_id=None, platform="web", datetime=T(2023, 1, 1, 5)), dict(user_id=1, platform="web")]
    got, held = _feed(spark, src, out, ckpt, first)
    assert not got and held > 0
    # earlier events of the first day come late, move its anchors, and a new run picks up the state
    late = [dict(user_id=u, platform=p, datetime=T(2023, 1, 1, 18, 5), fee=3) for u in (1, 2) for p in ("web", None)]
    got, _ = _feed(spark, src, out, ckpt, late + day(2, 5))
    got, _ = _feed(spark, src, out, ckpt, [dict(user_id=9, platform="web", datetime=T(2023, 1, 3, 1))])
    rows = first + late
    timed = [r for r in rows if r.get("datetime") and r["user_id"]]
    assert got == _batch(spark, timed, dt.date(2023, 1, 2))
    # too late: the day is closed; the third day and beyond close the rest and drop their state
    got_2, _ = _feed(spark, src, out, ckpt, [dict(user_id=1, platform="web", datetime=T(2023, 1, 1, 1))])
    got_3, state = _feed(spark, src, out, ckpt, [dict(user_id=9, platform="web", datetime=T(2023, 2, 1))])
    assert state < held             # one open day is left
    assert all(n == 1 for n in got_3.values()) and not got - got_3
    assert {r[1] for r in got_3} == {dt.date(2023, 1, d) for d in (1, 2, 3)}
    assert {k: n for k, n in got_3.items() if k[1] == dt.date(2023, 1, 1)} == {k: n for k, n in got.items() if k[1] == dt.date(2023, 1, 1)}


def test_needs_rocksdb(spark):
    if spark.conf.get(PROVIDER) != ROCKSDB:
        with pytest.raises(ValueError):
            session_stream(events(spark, []))
