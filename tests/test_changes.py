"""Snapshot differences, JSON properties and refresh by day against brute force."""

import contextlib
import datetime as dt
import io
import json
import os
import random
from collections import Counter

import pytest
from conftest import D, T, accounts, events

from cohortlens.operators import changes, platform
from cohortlens.params import Params
from cohortlens.plans.digests import differing, digests, multiset_diff
from cohortlens.sources.refresh import UNFINISHED, refresh_by_day, refreshed
from pyspark.sql import functions as F

P = Params()
SCHEMA = "a long, b long, c string"


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _diff(old, new):
    a, b = Counter(old), Counter(new)
    return {(*k, a[k], b[k]) for k in {*a, *b} if a[k] != b[k]}


@pytest.mark.parametrize("buckets", [1, 7, 65_536])
def test_multiset_diff(spark, buckets):
    rng = random.Random(5)
    row = lambda: (rng.choice([1, 2, None]), rng.choice([1, 2, None]), rng.choice(["x", "", None]))      # noqa: E731
    old = [row() for _ in range(80)] + [(7, 7, "hot")] * 500
    new = old[5:] + [row() for _ in range(6)] + [(7, 7, "hot")] * 2
    rng.shuffle(new)
    got = multiset_diff(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), buckets).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _diff(old, new)


def test_multiset_diff_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)      # noqa: E731
    # a null that changes its column, and copies whose exclusive or would vanish
    for old, new in [([(1, None, "x")], [(None, 1, "x")]), ([(1, 1, "a")] * 2, [(2, 2, "b")] * 2),
                     ([], [(1, 1, None)]), ([(None, None, None)], []), ([], []), ([(1, 2, "x")] * 3, [(1, 2, "x")] * 3)]:
        assert {tuple(r) for r in multiset_diff(make(old), make(new), 64).collect()} == _diff(old, new), (old, new)
    with pytest.raises(ValueError):
        multiset_diff(make([]), make([]).drop("c"), 64)


def test_equal_buckets_are_not_compared(spark, tmp_path):
    rows = [(k, k % 3, str(k)) for k in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([*rows[1:], (400, 1, "n")], SCHEMA).write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    bucket = {"_k": F.pmod(F.col("a"), F.lit(100))}
    assert {r["_k"] for r in differing(digests(a, bucket), digests(b, bucket), ["_k"]).collect()} == {0}
    plan = _plan(multiset_diff(a, b, 1024))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftSemi" in plan


def test_account_changes(spark):
    rng = random.Random(8)
    day = lambda k: D(2023, 2, 1) + dt.timedelta(days=k)      # noqa: E731
    us = [dict(user_id=rng.choice([1, 1, 2, None]), platform=rng.choice(["web", None]), os=None, feature=None,
               created_date=rng.choice([None, day(0), day(1), day(40), day(80)]),
               last_login=rng.choice([None, day(10), day(50), day(90)])) for _ in range(120)]

    def at(d):
        return [(u["user_id"], u["created_date"], u["last_login"] if u["last_login"] and u["last_login"] <= d else None,
                 u["platform"], None, "1", None) for u in us if u["created_date"] and u["created_date"] <= d]
    old, new = at(P.as_of - dt.timedelta(days=30)), at(P.as_of)
    got = changes.account_changes(accounts(spark, us), P).collect()
    want = {(*r[:-2], "added" if r[-1] > r[-2] else "removed", abs(r[-1] - r[-2])) for r in _diff(old, new)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    for r in changes.account_change_summary(accounts(spark, us), P).collect():
        a, b = (Counter(x for x in rows if x[3] == r.platform) for rows in (old, new))
        assert tuple(r)[1:] == ((a.total(), (a - b).total(), (a & b).total(), (b - a).total(), b.total()))
    assert changes.account_changes(accounts(spark, []), P).count() == 0


def test_event_properties(spark):
    texts = ['{"k": 1, "s": "x"}', '{"k": "2.5"}', '{"k": null}', '{}', None, "", "  ", "nonsense", '{"k": 1', "[1, 2]", "3",
             '{"o": {"k": 4}, "é": -1}', '{"k": "NaN"}', *['{"k": 7}'] * 50]
    rows = [(p, t) for t in texts for p in ("web", None)]
    got = changes.event_properties(spark.createDataFrame(rows, "platform string, props string"))
    want = {}
    for p, t in rows:
        try:
            value = json.loads(t) if t and t.strip() else None
            status = "missing" if value is None else "malformed" if not isinstance(value, dict) else "parsed" if value else "empty"
        except ValueError:
            status = "malformed"
        for k, v in (value.items() if status == "parsed" else [(None, None)]):
            w = want.setdefault((p, status, k), [0, 0, 0.0])
            w[0] += 1
            with contextlib.suppress(TypeError, ValueError):
                if (x := float(v)) == x:
                    w[1] += 1
                    w[2] += x
    assert {(r.platform, r.status, r.property): [r.events, r.numeric_events, r.numeric_sum or 0.0] for r in got.collect()} == want
    plan = _plan(got.select("*"))       # not executed yet
    assert "Python" not in plan and plan.count("hashpartitioning") == 1
    assert changes.event_properties(spark.createDataFrame([], "platform string, props string")).count() == 0


def test_repeated_property_counts_once(spark):
    got = changes.event_properties(spark.createDataFrame([("web", '{"k": 1, "k": 5}')], "platform string, props string")).collect()
    assert [(r.property, r.events, r.numeric_sum) for r in got] == [("k", 1, 1.0)]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_refresh_by_day(spark, tmp_path):
    path = str(tmp_path / "t")
    es = [dict(id=k, user_id=k % 5, platform=["web", "ios"][k % 2], datetime=T(2023, 1, 1 + k % 6, k % 24)) for k in range(60)]
    es += [dict(id=60, user_id=1, platform="web")]                  # no day
    build = lambda e: platform.platform_use(e.filter("platform is not null"))      # noqa: E731

    def check(rows, days):
        source = events(spark, rows)
        assert refresh_by_day(source, build, path) == days
        whole = build(source)
        assert Counter(map(tuple, refreshed(spark, path, whole.schema).collect())) == Counter(map(tuple, whole.collect()))
    check(es, [None] + [D(2023, 1, d) for d in range(1, 7)])
    before = _files(f"{path}/data")
    check(es, [])
    assert _files(f"{path}/data") == before
    late = [*es, dict(id=61, user_id=9, platform="ios", datetime=T(2023, 1, 3, 1))]
    check(late, [D(2023, 1, 3)])
    changed = {f for f, at in _files(f"{path}/data").items() if before.get(f) != at}
    assert changed and all("date=2023-01-03" in f for f in changed)
    # a day without any event, a day whose events give no row, a new day
    gone = [e for e in late if e.get("datetime") is None or e["datetime"].day != 2]
    gone = [dict(e, platform=None) if e.get("datetime") and e["datetime"].day == 4 else e for e in gone]
    gone.append(dict(id=62, user_id=2, platform="web", datetime=T(2023, 2, 1)))
    check(gone, [D(2023, 1, 2), D(2023, 1, 4), D(2023, 2, 1)])
    check(gone, [])
    check(es, [D(2023, 1, 2), D(2023, 1, 3), D(2023, 1, 4), D(2023, 2, 1)])
    check([], [None] + [D(2023, 1, d) for d in range(1, 7)])
    check([], [])


def test_lost_refresh_is_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    es = [dict(user_id=k, platform="web", datetime=T(2023, 1, 1 + k % 3, 5)) for k in range(9)]
    refresh_by_day(events(spark, es), platform.platform_use, path)

    def fails(_):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        refresh_by_day(events(spark, es + es[:1]), fails, path)
    marked = spark.read.parquet(f"{path}/digests").filter(F.col("n_rows") == UNFINISHED).collect()
    assert [r["date"] for r in marked] == [D(2023, 1, 1)]
    # the source is as it was, but the day may be half-written
    assert refresh_by_day(events(spark, es), platform.platform_use, path) == [D(2023, 1, 1)]
    assert refresh_by_day(events(spark, es), platform.platform_use, path) == []
