"""Interval join, rolling distinct users and subtotals against brute force."""

import contextlib
import datetime as dt
import io
import random
from collections import Counter
from decimal import Decimal

import pytest
from conftest import D, T, accounts, events, geography
from pyspark.sql import functions as F

from cohortlens.operators import activity
from cohortlens.params import Params
from cohortlens.plans.asof import as_of_join

P = Params()          # as_of 2023-04-01


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _inputs(spark):
    """User 1 owns two thirds of the events and many overlapping accounts."""
    rng = random.Random(3)
    day = lambda k: D(2023, 1, 1) + dt.timedelta(days=k)      # noqa: E731
    us = [dict(user_id=rng.choice([1, 1, 2, 3, None]), platform=rng.choice(["web", "ios", None]), os=rng.choice(["x", None]),
               mp_country_code=rng.choice(["1", "2", "9", None]), created_date=rng.choice([None, *[day(k) for k in range(20)]]),
               last_login=rng.choice([None, *[day(k) for k in range(-3, 70, 6)]])) for _ in range(60)]
    es = [dict(user_id=rng.choice([1, 1, 1, 1, 2, 3, 4, None]), datetime=T(2023, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 2, 9, 30, 31, 75]), hours=3),
               fee=rng.choice([None, 1, 2.5])) for _ in range(150)]
    return us, es


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_events_in_life(spark, width):
    us, es = _inputs(spark)
    got = {r.platform: r for r in activity.events_in_life(accounts(spark, us), events(spark, es), P.with_(life_bin_days=width)).collect()}
    want = {}
    for u in us:
        end = u["last_login"] or P.as_of
        if u["user_id"] is None or u["created_date"] is None or end < u["created_date"]:
            continue
        hit = [e for e in es if e["user_id"] == u["user_id"] and u["created_date"] <= e["datetime"].date() <= end]
        w = want.setdefault(u["platform"], [0, 0, 0, Decimal(0)])
        w[0] += 1
        w[1] += bool(hit)
        w[2] += len(hit)
        w[3] += sum(Decimal(str(e["fee"])) for e in hit if e["fee"] is not None)
    assert {p: [r.accounts, r.active_accounts, r.events_in_life] for p, r in got.items()} == {p: w[:3] for p, w in want.items()}
    assert all(r.fee_in_life == float(want[p][3]) for p, r in got.items())


def test_interval_join_is_an_equi_join(spark, tmp_path):
    us, es = _inputs(spark)
    accounts(spark, us).write.parquet(f"{tmp_path}/u")
    events(spark, es).write.parquet(f"{tmp_path}/e")
    plan = _plan(activity.events_in_life(spark.read.parquet(f"{tmp_path}/u"), spark.read.parquet(f"{tmp_path}/e"), P))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert plan.count("FileScan parquet") == 2


def test_rolling_active_users(spark):
    us, es = _inputs(spark)
    got = {r.date: (r.dau, r.active_7d, r.active_28d) for r in activity.rolling_active_users(events(spark, es), P).collect()}
    seen = {(e["user_id"], e["datetime"].date()) for e in es if e["user_id"] is not None}
    first, last = min(d for _, d in seen), max(d for _, d in seen)
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]      # gaps between event days included
    assert got == {d: tuple(len({u for u, x in seen if 0 <= (d - x).days < k}) for k in (1, 7, 28)) for d in days}
    assert activity.rolling_active_users(events(spark, []), P).count() == 0
    assert activity.rolling_active_users(events(spark, [dict(user_id=1)]), P).count() == 0       # no date at all


def test_account_cube(spark):
    us, _ = _inputs(spark)
    names = {"1": "Alpha", "2": None}
    rows = activity.account_cube(accounts(spark, us), geography(spark, [("1", "Alpha", 1.0, 1.0), ("2", None, 1.0, 1.0)]), P).collect()
    n, users = Counter(), {}
    for u in us:
        keys = (names.get(u["mp_country_code"]), u["platform"], u["os"])
        for level in range(8):
            at = (level, *[None if level >> (2 - i) & 1 else k for i, k in enumerate(keys)])
            n[at] += 1
            users.setdefault(at, set()).add(u["user_id"])
    got = {(r.level, r.country, r.platform, r.os): (r.accounts, r.users) for r in rows}
    assert len(got) == len(rows) and got == {k: (n[k], len(users[k] - {None})) for k in n}


def _latest(us, e):
    """Account (id, row) the user of an event opened last before it, or None."""
    at = e.get("datetime")
    best = None
    for i, u in enumerate(us, 1):
        day = u["created_date"]
        if None in (u["user_id"], e["user_id"], day, at) or u["user_id"] != e["user_id"] or T(day.year, day.month, day.day) > at:
            continue
        best = max(best or (D(1, 1, 1), 0), (day, i))
    return None if best is None else (best[1], us[best[1] - 1])


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_events_by_account(spark, width):
    us, es = _inputs(spark)
    es = es + [dict(user_id=1, datetime=None, fee=3), dict(user_id=1, datetime=T(2023, 1, 5), fee=1)] + es[:20]
    us = us + [dict(us[0], user_id=1, created_date=D(2023, 1, 5), platform=p) for p in ("web", None, "ios")]     # ties
    got = {(r.platform, r.has_account): r for r in
           activity.events_by_account(accounts(spark, us), events(spark, es), P.with_(life_bin_days=width)).collect()}
    want = {}
    for e in es:
        a = _latest(us, e)
        w = want.setdefault((a and a[1]["platform"], a is not None), [0, set(), Decimal(0), 0])
        w[0] += 1
        w[1].add(e["user_id"])
        w[2] += Decimal(str(e["fee"] or 0))
        w[3] += (e["datetime"].date() - a[1]["created_date"]).days if a else 0
    assert {k: (r.events, r.users) for k, r in got.items()} == {k: (w[0], len(w[1] - {None})) for k, w in want.items()}
    assert all(r.fee == float(want[k][2]) for k, r in got.items())
    for k, r in got.items():
        assert r.mean_account_age is None if not k[1] else abs(r.mean_account_age - want[k][3] / want[k][0]) < 0.006
    assert activity.events_by_account(accounts(spark, us), events(spark, []), P).count() == 0
    alone = activity.events_by_account(accounts(spark, []), events(spark, es), P).collect()
    assert [(r.platform, r.has_account, r.events) for r in alone] == [(None, False, len(es))]


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_as_of_join_rows(spark, width):
    """Row by row: repeated rows stay, ties take the greatest, null keys and times match nothing."""
    rng = random.Random(5)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(30)])) for i in range(120)] + [(0, 1, 4), (0, 1, 4)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(0, 30, 3)]), rng.choice(["a", "b", None])) for _ in range(60)]
    got = as_of_join(spark.createDataFrame(left, "row long, k long, at int"), spark.createDataFrame(right, "k long, since int, v string"),
                     "k", "at", "since", lambda t: F.floor(t / width))
    greatest = lambda ms: max(ms, key=lambda m: (m[0], m[1] is not None, m[1] or ""), default=None)      # noqa: E731
    want = Counter((i, k, at, greatest([(s, v) for rk, s, v in right if None not in (rk, k, s, at) and rk == k and s <= at]))
                   for i, k, at in left)
    assert Counter((r.row, r.k, r.at, r.match and tuple(r.match)) for r in got.collect()) == want


def test_as_of_join_forms_no_pairs(spark, tmp_path):
    us, es = _inputs(spark)
    accounts(spark, us).write.parquet(f"{tmp_path}/u")
    events(spark, es).write.parquet(f"{tmp_path}/e")
    plan = _plan(activity.events_by_account(spark.read.parquet(f"{tmp_path}/u"), spark.read.parquet(f"{tmp_path}/e"), P))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def _exact_users(es):
    users, n = {}, Counter()
    for user, day in es:
        if day is None:
            continue
        for at in (("day", day), ("week", day - dt.timedelta(days=day.weekday())), ("month", day.replace(day=1))):
            n[at] += 1
            users.setdefault(at, set()).update({user} - {None})
    return {at: len(u) for at, u in users.items()}, n


def test_approx_active_users(spark, tmp_path):
    """Small periods are exact; 20,000 users a day stay within four standard errors; the stored table serves."""
    us, es = _inputs(spark)
    got = {(r.period, r.starts): (r.users, r.events)
           for r in activity.approx_active_users(activity.daily_user_sketches(events(spark, es), P), P).collect()}
    users, n = _exact_users([(e["user_id"], e["datetime"].date()) for e in es])
    assert got == {at: (users[at], n[at]) for at in n}

    many = spark.range(120_000).select((F.col("id") * 7 % 50_000).alias("user_id"), F.expr("date_add(date'2023-01-02', cast(id % 6 as int))").alias("date"),
                                       F.lit("web").alias("platform"))
    activity.daily_user_sketches(many, P).write.parquet(f"{tmp_path}/sketches")
    rows = activity.approx_active_users(spark.read.parquet(f"{tmp_path}/sketches"), P).collect()
    exact, n = _exact_users([(r.user_id, r.date) for r in many.collect()])
    assert len(rows) == 8 and {(r.period, r.starts): r.events for r in rows} == n
    error = 1.04 / 2 ** (P.sketch_lg_k / 2)
    assert all(abs(r.users - exact[r.period, r.starts]) <= 4 * error * exact[r.period, r.starts] for r in rows)


def test_approx_active_users_without_users_or_dates(spark):
    run = lambda es: [tuple(r) for r in activity.approx_active_users(activity.daily_user_sketches(events(spark, es), P), P).collect()]      # noqa: E731
    assert run([]) == [] and run([dict(user_id=1)]) == []
    assert run([dict(user_id=None, datetime=T(2023, 1, 2))]) == [(p, s, 0, 1) for p, s in
                                                                 (("day", D(2023, 1, 2)), ("month", D(2023, 1, 1)), ("week", D(2023, 1, 2)))]
