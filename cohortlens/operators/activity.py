"""Reports beyond the original statements that need their own join or window
mechanism: events within an account's life (interval join), events by the account
opened last before them (as-of join), rolling distinct users (frames over days),
approximate ones from stored sketches, and subtotals over country, platform and
os (cube).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_lit, div, rnd
from ..params import DEFAULT, Params
from ..plans.asof import as_of_join
from ..plans.broadcast import dimension
from ..plans.fanout import rows_per

EPOCH = "1970-01-01"


def _bin(day, width: int) -> F.Column:
    return F.floor(F.datediff(day, F.lit(EPOCH).cast("date")) / F.lit(width)).cast("int")


def events_in_life(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per platform of the account: accounts, accounts with an event of their
    user between created_date and last_login (open accounts: as_of; both days
    included), and those events with their fees, each once per account it falls
    in.  Accounts without user or creation date, or that end before they begin,
    are left out.

    An interval join without a range or nested-loop join: lives are cut into bins
    of ``life_bin_days`` days and met with event days on (user, bin).  A day has
    one bin, so no pair is found twice.  Both sides are reduced first: equal
    lives of a user to one row, events to one row per user and day, so a user
    with a third of all events is one row a day, spread over his bins."""
    end = F.coalesce(F.col("last_login"), date_lit(params.as_of))
    lives = (user_info.filter(F.col("user_id").isNotNull() & (end >= F.col("created_date")))
             .select("user_id", "platform", "created_date", end.alias("_end")))
    lives = rows_per(lives, ["user_id", "platform", "created_date", "_end"])
    w = params.life_bin_days
    binned = lives.select("*", F.explode(F.sequence(_bin("created_date", w), _bin("_end", w))).alias("_bin"))
    days = (events.filter(F.col("user_id").isNotNull() & F.col("date").isNotNull()).groupBy("user_id", "date")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("fee").alias("_f")).withColumn("_bin", _bin("date", w)))
    inside = F.col("date").between(F.col("created_date"), F.col("_end"))
    met = binned.join(days, ["user_id", "_bin"], "left")
    # per life first: whether it met any day at all
    per_life = met.groupBy("user_id", "platform", "created_date", "_end", "_a").agg(
        F.sum(F.when(inside, F.col("_n"))).alias("_n"), F.sum(F.when(inside, F.col("_f"))).alias("_f"))
    a = F.col("_a")
    agg = per_life.groupBy("platform").agg(
        F.sum(a).alias("accounts"), F.coalesce(F.sum(F.when(F.col("_n").isNotNull(), a)), F.lit(0)).alias("active_accounts"),
        F.coalesce(F.sum(a * F.col("_n")), F.lit(0)).alias("events_in_life"), F.sum(a * F.col("_f")).alias("_fee"))
    return agg.select("platform", "accounts", "active_accounts", "events_in_life", rnd("_fee", 2).alias("fee_in_life"),
                      rnd(div("events_in_life", "active_accounts"), 2).alias("events_per_active_account")).orderBy("platform")


def rolling_active_users(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every calendar day from the first to the last event: distinct users of
    the day, and of the 7 and 28 days that end on it.

    A user's event day counts for the days up to its window's end or the user's
    next event day, whichever comes first: disjoint stretches, so a running sum
    of +1 at their starts and -1 after their ends is an exact distinct count
    without a distinct window.  The frames run over one row a calendar day; the
    only window over users holds one row per user and day."""
    spans = {"dau": 1, **{f"active_{k}d": k for k in params.rolling_days}}
    seen = events.filter(F.col("user_id").isNotNull() & F.col("date").isNotNull()).select("user_id", "date").distinct()
    following = F.lead("date").over(Window.partitionBy("user_id").orderBy("date"))
    gap = F.coalesce(F.datediff(following, F.col("date")), F.lit(max(spans.values())))
    steps = seen.select("date", gap.alias("_gap"))
    # one +1 and, per span, one -1 after the stretch's end
    marks = F.array(*[F.struct(F.date_add("date", F.least(F.lit(k), F.col("_gap"))).alias("day"),
                               *[F.lit(-1 if m == name else 0).alias(m) for m in spans]) for name, k in spans.items()],
                    F.struct(F.col("date").alias("day"), *[F.lit(1).alias(m) for m in spans]))
    deltas = (steps.select(F.explode(marks).alias("_m")).select("_m.*")
              .groupBy("day").agg(*[F.sum(m).alias(m) for m in spans]))
    span = seen.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).filter(F.col("lo").isNotNull())
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)       # one row a calendar day
    return (calendar.join(deltas, "day", "left")
            .select(F.col("day").alias("date"), *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(running).alias(m) for m in spans])
            .orderBy("date"))


def account_cube(user_info: DataFrame, geography: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Accounts and distinct users for every combination of country, platform and
    os and all their subtotals.  ``level``: grouping id (bit 4: all countries,
    2: all platforms, 1: all os), which tells a subtotal from a NULL value.

    One scan: accounts become one row per (country, platform, os, user), each is
    expanded into its eight groupings, and a second aggregate per (grouping, user)
    makes a user count once in each before users are counted."""
    g = dimension(geography.select("code", "country"), params.dimension_max_rows)
    keys = ["country", "platform", "os"]
    acc = rows_per(user_info, ["mp_country_code", "platform", "os", "user_id"])
    acc = acc.join(g, acc["mp_country_code"] == g["code"], "left").groupBy(*keys, "user_id").agg(F.sum("_a").alias("_a"))
    sets = F.array(*[F.struct(F.lit(level).cast("long").alias("level"),
                              *[(F.lit(None).cast("string") if level >> (2 - i) & 1 else F.col(k)).alias(k) for i, k in enumerate(keys)])
                     for level in range(8)])
    per_user = (acc.select("user_id", "_a", F.explode(sets).alias("_s")).groupBy("_s", "user_id").agg(F.sum("_a").alias("_a")))
    return (per_user.groupBy("_s").agg(F.sum("_a").alias("accounts"), F.count("user_id").alias("users"))
            .select("_s.level", *[f"_s.{k}" for k in keys], "accounts", "users")
            .orderBy("level", *keys))


def events_by_account(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Events by the platform of the account their user opened last before them:
    events, users, fees and the mean age of that account in days.

    An account counts from the start of its created_date; of accounts opened on
    one day the greatest id.  ``has_account`` tells events without any earlier
    account (no user, no time, none opened yet) from accounts without platform.
    An as-of join over bins of ``life_bin_days`` days (``plans.asof``); users are
    counted after a first aggregate per user."""
    opened = user_info.select("user_id", F.col("created_date").cast("timestamp_ntz").alias("opened"), "id", "platform")
    seen = events.select("user_id", "datetime", "fee")
    met = as_of_join(seen, opened, "user_id", "datetime", "opened",
                     lambda t: _bin(F.to_date(t), params.life_bin_days), "account")
    per_user = met.groupBy(F.col("account.platform").alias("platform"), F.col("account").isNotNull().alias("has_account"), "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("fee").alias("_f"),
        F.sum(F.datediff(F.to_date("datetime"), F.to_date("account.opened"))).alias("_age"))
    agg = per_user.groupBy("platform", "has_account").agg(
        F.sum("_n").alias("events"), F.count("user_id").alias("users"), F.sum("_f").alias("_fee"), F.sum("_age").alias("_days"))
    return agg.select("platform", "has_account", "events", "users", rnd("_fee", 2).alias("fee"),
                      rnd(div("_days", "events"), 2).alias("mean_account_age")).orderBy("has_account", "platform")


def daily_user_sketches(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per day and platform a mergeable sketch of its users, and its event count:
    the small table to store once.  Events without a date are left out; a day
    whose events have no user has an empty sketch."""
    dated = events.filter(F.col("date").isNotNull())
    return dated.groupBy("date", "platform").agg(
        F.hll_sketch_agg("user_id", params.sketch_lg_k).alias("users_sketch"), F.count(F.lit(1)).alias("events"))


def approx_active_users(sketches: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Approximate distinct users and exact events per day, ISO week and month,
    over all platforms, from ``daily_user_sketches`` alone: sketches are united,
    events are not read again.  Relative standard error 1.04 / sqrt(2^lg_k): 0.8 %
    at ``sketch_lg_k`` 14.  The exact counts are those of ``dau_by_platform`` and
    ``rolling_active_users``."""
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.trunc("date", p).alias("starts")) for p in ("week", "month")],
                      F.struct(F.lit("day").alias("period"), F.col("date").alias("starts")))
    return (sketches.select(F.explode(periods).alias("_p"), "users_sketch", "events").groupBy("_p")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("users"), F.sum("events").alias("events"))
            .select("_p.period", "_p.starts", "users", "events").orderBy("period", "starts"))
