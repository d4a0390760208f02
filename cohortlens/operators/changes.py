"""Reports beyond the original statements on tables that change: what differs
between two snapshots of the accounts (multiset difference and intersection),
daily platform usage refreshed after late events, and the properties that events
carry as JSON text.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_lit, exact_sum, rnd
from ..params import DEFAULT, Params
from ..plans.digests import multiset_diff
from ..session import ensure_checkpoint_dir
from ..sources.refresh import refresh_by_day, refreshed
from .platform import platform_use

SNAPSHOT_COLUMNS = ["user_id", "created_date", "last_login", "platform", "os", "mp_country_code", "feature"]


def accounts_at(user_info: DataFrame, day: dt.date) -> DataFrame:
    """The accounts as they were known on ``day``: created by then, with no login after it.
    Without the account's id, so one person's equal accounts are equal rows."""
    seen = F.when(F.col("last_login") <= date_lit(day), F.col("last_login")).alias("last_login")
    return (user_info.filter(F.col("created_date") <= date_lit(day))
            .select(*[seen if c == "last_login" else c for c in SNAPSHOT_COLUMNS]))


def _snapshots(user_info: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    before = params.as_of - dt.timedelta(days=params.snapshot_days)
    return accounts_at(user_info, before), accounts_at(user_info, params.as_of)


def account_changes(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Account rows that differ between the snapshot ``snapshot_days`` before as_of and
    that of as_of: the row, ``change`` ('removed' or 'added') and how many of it."""
    diff = multiset_diff(*_snapshots(user_info, params), params.diff_buckets)
    more = F.col("n_new") - F.col("n_old")
    return diff.select(*SNAPSHOT_COLUMNS, F.when(more > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
                       F.abs(more).alias("n_rows"))


def account_change_summary(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per platform: account rows of the earlier snapshot, of them removed and unchanged
    (the multiset intersection), added, and rows of the later one."""
    old, new = _snapshots(user_info, params)
    diff = multiset_diff(old, new, params.diff_buckets)
    zero = F.lit(0).cast("long")
    counted = old.groupBy("platform").agg(F.count(F.lit(1)).alias("_before")).select(
        "platform", "_before", zero.alias("_removed"), zero.alias("_added"))
    moved = diff.groupBy("platform").agg(F.sum(F.greatest(F.col("n_old") - F.col("n_new"), zero)).alias("_removed"),
                                         F.sum(F.greatest(F.col("n_new") - F.col("n_old"), zero)).alias("_added"))
    both = counted.unionByName(moved.select("platform", zero.alias("_before"), "_removed", "_added"))
    before, removed, added = F.sum("_before"), F.sum("_removed"), F.sum("_added")
    return (both.groupBy("platform")
            .agg(before.alias("accounts_before"), removed.alias("removed"), (before - removed).alias("unchanged"),
                 added.alias("added"), (before - removed + added).alias("accounts_after"))
            .orderBy("platform"))


def daily_usage_refreshed(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``platform_use`` kept as a stored table: built from the events delivered until noon
    of the day ``snapshot_days`` before as_of, then refreshed from all events, which
    computes the days after and that day again and leaves the days before as they are.
    The table lies in a new folder under ``spark.checkpoint.dir``."""
    path = f"{ensure_checkpoint_dir(events.sparkSession).rstrip('/')}/daily-usage-{uuid.uuid4().hex}"
    noon = dt.datetime.combine(params.as_of - dt.timedelta(days=params.snapshot_days), dt.time(12))
    refresh_by_day(events.filter(F.col("datetime") < F.lit(noon).cast("timestamp_ntz")), platform_use, path)
    refresh_by_day(events, platform_use, path)
    return refreshed(events.sparkSession, path, platform_use(events).schema)


def event_properties(properties: DataFrame) -> DataFrame:
    """Per platform and property of the events' JSON text: events that carry it, events
    whose value is a number, and the sum of these.

    ``properties``: ``platform`` and ``props``, a JSON object as text.  Every event is in
    exactly one ``status``: 'parsed' (one row per property), 'empty' (an object without
    properties), 'missing' (null or blank text) or 'malformed' (no JSON object); the last
    three have a null property.  A property that an object repeats counts once, with its
    first value.

    Texts are parsed by Spark's own parser into a declared map of strings and their
    properties counted in the task that reads them; only counts per platform and
    property are shuffled."""
    text = properties.select("platform", "props", F.from_json("props", "map<string,string>").alias("_map"))
    blank = F.col("props").isNull() | (F.trim("props") == "")
    status = (F.when(blank, F.lit("missing")).when(F.col("_map").isNull(), F.lit("malformed"))
              .when(F.size("_map") == 0, F.lit("empty")).otherwise(F.lit("parsed")))
    entries = F.when(status == "parsed", F.transform(
        F.array_distinct(F.map_keys("_map")),
        lambda k: F.struct(k.alias("property"), F.try_element_at("_map", k).try_cast("double").alias("value"))))
    each = text.select("platform", status.alias("status"), F.explode_outer(entries).alias("_e"))
    number = F.when(~F.isnan("_e.value"), F.col("_e.value"))
    return (each.groupBy("platform", "status", F.col("_e.property").alias("property"))
            .agg(F.count(F.lit(1)).alias("events"), F.count(number).alias("numeric_events"),
                 rnd(exact_sum(number), 6).alias("numeric_sum"))
            .orderBy("platform", "status", "property"))
