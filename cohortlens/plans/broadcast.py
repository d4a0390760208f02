"""Broadcast only behind a size check.

``dimension`` prepares the small side of a dimension join.  By default
the join strategy is left to Spark's own size check: it broadcasts a
side whose estimated size is under ``spark.sql.autoBroadcastJoinThreshold``
(AQE re-checks with the real size at runtime) and sort-merge joins
otherwise — a checked broadcast with a fallback and no extra job.
With ``max_rows`` set, the side is counted once per DataFrame object and bound
(``limit(max_rows + 1).count()``) and hinted for broadcast only within
the bound.  Results bounded by construction (top-k lists, per-partition
offset tables) use ``F.broadcast`` directly.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_checked: "weakref.WeakKeyDictionary[DataFrame, dict[int, bool]]" = weakref.WeakKeyDictionary()


def fits(df: DataFrame, max_rows: int) -> bool:
    """At most ``max_rows`` rows?  One bounded count per (DataFrame, bound)."""
    known = _checked.setdefault(df, {})
    if max_rows not in known:
        known[max_rows] = df.limit(max_rows + 1).count() <= max_rows
    return known[max_rows]


def dimension(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    if max_rows is None:
        return df
    return F.broadcast(df) if fits(df, max_rows) else df
