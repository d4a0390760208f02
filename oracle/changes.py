"""Snapshot differences and JSON properties in plain DuckDB SQL."""

from . import platform
from .common import AS_OF, R, with_adapter

SQL = {}

COLUMNS = "user_id, created_date, last_login, platform, os, mp_country_code, feature"


def _snapshot(name: str, day: str) -> str:
    return f"""{name} AS (
  SELECT user_id, created_date, CASE WHEN last_login <= {day} THEN last_login END AS last_login,
         platform, os, mp_country_code, feature
  FROM user_info WHERE created_date <= {day}
)"""


_SNAPSHOTS = f"""
, {_snapshot('earlier', f"CAST({AS_OF} - INTERVAL 30 DAY AS DATE)")},
{_snapshot('later', AS_OF)}"""

SQL["account_changes"] = with_adapter(f"""{_SNAPSHOTS}
SELECT {COLUMNS}, 'removed' AS change, count(*) AS n_rows
FROM (SELECT * FROM earlier EXCEPT ALL SELECT * FROM later) GROUP BY ALL
UNION ALL
SELECT {COLUMNS}, 'added', count(*)
FROM (SELECT * FROM later EXCEPT ALL SELECT * FROM earlier) GROUP BY ALL
""")

SQL["account_change_summary"] = with_adapter(f"""{_SNAPSHOTS}
, parts AS (
  SELECT platform, 'before' AS part FROM earlier
  UNION ALL SELECT platform, 'after' FROM later
  UNION ALL SELECT platform, 'unchanged' FROM (SELECT * FROM earlier INTERSECT ALL SELECT * FROM later)
  UNION ALL SELECT platform, 'removed' FROM (SELECT * FROM earlier EXCEPT ALL SELECT * FROM later)
  UNION ALL SELECT platform, 'added' FROM (SELECT * FROM later EXCEPT ALL SELECT * FROM earlier)
)
SELECT platform, count(*) FILTER (WHERE part = 'before') AS accounts_before, count(*) FILTER (WHERE part = 'removed') AS removed,
       count(*) FILTER (WHERE part = 'unchanged') AS unchanged, count(*) FILTER (WHERE part = 'added') AS added,
       count(*) FILTER (WHERE part = 'after') AS accounts_after
FROM parts GROUP BY platform
""")

SQL["event_properties"] = f"""
WITH texts AS (
  SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'web'
              WHEN event_type IN ('click', 'error') THEN 'android'
              WHEN event_type = 'purchase' THEN 'ios' END AS platform,
         CASE WHEN coalesce(trim(props), '') = '' THEN 'missing'
              WHEN NOT json_valid(props) OR json_type(props) <> 'OBJECT' THEN 'malformed'
              WHEN len(json_keys(props)) = 0 THEN 'empty' ELSE 'parsed' END AS status,
         CASE WHEN json_valid(props) THEN props END AS props
  FROM events
), named AS (
  SELECT platform, status, props, unnest(CASE WHEN status = 'parsed' THEN json_keys(props) ELSE [NULL] END) AS property FROM texts
), valued AS (
  SELECT *, TRY_CAST(json_extract_string(props, '$."' || property || '"') AS DOUBLE) AS value FROM named
)
SELECT platform, status, property, count(*) AS events, count(value) AS numeric_events, {R('sum(value)', 6)} AS numeric_sum
FROM valued GROUP BY platform, status, property
"""

# a refreshed table holds what a full build of it holds
SQL["daily_usage_refreshed"] = platform.SQL["platform_use"]
