"""Independent DuckDB SQL for every report (the correctness oracle)."""

from . import activity, changes, geography, kpis, platform, retention_abuse, rfm, sessions

ALL_SQL: dict[str, str] = {}
for _m in (platform, retention_abuse, geography, sessions, rfm, kpis, activity, changes):
    ALL_SQL.update(_m.SQL)
