"""DuckDB building blocks for the oracle queries.

The oracle is written as plain SQL over the plain joins and global
windows (the naive definition of each report), so the optimised
DataFrame forms are checked against it.  The adapter below restates the
test-data rules independently of the Spark adapter.
"""

AS_OF = "DATE '2024-02-01'"

ADAPTER = """
orders_x AS (
  SELECT o.*, c.c_nationkey, c.c_mktsegment,
         CAST(DATE '2023-10-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) % 120 AS INTEGER) AS DATE) AS cdate
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
user_info AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_custkey END AS user_id,
         cdate AS created_date,
         CASE WHEN o_orderstatus = 'P' THEN NULL
              ELSE CAST(cdate + CAST(CASE WHEN o_custkey % 10 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 60 END AS INTEGER) AS DATE)
         END AS last_login,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'web' WHEN '3-MEDIUM' THEN 'ios'
              WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'android' END AS platform,
         CASE o_custkey % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'windows' ELSE NULL END AS os,
         CAST(c_nationkey AS VARCHAR) AS mp_country_code,
         c_mktsegment AS feature
  FROM orders_x
),
uevents AS (
  SELECT event_id AS id,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id,
         moved AS datetime,
         CAST(moved AS DATE) AS date,
         CASE WHEN event_type IN ('view', 'signup') THEN 'web'
              WHEN event_type IN ('click', 'error') THEN 'android'
              WHEN event_type = 'purchase' THEN 'ios' END AS platform,
         CAST(event_id % 10 AS DOUBLE) AS volume,
         CAST(value AS DECIMAL(18,2)) AS fee
  FROM (SELECT *, ts - to_days(CAST(COALESCE((user_id * 7) % 25, 0) AS INTEGER)) AS moved FROM events)
),
oevents AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS datetime,
         CAST(o_orderdate AS DATE) AS date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'web' WHEN '3-MEDIUM' THEN 'ios'
              WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'android' END AS platform,
         CAST(o_orderkey % 10 AS DOUBLE) AS volume,
         CAST(o_totalprice AS DECIMAL(18,2)) AS fee
  FROM orders
),
geography AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS country,
         CAST(n_nationkey * 5.0 - 60 AS DOUBLE) AS latitude,
         CAST(n_nationkey * 15.0 - 180 AS DOUBLE) AS longitude
  FROM nation
)"""


def R(x: str, n: int) -> str:
    """Round half away from zero, the same formula the library uses."""
    s = f"CAST({10 ** n} AS DOUBLE)"
    d = f"CAST({x} AS DOUBLE)"
    return f"(sign({d}) * floor(abs({d}) * {s} + 0.5) / {s} + CAST(0 AS DOUBLE))"


def PCT(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) * 100 / NULLIF(CAST({b} AS DOUBLE), 0))"


def DIV(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def LIFE(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return f"date_diff('day', {p}created_date, COALESCE({p}last_login, {AS_OF}))"


def TEXT_PCT(x: str) -> str:
    return f"(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '') || '%')"


def with_adapter(body: str) -> str:
    """Prefix a query whose own CTEs (if any) follow the adapter CTEs.

    ``body`` is either ``"SELECT ..."`` or ``", name AS (...) SELECT ..."``.
    """
    body = body.strip()
    if body.startswith(","):
        return "WITH " + ADAPTER + body
    return "WITH " + ADAPTER + "\n" + body
