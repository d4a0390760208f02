from .common import AS_OF, R, with_adapter

SQL = {}

# every event joined to every account of its user that it falls in
SQL["events_in_life"] = with_adapter(f"""
, lives AS (
  SELECT id, user_id, platform, created_date, coalesce(last_login, {AS_OF}) AS until
  FROM user_info WHERE user_id IS NOT NULL AND coalesce(last_login, {AS_OF}) >= created_date
), met AS (
  SELECT l.platform, l.id AS account, e.user_id AS seen, e.fee
  FROM lives l LEFT JOIN uevents e ON e.user_id = l.user_id AND e.date BETWEEN l.created_date AND l.until
)
SELECT platform, count(DISTINCT account) AS accounts, count(DISTINCT account) FILTER (WHERE seen IS NOT NULL) AS active_accounts,
       count(seen) AS events_in_life, {R('sum(fee)', 2)} AS fee_in_life,
       {R('count(seen) / NULLIF(count(DISTINCT account) FILTER (WHERE seen IS NOT NULL), 0)', 2)} AS events_per_active_account
FROM met GROUP BY platform
""")

SQL["rolling_active_users"] = with_adapter("""
, active AS (SELECT DISTINCT user_id, date FROM uevents WHERE user_id IS NOT NULL AND date IS NOT NULL),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM active)
SELECT d.day AS date, count(DISTINCT a.user_id) FILTER (WHERE a.date = d.day) AS dau,
       count(DISTINCT a.user_id) FILTER (WHERE a.date > d.day - 7) AS active_7d,
       count(DISTINCT a.user_id) AS active_28d
FROM days d LEFT JOIN active a ON a.date BETWEEN d.day - 27 AND d.day
GROUP BY d.day
""")

SQL["account_cube"] = with_adapter("""
SELECT CAST(GROUPING(g.country, u.platform, u.os) AS BIGINT) AS level, g.country, u.platform, u.os,
       count(*) AS accounts, count(DISTINCT u.user_id) AS users
FROM user_info u LEFT JOIN geography g ON g.code = u.mp_country_code
GROUP BY CUBE (g.country, u.platform, u.os)
""")

# the latest account of its user that was open when the event came
SQL["events_by_account"] = with_adapter(f"""
, opened AS (
  SELECT user_id, CAST(created_date AS TIMESTAMP) AS opened, max(id) AS id
  FROM user_info WHERE user_id IS NOT NULL AND created_date IS NOT NULL GROUP BY ALL
), named AS (
  SELECT o.user_id, o.opened, o.id, u.platform FROM opened o JOIN user_info u ON u.id = o.id
), met AS (
  SELECT e.user_id, e.fee, a.id, a.platform, date_diff('day', CAST(a.opened AS DATE), CAST(e.datetime AS DATE)) AS age
  FROM uevents e ASOF LEFT JOIN named a ON e.user_id = a.user_id AND e.datetime >= a.opened
)
SELECT platform, id IS NOT NULL AS has_account, count(*) AS events, count(DISTINCT user_id) AS users,
       {R('sum(fee)', 2)} AS fee, {R('sum(age) / count(*)', 2)} AS mean_account_age
FROM met GROUP BY platform, has_account
""")
