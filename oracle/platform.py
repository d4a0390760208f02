from .common import DIV, PCT, R, with_adapter

SQL = {}

# every calendar date that has any event, with per-platform event counts
SQL["platform_use"] = with_adapter("""
SELECT date,
       count(*) FILTER (WHERE platform = 'web')     AS web,
       count(*) FILTER (WHERE platform = 'android') AS android,
       count(*) FILTER (WHERE platform = 'ios')     AS ios
FROM uevents
GROUP BY date
""")

SQL["volume_use"] = with_adapter("""
SELECT sum(volume) AS volume, date FROM uevents GROUP BY date
""")

SQL["platform_comparison"] = with_adapter("""
, known AS (SELECT * FROM uevents WHERE user_id IS NOT NULL)
SELECT platform,
       count(DISTINCT user_id)                  AS unique_users,
       count(*)                                 AS total_sessions,
       sum(volume)                              AS total_volume,
       CAST(sum(fee) AS DOUBLE)                 AS total_revenue,
       sum(volume) / count(volume)              AS avg_volume_per_session,
       CAST(sum(fee) AS DOUBLE) / count(fee)    AS avg_fee_per_session
FROM known
GROUP BY platform
""")

SQL["daily_platform_trends"] = with_adapter("""
SELECT date, platform,
       count(DISTINCT user_id)  AS daily_active_users,
       sum(volume)              AS daily_volume,
       CAST(sum(fee) AS DOUBLE) AS daily_revenue
FROM uevents
GROUP BY date, platform
""")

SQL["platform_performance"] = with_adapter(f"""
, per_platform AS (
  SELECT platform,
         count(DISTINCT user_id)               AS users,
         count(*)                              AS sessions,
         sum(volume) / count(volume)           AS mean_volume,
         CAST(sum(fee) AS DOUBLE) / count(fee) AS mean_fee
  FROM uevents GROUP BY platform
)
SELECT platform, users, sessions,
       {R(DIV('sessions', 'users'), 2)}                  AS sessions_per_user,
       {R('mean_volume', 2)}                             AS avg_volume,
       {R('mean_fee', 2)}                                AS avg_fee,
       {R(PCT('users', 'sum(users) OVER ()'), 2)}        AS user_percentage
FROM per_platform
""")
