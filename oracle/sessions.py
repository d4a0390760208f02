from .common import DIV, PCT, R, with_adapter

SQL = {}

# Anchored buckets: offset of each event from the first event of its
# (user, platform, date); [0, 6h) -> 1, [6h, 12h] -> 2, (12h, 18h] -> 3,
# later or unknown -> 4.  Sessions are numbered 1..N by user, date, bucket
# and platform.
EVENTS_UPDATED = """
, anchored AS (
  SELECT *, datetime - min(datetime) OVER (PARTITION BY user_id, platform, date) AS since_first
  FROM uevents WHERE user_id IS NOT NULL
), bucketed AS (
  SELECT *, CASE WHEN since_first < INTERVAL 6 HOUR THEN 1
                 WHEN since_first <= INTERVAL 12 HOUR THEN 2
                 WHEN since_first <= INTERVAL 18 HOUR THEN 3
                 ELSE 4 END AS bucket
  FROM anchored
), folded AS (
  SELECT user_id, CAST(datetime AS DATE) AS day, platform, bucket,
         min(datetime) AS first_seen, sum(volume) AS volume, sum(fee) AS fee, count(*) AS folded_events
  FROM bucketed GROUP BY user_id, CAST(datetime AS DATE), platform, bucket
), events_updated AS (
  SELECT row_number() OVER (ORDER BY user_id, day NULLS FIRST, bucket, platform NULLS FIRST) AS id,
         user_id, day AS date, first_seen AS datetime, platform, volume, fee
  FROM folded
)"""

# per (user, platform, day): events before and after recalculation
PAIRED = EVENTS_UPDATED + """
, before AS (
  SELECT user_id, platform, CAST(datetime AS DATE) AS date, count(*) AS n_before,
         sum(volume) AS vol_before, sum(fee) AS fee_before
  FROM uevents WHERE user_id IS NOT NULL
  GROUP BY user_id, platform, CAST(datetime AS DATE)
), after AS (
  SELECT user_id, platform, date, count(*) AS n_after, sum(volume) AS vol_after, sum(fee) AS fee_after
  FROM events_updated GROUP BY user_id, platform, date
), paired AS (
  SELECT b.*, a.n_after, a.vol_after, a.fee_after
  FROM before b JOIN after a USING (user_id, platform, date)
)"""

SQL["events_updated"] = with_adapter(EVENTS_UPDATED + """
SELECT id, user_id, date, datetime, platform, volume, CAST(fee AS DOUBLE) AS fee FROM events_updated
""")

SQL["session_compare"] = with_adapter(PAIRED + f"""
SELECT user_id, platform, date, n_before AS original_events, n_after AS updated_events,
       n_before - n_after AS events_reduced,
       {R(PCT('n_before - n_after', 'n_before'), 2)} AS reduction_percentage,
       vol_before AS original_volume, vol_after AS updated_volume,
       CAST(fee_before AS DOUBLE) AS original_fee, CAST(fee_after AS DOUBLE) AS updated_fee
FROM paired WHERE n_before > n_after
ORDER BY events_reduced DESC, user_id, platform NULLS FIRST, date NULLS FIRST
LIMIT 20
""")

SQL["session_user_impact"] = with_adapter(PAIRED + f"""
, people AS (
  SELECT user_id, sum(n_before) AS before_total, sum(n_after) AS after_total,
         sum(n_before - n_after) AS reduced_total,
         {R(f"avg({PCT('n_before - n_after', 'n_before')})", 2)} AS mean_pct
  FROM paired GROUP BY user_id
), classed AS (
  SELECT *, CASE WHEN before_total >= 100 THEN 'Heavy Users (100+ events)'
                 WHEN before_total >= 50 THEN 'Moderate Users (50-99 events)'
                 WHEN before_total >= 20 THEN 'Regular Users (20-49 events)'
                 ELSE 'Light Users (10-19 events)' END AS user_category
  FROM people WHERE before_total >= 10
)
SELECT user_category, count(*) AS user_count,
       {R('avg(before_total)', 1)} AS avg_original_events,
       {R('avg(after_total)', 1)} AS avg_updated_events,
       {R('avg(reduced_total)', 1)} AS avg_events_reduced,
       {R('avg(mean_pct)', 2)} AS avg_reduction_percentage
FROM classed GROUP BY user_category
""")

SQL["session_platform_impact"] = with_adapter(PAIRED + f"""
, affected AS (
  SELECT user_id, platform, sum(n_before) AS b, sum(n_after) AS a
  FROM paired GROUP BY user_id, platform HAVING sum(n_before) > sum(n_after)
)
SELECT platform, count(DISTINCT user_id) AS affected_users,
       CAST(sum(b) AS BIGINT) AS total_original_events, CAST(sum(a) AS BIGINT) AS total_updated_events,
       CAST(sum(b - a) AS BIGINT) AS total_events_reduced,
       {R(PCT('sum(b - a)', 'sum(b)'), 2)} AS platform_reduction_pct
FROM affected GROUP BY platform
""")

SQL["session_daily_impact"] = with_adapter(PAIRED + f"""
, per_day AS (
  SELECT date, CAST(sum(n_before) AS BIGINT) AS b, CAST(sum(n_after) AS BIGINT) AS a
  FROM paired GROUP BY date
)
SELECT date, b AS daily_original_events, a AS daily_updated_events, b - a AS daily_events_reduced,
       {R(PCT('b - a', 'b'), 2)} AS daily_reduction_pct
FROM per_day WHERE b > a
ORDER BY daily_reduction_pct DESC, date LIMIT 10
""")

SQL["gaming_patterns"] = with_adapter(f"""
, days AS (
  SELECT user_id, platform, CAST(datetime AS DATE) AS date, count(*) AS n,
         count(DISTINCT hour(datetime)) AS hours,
         CAST(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 60000000) AS BIGINT) AS minutes
  FROM uevents WHERE user_id IS NOT NULL
  GROUP BY user_id, platform, CAST(datetime AS DATE)
)
SELECT user_id, platform, date, n AS daily_events, hours AS unique_hours, minutes AS session_duration_minutes,
       {R(DIV('n', 'hours'), 2)} AS events_per_hour,
       CASE WHEN n > 50 AND minutes < 60 THEN 'Likely Gaming'
            WHEN n > 30 AND hours <= 2 THEN 'Possible Gaming'
            WHEN n > 20 AND minutes < 30 THEN 'Suspicious Pattern'
            ELSE 'Normal Usage' END AS gaming_assessment
FROM days WHERE n >= 3
ORDER BY n DESC, minutes ASC, user_id, platform NULLS FIRST, date NULLS FIRST
LIMIT 50
""")
