from .common import AS_OF, DIV, LIFE, PCT, R, with_adapter

SQL = {}


def XAVG(x: str) -> str:
    """Average accumulated exactly, as the library does for money/ratios."""
    return f"(CAST(sum(CAST({x} AS DECIMAL(27,12))) AS DOUBLE) / count({x}))"


def DAVG(x: str) -> str:
    """Average of a decimal column: exact sum over non-null count."""
    return f"(CAST(sum({x}) AS DOUBLE) / count({x}))"


# accounts x the events of their person (left join; unmatched accounts keep one row)
JOINED = """
, joined AS (
  SELECT u.*, e.user_id AS event_user, e.id AS event_id, e.fee, e.volume
  FROM user_info u LEFT JOIN uevents e ON e.user_id = u.user_id
)"""

SQL["dau_by_platform"] = with_adapter("""
, per_platform AS (
  SELECT date, platform, count(DISTINCT user_id) AS users, sum(fee) AS fee, sum(volume) AS volume
  FROM uevents GROUP BY date, platform
)
SELECT date,
       CAST(coalesce(sum(users) FILTER (WHERE platform = 'web'), 0) AS BIGINT)     AS web_dau,
       CAST(coalesce(sum(users) FILTER (WHERE platform = 'android'), 0) AS BIGINT) AS android_dau,
       CAST(coalesce(sum(users) FILTER (WHERE platform = 'ios'), 0) AS BIGINT)     AS ios_dau,
       CAST(sum(users) AS BIGINT)  AS total_dau,
       CAST(sum(fee) AS DOUBLE)    AS total_daily_revenue,
       sum(volume)                 AS total_daily_volume
FROM per_platform GROUP BY date
""")

# growth against the previous month that has data
SQL["mau_growth"] = with_adapter(f"""
, months AS (
  SELECT CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
         count(DISTINCT user_id) AS mau, sum(fee) AS fee, sum(volume) AS volume
  FROM oevents GROUP BY 1, 2
), chained AS (
  SELECT *, lag(mau) OVER w AS mau_before, lag(fee) OVER w AS fee_before
  FROM months WINDOW w AS (ORDER BY year NULLS FIRST, month NULLS FIRST)
)
SELECT year, month, mau,
       {R('fee', 2)} AS monthly_revenue, {R('volume', 0)} AS monthly_volume,
       {R(PCT('mau - mau_before', 'mau_before'), 2)} AS mau_growth_rate,
       {R(PCT('fee - fee_before', 'fee_before'), 2)} AS revenue_growth_rate
FROM chained
""")

SQL["acquisition_by_month"] = with_adapter(f"""
, monthly AS (
  SELECT CAST(date_trunc('month', created_date) AS DATE) AS acquisition_month, count(*) AS n,
         count(*) FILTER (WHERE platform = 'web') AS w,
         count(*) FILTER (WHERE platform = 'android') AS a,
         count(*) FILTER (WHERE platform = 'ios') AS i
  FROM user_info WHERE created_date IS NOT NULL GROUP BY 1
)
SELECT acquisition_month, n AS new_users, w AS web_acquisitions, a AS android_acquisitions, i AS ios_acquisitions,
       {R(PCT('w', 'n'), 1)} AS web_acquisition_rate,
       {R(PCT('a', 'n'), 1)} AS android_acquisition_rate,
       {R(PCT('i', 'n'), 1)} AS ios_acquisition_rate
FROM monthly
""")

SQL["revenue_metrics"] = with_adapter(JOINED + f"""
, overall AS (
  SELECT count(DISTINCT user_id) AS people, count(DISTINCT event_user) AS payers,
         sum(fee) AS revenue, {DAVG('fee')} AS mean_fee,
         quantile_cont(CAST(fee AS DOUBLE), 0.5) AS median_fee, count(event_id) AS n_events
  FROM joined
)
SELECT people AS total_users, payers AS paying_users,
       {R(PCT('payers', 'people'), 2)} AS conversion_rate,
       {R('revenue', 2)} AS total_revenue,
       {R(DIV('revenue', 'payers'), 2)} AS arpu,
       {R('mean_fee', 2)} AS avg_transaction_value,
       {R('median_fee', 2)} AS median_transaction_value,
       n_events AS total_transactions,
       {R(DIV('n_events', 'payers'), 2)} AS avg_transactions_per_user
FROM overall
""")

SQL["feature_usage"] = with_adapter(JOINED + f"""
, per_feature AS (
  SELECT feature, count(DISTINCT user_id) AS people, count(DISTINCT event_user) AS active,
         coalesce(sum(fee), 0) AS revenue, count(event_id) AS n_events
  FROM joined WHERE feature IS NOT NULL GROUP BY feature
)
SELECT feature, people AS users_with_feature, active AS active_users_with_feature,
       {R(PCT('active', 'people'), 2)} AS feature_activation_rate,
       {R('revenue', 2)} AS feature_revenue,
       {R(DIV('revenue', 'active'), 2)} AS revenue_per_active_user,
       n_events AS events_from_feature,
       {R(DIV('n_events', 'active'), 2)} AS events_per_active_user
FROM per_feature
""")

SQL["engagement_segments"] = with_adapter(f"""
, people AS (
  SELECT user_id, count(DISTINCT CAST(datetime AS DATE)) AS days_seen, count(id) AS n,
         sum(volume) AS volume, sum(fee) AS fee,
         date_sub('day', min(datetime), max(datetime)) + 1 AS span_days
  FROM uevents GROUP BY user_id
)
SELECT CASE WHEN n >= 60 THEN 'Power Users (100+ events)'
            WHEN n >= 45 THEN 'High Users (50-99 events)'
            WHEN n >= 30 THEN 'Medium Users (20-49 events)'
            WHEN n >= 15 THEN 'Low Users (5-19 events)'
            ELSE 'Minimal Users (1-4 events)' END AS user_segment,
       count(*) AS user_count,
       {R('avg(days_seen)', 1)} AS avg_active_days,
       {R('avg(n)', 1)} AS avg_total_events,
       {R('avg(volume)', 1)} AS avg_total_volume,
       {R(DAVG('fee'), 2)} AS avg_total_revenue,
       {R('avg(span_days)', 1)} AS avg_lifetime_days,
       {R(XAVG(DIV('days_seen', 'span_days')), 3)} AS avg_engagement_ratio
FROM people GROUP BY 1
""")

SQL["churn_status"] = with_adapter(JOINED + f"""
, activity AS (
  SELECT user_id, created_date, last_login, platform,
         any_value({LIFE()}) AS active_days,
         any_value(date_diff('day', coalesce(last_login, created_date), {AS_OF})) AS idle_days,
         count(event_id) AS n_events, sum(fee) AS spent
  FROM joined GROUP BY user_id, created_date, last_login, platform
), labelled AS (
  SELECT *, CASE WHEN idle_days <= 7 THEN 'Active' WHEN idle_days <= 30 THEN 'At Risk'
                 WHEN idle_days <= 90 THEN 'Dormant' ELSE 'Churned' END AS churn_status
  FROM activity WHERE platform IS NOT NULL
)
SELECT churn_status, platform, count(*) AS user_count,
       {R(PCT('count(*)', 'sum(count(*)) OVER ()'), 2)} AS percentage,
       {R('avg(active_days)', 1)} AS avg_days_active,
       {R('avg(n_events)', 1)} AS avg_events,
       {R(DAVG('spent'), 2)} AS avg_revenue
FROM labelled GROUP BY churn_status, platform
""")


def _account_summary(key: str) -> str:
    return f"""
, per_{key} AS (
  SELECT {key}, count(DISTINCT user_id) AS people,
         count(DISTINCT user_id) FILTER (WHERE event_user IS NOT NULL) AS active,
         count(event_id) AS n_events, sum(fee) AS revenue, sum(volume) AS volume,
         avg({LIFE()}) AS mean_life
  FROM joined WHERE {key} IS NOT NULL GROUP BY {key}
)"""


SQL["platform_kpis"] = with_adapter(JOINED + _account_summary("platform") + f"""
SELECT platform, people AS total_users, active AS active_users,
       {R(PCT('active', 'people'), 2)} AS activation_rate,
       n_events AS total_events,
       {R('revenue', 2)} AS total_revenue,
       {R('volume', 0)} AS total_volume,
       {R(DIV('revenue', 'active'), 2)} AS revenue_per_active_user,
       {R(DIV('n_events', 'active'), 2)} AS events_per_active_user,
       {R('mean_life', 1)} AS avg_user_lifetime_days,
       {R(DIV('revenue', 'people'), 2)} AS revenue_per_total_user
FROM per_platform
""")

SQL["os_performance"] = with_adapter(JOINED + _account_summary("os") + f"""
SELECT os, people AS total_users, active AS active_users,
       {R(PCT('active', 'people'), 2)} AS activation_rate,
       {R('revenue', 2)} AS total_revenue,
       {R(DIV('revenue', 'active'), 2)} AS revenue_per_active_user,
       {R(DIV('n_events', 'active'), 2)} AS events_per_active_user,
       {R('mean_life', 1)} AS avg_retention_days
FROM per_os WHERE people >= 10
""")

SQL["weekly_trends"] = with_adapter(f"""
, weeks AS (
  SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, count(DISTINCT user_id) AS wau,
         count(*) AS n, sum(fee) AS fee, sum(volume) AS volume
  FROM oevents GROUP BY 1
), chained AS (
  SELECT *, lag(wau) OVER (ORDER BY week_start NULLS FIRST) AS wau_before FROM weeks
)
SELECT week_start, wau AS weekly_active_users, n AS weekly_events,
       {R('fee', 2)} AS weekly_revenue, {R('volume', 0)} AS weekly_volume,
       wau_before AS prev_week_users,
       {R(PCT('wau - wau_before', 'wau_before'), 2)} AS user_growth_rate,
       {R(DIV('fee', 'wau'), 2)} AS revenue_per_user_weekly
FROM chained
""")

SQL["clv_segments"] = with_adapter(JOINED + f"""
, value AS (
  SELECT user_id, platform, created_date, last_login, any_value({LIFE()}) AS life,
         count(event_id) AS n_tx, coalesce(sum(fee), 0) AS spent
  FROM joined GROUP BY user_id, platform, created_date, last_login
), banded AS (
  SELECT *, CASE WHEN spent >= 4000 THEN 'High Value (100+)'
                 WHEN spent >= 2000 THEN 'Medium Value (50-99)'
                 WHEN spent >= 1000 THEN 'Low Value (10-49)'
                 WHEN spent > 0 THEN 'Minimal Value (0-9)'
                 ELSE 'No Revenue' END AS clv_segment
  FROM value WHERE platform IS NOT NULL
)
SELECT clv_segment, platform, count(*) AS user_count,
       {R('avg(life)', 1)} AS avg_lifetime_days,
       {R('avg(n_tx)', 1)} AS avg_transactions,
       {R(DAVG('spent'), 2)} AS avg_revenue,
       {R('sum(spent)', 2)} AS segment_total_revenue,
       {R(XAVG(DIV('spent', 'life')), 3)} AS avg_daily_revenue
FROM banded GROUP BY clv_segment, platform
""")

SQL["peak_hours"] = with_adapter(f"""
, hours AS (
  SELECT CAST(hour(datetime) AS BIGINT) AS hour_of_day, count(DISTINCT user_id) AS people,
         count(*) AS n, sum(fee) AS fee, sum(volume) AS volume
  FROM uevents GROUP BY 1
)
SELECT hour_of_day, people AS unique_users, n AS total_events,
       {R('fee', 2)} AS hourly_revenue, {R('volume', 0)} AS hourly_volume,
       {R(DIV('n', 'people'), 2)} AS events_per_user_per_hour,
       CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS usage_rank
FROM hours
""")

SQL["cohort_revenue"] = with_adapter(JOINED + f"""
, members AS (
  SELECT CAST(date_trunc('month', created_date) AS DATE) AS cohort_month, user_id,
         coalesce(sum(fee), 0) AS spent, count(event_id) AS n_events
  FROM joined WHERE created_date IS NOT NULL GROUP BY 1, user_id
)
SELECT cohort_month, count(*) AS cohort_size,
       count(*) FILTER (WHERE spent > 0) AS paying_users,
       {R(PCT('count(*) FILTER (WHERE spent > 0)', 'count(*)'), 2)} AS conversion_rate,
       {R('sum(spent)', 2)} AS cohort_total_revenue,
       {R(DAVG('spent'), 2)} AS avg_revenue_per_user,
       {R(DIV('sum(spent)', 'count(*) FILTER (WHERE spent > 0)'), 2)} AS avg_revenue_per_paying_user,
       {R('avg(n_events)', 1)} AS avg_events_per_user
FROM members GROUP BY cohort_month
""")
