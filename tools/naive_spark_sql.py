"""Straightforward Spark SQL plans for four reports, as a performance baseline.

Each computes the same result as the library function with the plan a
plain SQL formulation gets: one scan and one aggregate per retention
interval joined back on the cohort; a window for the session anchor and
an unpartitioned ROW_NUMBER (every row in one task) for the ids; the
account x account x event rows materialised before grouping; three
unpartitioned ROW_NUMBERs for the RFM ranks (over a materialised
``events_updated`` view, as the pipeline version reads).  They run over
temp views ``user_info``, ``events``, ``geography`` and
``events_updated``.  Only ``bench.py`` uses them; the library never does.
"""

AS_OF = "DATE'2024-02-01'"

_life = f"datediff(coalesce(last_login, {AS_OF}), created_date)"
_per_step = "\n".join(
    f", step{k} AS (SELECT created_date, count(id) AS gone FROM user_info WHERE {_life} <= {7 * k} GROUP BY created_date)"
    for k in range(1, 8))
_shares = ",\n".join(
    f"  concat(round((c.cohort - coalesce(s{k}.gone, 0)) / c.cohort * 100, 2), '%') AS day{k}_retention"
    for k in range(1, 8))
_attach = "\n".join(f"LEFT JOIN step{k} s{k} ON s{k}.created_date = c.created_date" for k in range(1, 8))

RETENTION = f"""
WITH cohorts AS (SELECT created_date, count(id) AS cohort FROM user_info GROUP BY created_date)
{_per_step}
SELECT c.created_date, c.cohort / c.cohort AS day0_retention,
{_shares}
FROM cohorts c
{_attach}
ORDER BY c.created_date
"""

SESSIONS = """
WITH anchored AS (
  SELECT *, min(datetime) OVER (PARTITION BY user_id, platform, date) AS first_seen
  FROM events WHERE user_id IS NOT NULL
), bucketed AS (
  SELECT *, CASE WHEN datetime < first_seen + INTERVAL 6 HOURS THEN 1
                 WHEN datetime <= first_seen + INTERVAL 12 HOURS THEN 2
                 WHEN datetime <= first_seen + INTERVAL 18 HOURS THEN 3
                 ELSE 4 END AS bucket
  FROM anchored
), folded AS (
  SELECT user_id, date, platform, bucket, min(datetime) AS datetime, sum(volume) AS volume, sum(fee) AS fee
  FROM bucketed GROUP BY user_id, date, platform, bucket
)
SELECT row_number() OVER (ORDER BY user_id, date, bucket, platform) AS id,
       user_id, date, datetime, platform, volume, fee
FROM folded
"""

COUNTRY_ENGAGEMENT = f"""
WITH rows AS (
  SELECT geo.country, u.user_id, u.created_date, u.last_login,
         datediff(coalesce(u.last_login, {AS_OF}), u.created_date) AS life, e.id, e.volume, e.fee
  FROM user_info located
  JOIN geography geo ON geo.code = located.mp_country_code
  JOIN user_info u ON u.user_id = located.user_id
  LEFT JOIN events e ON e.user_id = u.user_id
), person AS (
  SELECT country, user_id, created_date, last_login, first(life) AS life,
         count(id) AS n_events, sum(volume) AS vol, sum(fee) AS spent
  FROM rows GROUP BY country, user_id, created_date, last_login
)
SELECT country, count(*) AS total_users,
       round(avg(life), 1) AS avg_user_lifespan_days, round(avg(n_events), 1) AS avg_events_per_user,
       round(avg(vol), 1) AS avg_volume_per_user, round(avg(spent), 2) AS avg_revenue_per_user,
       count_if(n_events > 0) AS engaged_users,
       round(count_if(n_events > 0) * 100.0 / count(*), 2) AS engagement_rate
FROM person GROUP BY country HAVING count(*) >= 20
ORDER BY avg_revenue_per_user DESC
"""

_months = f"((year({AS_OF}) - year(u.created_date)) * 12 + (month({AS_OF}) - month(u.created_date)))"
RFM_BASE = f"""
WITH metrics AS (
  SELECT u.user_id, u.created_date,
         datediff({AS_OF}, max(e.date)) AS recency,
         try_divide(count(e.id), {_months}) AS frequency,
         try_divide(sum(e.fee), {_months}) AS monetary
  FROM user_info u JOIN events_updated e ON e.user_id = u.user_id
  WHERE u.user_id IS NOT NULL
  GROUP BY u.user_id, u.created_date
)
SELECT *,
       row_number() OVER (ORDER BY recency DESC) AS recency_rn,
       row_number() OVER (ORDER BY frequency) AS frequency_rn,
       row_number() OVER (ORDER BY monetary) AS monetary_rn
FROM metrics
"""

NAIVE_SQL = {
    "retention_intervals": RETENTION,
    "events_updated": SESSIONS,
    "country_engagement": COUNTRY_ENGAGEMENT,
    "rfm_base": RFM_BASE,
}
