from .common import LIFE, PCT, R, TEXT_PCT, with_adapter

SQL = {}

# --- retention -------------------------------------------------------------
# Per account: days from creation to last login (open accounts run to the
# as-of date).  Interval k (1..7) counts accounts whose life is at most 7k
# days; the report shows the share of the cohort still present after it.
_pivot = ",\n".join(
    f"  {TEXT_PCT(R(f'(CAST(c.cohort - coalesce(max(g.gone) FILTER (WHERE g.k = {k}), 0) AS DOUBLE) / c.cohort * 100)', 2))}"
    f" AS day{k}_retention" for k in range(1, 8))
SQL["retention_intervals"] = with_adapter(f"""
, lives AS (
  SELECT id, created_date, {LIFE()} AS life FROM user_info
), cohorts AS (
  SELECT created_date, count(id) AS cohort FROM lives GROUP BY created_date
), gone AS (
  SELECT l.created_date, s.k, count(l.id) AS gone
  FROM lives l JOIN generate_series(1, 7) AS s(k) ON l.life <= 7 * s.k
  GROUP BY l.created_date, s.k
)
SELECT c.created_date, CAST(c.cohort AS DOUBLE) / c.cohort AS day0_retention,
{_pivot}
FROM cohorts c LEFT JOIN gone g ON g.created_date = c.created_date
GROUP BY c.created_date, c.cohort
""")

SQL["cohort_retention_monthly"] = with_adapter(f"""
, dated AS (
  SELECT CAST(year(created_date) AS BIGINT) AS year, CAST(month(created_date) AS BIGINT) AS month,
         last_login >= created_date + 7  AS kept7,
         last_login >= created_date + 14 AS kept14,
         last_login >= created_date + 30 AS kept30
  FROM user_info WHERE created_date IS NOT NULL
)
SELECT year, month, count(*) AS cohort_size,
       {R(PCT('count(*) FILTER (WHERE kept7)', 'count(*)'), 2)}  AS retention_7d_pct,
       {R(PCT('count(*) FILTER (WHERE kept14)', 'count(*)'), 2)} AS retention_14d_pct,
       {R(PCT('count(*) FILTER (WHERE kept30)', 'count(*)'), 2)} AS retention_30d_pct
FROM dated GROUP BY year, month
""")

SQL["platform_retention"] = with_adapter(f"""
, used AS (
  SELECT platform, last_login - created_date AS days
  FROM user_info
  WHERE platform IS NOT NULL AND last_login IS NOT NULL AND created_date IS NOT NULL
)
SELECT platform, count(*) AS total_users,
       count(*) FILTER (WHERE days >= 7)  AS retained_7d,
       count(*) FILTER (WHERE days >= 14) AS retained_14d,
       count(*) FILTER (WHERE days >= 30) AS retained_30d,
       {R(PCT('count(*) FILTER (WHERE days >= 7)', 'count(*)'), 2)}  AS retention_7d_pct,
       {R(PCT('count(*) FILTER (WHERE days >= 14)', 'count(*)'), 2)} AS retention_14d_pct,
       {R(PCT('count(*) FILTER (WHERE days >= 30)', 'count(*)'), 2)} AS retention_30d_pct
FROM used GROUP BY platform
""")

# --- trial abuse -----------------------------------------------------------
# An account is trial-length when it lived at most 3 days (open accounts up
# to the as-of date).  A person repeats when one (user, country, os) holds
# more than 5 such accounts.
_short = f"{LIFE()} <= 3"

SQL["abuse_by_country"] = with_adapter(f"""
, repeaters AS (
  SELECT user_id, mp_country_code
  FROM user_info
  WHERE {_short} AND user_id IS NOT NULL
  GROUP BY user_id, mp_country_code, os
  HAVING count(id) > 5
), per_country AS (
  SELECT geo.country, count(*) AS cheater_count
  FROM repeaters r JOIN geography geo ON geo.code = r.mp_country_code
  GROUP BY geo.country
)
SELECT country, cheater_count, CAST(rank() OVER (ORDER BY cheater_count DESC) AS BIGINT) AS fraud_rank
FROM per_country
""")

SQL["serious_cheaters"] = with_adapter(f"""
, short_lived AS (
  SELECT user_id, mp_country_code, os, created_date, {LIFE()} AS life
  FROM user_info WHERE {_short}
), grouped AS (
  SELECT user_id, mp_country_code, os,
         count(*) AS abuse_count, min(created_date) AS first_abuse, max(created_date) AS last_abuse,
         avg(life) AS avg_days_used
  FROM short_lived GROUP BY user_id, mp_country_code, os
)
SELECT s.user_id, s.mp_country_code, s.os, s.abuse_count, s.first_abuse, s.last_abuse, s.avg_days_used,
       geo.country, CAST(s.last_abuse - s.first_abuse AS BIGINT) AS abuse_period_days
FROM grouped s JOIN geography geo ON geo.code = s.mp_country_code
WHERE s.abuse_count > 5
""")

SQL["trial_suspension_by_country"] = with_adapter(f"""
, located AS (
  SELECT geo.country, u.user_id, {LIFE('u')} <= 3 AS short
  FROM user_info u JOIN geography geo ON geo.code = u.mp_country_code
), per_country AS (
  SELECT country, count(DISTINCT user_id) AS total_users, count(*) FILTER (WHERE short) AS early_suspensions
  FROM located GROUP BY country
)
SELECT country, total_users, early_suspensions,
       {R(PCT('early_suspensions', 'total_users'), 2)} AS early_suspension_rate
FROM per_country WHERE total_users >= 50
""")

SQL["platform_fraud"] = with_adapter(f"""
, flagged AS (
  SELECT platform, os, {_short} AS short
  FROM user_info WHERE platform IS NOT NULL AND os IS NOT NULL
)
SELECT platform, os, count(*) AS total_accounts,
       count(*) FILTER (WHERE short) AS suspicious_accounts,
       {R(PCT('count(*) FILTER (WHERE short)', 'count(*)'), 2)} AS fraud_rate
FROM flagged GROUP BY platform, os
""")

SQL["fraud_by_month"] = with_adapter(f"""
, flagged AS (
  SELECT CAST(year(created_date) AS BIGINT) AS year, CAST(month(created_date) AS BIGINT) AS month,
         {_short} AS short
  FROM user_info WHERE created_date IS NOT NULL
)
SELECT year, month, count(*) AS total_registrations,
       count(*) FILTER (WHERE short) AS trial_abuse_cases,
       {R(PCT('count(*) FILTER (WHERE short)', 'count(*)'), 2)} AS abuse_rate
FROM flagged GROUP BY year, month
""")

SQL["account_anomalies"] = with_adapter(f"""
, people AS (
  SELECT user_id, mp_country_code, os, count(*) AS n,
         max(created_date) - min(created_date) AS span, avg({LIFE()}) AS mean_life
  FROM user_info GROUP BY user_id, mp_country_code, os
)
SELECT user_id, mp_country_code, os, n AS account_count,
       CAST(span AS BIGINT) AS account_span_days,
       {R('mean_life', 2)} AS avg_usage_days,
       CASE WHEN n > 10 THEN 'Extreme Risk'
            WHEN n > 5 THEN 'High Risk'
            WHEN n > 2 AND mean_life < 7 THEN 'Medium Risk'
            ELSE 'Low Risk' END AS fraud_risk_level
FROM people WHERE n > 1
""")
