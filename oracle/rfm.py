from .common import AS_OF, PCT, R, with_adapter
from .sessions import EVENTS_UPDATED

SQL = {}

# per (person, creation date): days since last session, sessions and spend per
# calendar month of tenure (month boundaries crossed up to the as-of date)
BASE = EVENTS_UPDATED + f"""
, spend AS (
  SELECT u.user_id, u.created_date,
         CAST(date_diff('day', max(e.date), {AS_OF}) AS BIGINT) AS recency,
         count(e.id) AS n_sessions, sum(e.fee) AS total_fee,
         (2024 - year(u.created_date)) * 12 + (2 - month(u.created_date)) AS months
  FROM user_info u JOIN events_updated e ON e.user_id = u.user_id
  WHERE u.user_id IS NOT NULL
  GROUP BY u.user_id, u.created_date
), metrics AS (
  SELECT user_id, created_date, recency,
         CAST(n_sessions AS DOUBLE) / NULLIF(months, 0) AS frequency,
         CAST(total_fee AS DOUBLE) / NULLIF(months, 0) AS monetary
  FROM spend
), ranked AS (
  SELECT *,
         CAST(row_number() OVER (ORDER BY recency DESC NULLS LAST, user_id, created_date NULLS FIRST) AS BIGINT) AS recency_rn,
         CAST(row_number() OVER (ORDER BY frequency ASC NULLS FIRST, user_id, created_date NULLS FIRST) AS BIGINT) AS frequency_rn,
         CAST(row_number() OVER (ORDER BY monetary ASC NULLS FIRST, user_id, created_date NULLS FIRST) AS BIGINT) AS monetary_rn
  FROM metrics
)"""

# thresholds: the value at position round(q * N) (half away from zero) of
# each ordering; NULL when that position does not exist
SCORED = BASE + """
, positions AS (
  SELECT q.i, CAST(floor(q.p * (SELECT count(user_id) FROM ranked) + 0.5) AS BIGINT) AS pos
  FROM (VALUES (1, 0.25), (2, 0.5), (3, 0.75)) AS q(i, p)
), cut AS (
  SELECT max(CASE WHEN q.i = 1 THEN r.recency END) AS r1,
         max(CASE WHEN q.i = 2 THEN r.recency END) AS r2,
         max(CASE WHEN q.i = 3 THEN r.recency END) AS r3
  FROM positions q LEFT JOIN ranked r ON r.recency_rn = q.pos
), cut_f AS (
  SELECT max(CASE WHEN q.i = 1 THEN r.frequency END) AS f1,
         max(CASE WHEN q.i = 2 THEN r.frequency END) AS f2,
         max(CASE WHEN q.i = 3 THEN r.frequency END) AS f3
  FROM positions q LEFT JOIN ranked r ON r.frequency_rn = q.pos
), cut_m AS (
  SELECT max(CASE WHEN q.i = 1 THEN r.monetary END) AS m1,
         max(CASE WHEN q.i = 2 THEN r.monetary END) AS m2,
         max(CASE WHEN q.i = 3 THEN r.monetary END) AS m3
  FROM positions q LEFT JOIN ranked r ON r.monetary_rn = q.pos
), scored AS (
  SELECT k.*,
    CAST(CASE WHEN k.recency < (SELECT r1 FROM cut) THEN 1
              WHEN k.recency >= (SELECT r1 FROM cut) AND k.recency < (SELECT r2 FROM cut) THEN 2
              WHEN k.recency >= (SELECT r2 FROM cut) AND k.recency < (SELECT r3 FROM cut) THEN 3
              ELSE 4 END AS BIGINT) AS R,
    CAST(CASE WHEN k.frequency < (SELECT f1 FROM cut_f) THEN 1
              WHEN k.frequency >= (SELECT f1 FROM cut_f) AND k.frequency < (SELECT f2 FROM cut_f) THEN 2
              WHEN k.frequency >= (SELECT f2 FROM cut_f) AND k.frequency < (SELECT f3 FROM cut_f) THEN 3
              ELSE 4 END AS BIGINT) AS F,
    CAST(CASE WHEN k.monetary < (SELECT m1 FROM cut_m) THEN 1
              WHEN k.monetary >= (SELECT m1 FROM cut_m) AND k.monetary < (SELECT m2 FROM cut_m) THEN 2
              WHEN k.monetary >= (SELECT m2 FROM cut_m) AND k.monetary < (SELECT m3 FROM cut_m) THEN 3
              ELSE 4 END AS BIGINT) AS M
  FROM ranked k
)"""

SEGMENTS = SCORED + """
, segmented AS (
  SELECT user_id, created_date, recency, frequency, monetary, R, F, M,
         CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS rfm_score,
         CASE WHEN F <= 2 AND M <= 2 THEN 'Walk-in Guests'
              WHEN F <= 2 THEN 'Potential Customers'
              WHEN R >= 3 AND M <= 2 THEN 'Regular Customers'
              WHEN R >= 3 THEN 'VIP'
              ELSE 'At-risk Customer' END AS customer_segment
  FROM scored
)"""


def X(c: str) -> str:
    """Exact accumulation of a double (the library sums money this way)."""
    return f"CAST(sum(CAST({c} AS DECIMAL(27,12))) AS DOUBLE)"


SQL["rfm_base"] = with_adapter(BASE + """
SELECT user_id, created_date, recency, frequency, monetary, recency_rn, frequency_rn, monetary_rn FROM ranked
""")

SQL["rfm_scores"] = with_adapter(SCORED + """
SELECT user_id, created_date, recency, frequency, monetary, recency_rn, frequency_rn, monetary_rn, R, F, M
FROM scored
""")

SQL["rfm_segments"] = with_adapter(SEGMENTS + "\nSELECT * FROM segmented")

SQL["segment_summary"] = with_adapter(SEGMENTS + f"""
, per_segment AS (
  SELECT customer_segment, count(*) AS n, avg(recency) AS mean_recency,
         {X('frequency')} / count(frequency) AS mean_frequency,
         {X('monetary')} / count(monetary) AS mean_monetary, {X('monetary')} AS total_monetary
  FROM segmented GROUP BY customer_segment
)
SELECT customer_segment, n AS customer_count,
       {R(PCT('n', 'sum(n) OVER ()'), 2)} AS percentage,
       {R('mean_recency', 2)} AS avg_recency, {R('mean_frequency', 2)} AS avg_frequency,
       {R('mean_monetary', 2)} AS avg_monetary, {R('total_monetary', 2)} AS total_revenue_contribution
FROM per_segment
""")

SQL["rfm_score_distribution"] = with_adapter(SEGMENTS + f"""
, combos AS (SELECT rfm_score, customer_segment, count(*) AS n FROM segmented GROUP BY rfm_score, customer_segment)
SELECT rfm_score, customer_segment, n AS count, {R(PCT('n', 'sum(n) OVER ()'), 2)} AS percentage
FROM combos
ORDER BY n DESC, rfm_score, customer_segment LIMIT 20
""")

# segments x accounts of the same person (one row per account)
SQL["segment_by_country"] = with_adapter(SEGMENTS + f"""
, joined AS (
  SELECT geo.country, s.customer_segment, s.monetary
  FROM segmented s
  JOIN user_info u ON u.user_id = s.user_id
  JOIN geography geo ON geo.code = u.mp_country_code
)
SELECT country, customer_segment, count(*) AS customer_count,
       {R(X('monetary') + ' / count(monetary)', 2)} AS avg_monetary_value,
       {R(X('monetary'), 2)} AS total_revenue
FROM joined GROUP BY country, customer_segment HAVING count(*) >= 10
""")

SQL["segment_by_platform"] = with_adapter(SEGMENTS + f"""
, joined AS (
  SELECT u.platform, s.customer_segment, s.frequency, s.monetary
  FROM segmented s JOIN user_info u ON u.user_id = s.user_id
  WHERE u.platform IS NOT NULL
)
SELECT platform, customer_segment, count(*) AS customer_count,
       {R(X('frequency') + ' / count(frequency)', 2)} AS avg_frequency,
       {R(X('monetary') + ' / count(monetary)', 2)} AS avg_monetary
FROM joined GROUP BY platform, customer_segment
""")

SQL["segment_lifecycle"] = with_adapter(SEGMENTS + f"""
, per_segment AS (
  SELECT customer_segment, count(*) AS n,
         avg(date_diff('day', created_date, {AS_OF})) AS age, avg(recency) AS since_last,
         {X('frequency')} / count(frequency) AS per_month_sessions,
         {X('monetary')} / count(monetary) AS per_month_spend
  FROM segmented GROUP BY customer_segment
)
SELECT customer_segment, n AS total_customers,
       {R('age', 1)} AS avg_customer_age_days, {R('since_last', 1)} AS avg_days_since_last_use,
       {R('per_month_sessions', 2)} AS avg_monthly_frequency, {R('per_month_spend', 2)} AS avg_monthly_revenue,
       {R('per_month_spend * per_month_sessions', 2)} AS estimated_monthly_clv
FROM per_segment
""")

# two rows; the second row's columns are filled by position (potential, walk-in, at-risk)
SQL["segment_transitions"] = with_adapter(SEGMENTS + """
, tally AS (
  SELECT count(*) FILTER (WHERE customer_segment = 'Regular Customers') AS regular,
         count(*) FILTER (WHERE customer_segment = 'Potential Customers') AS potential,
         count(*) FILTER (WHERE customer_segment = 'At-risk Customer') AS at_risk,
         count(*) FILTER (WHERE customer_segment = 'Walk-in Guests') AS walk_in
  FROM segmented
)
SELECT 'VIP' AS target_segment, regular AS from_regular, potential AS from_potential, at_risk AS from_at_risk FROM tally
UNION ALL
SELECT 'Regular Customers', potential, walk_in, at_risk FROM tally
""")
