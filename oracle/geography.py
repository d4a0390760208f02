from .common import DIV, LIFE, PCT, R, with_adapter

SQL = {}

# accounts placed in their country (one row per account)
NCC = """
, placed AS (
  SELECT u.user_id, u.mp_country_code AS country_code, geo.country, geo.latitude, geo.longitude
  FROM user_info u JOIN geography geo ON geo.code = u.mp_country_code
)"""


def _leaders(k: int) -> str:
    """The k countries with most located accounts (ties by name)."""
    return f"""
, leaders AS (
  SELECT country FROM placed GROUP BY country
  ORDER BY count(user_id) DESC, country ASC LIMIT {k}
)"""


SQL["number_customer_country"] = with_adapter(NCC + "\nSELECT user_id, country_code, country, latitude, longitude FROM placed")

SQL["top_countries"] = with_adapter(NCC + f"""
, sized AS (SELECT country, count(user_id) AS n FROM placed GROUP BY country),
  shares AS (SELECT country, n, {R(PCT('n', 'sum(n) OVER ()'), 2)} AS percentage FROM sized)
SELECT country, n AS number_customers, percentage
FROM shares
ORDER BY n DESC, country ASC LIMIT 15
""")

# placed accounts x the events of their person (left join: people without events keep one row)
SQL["country_revenue"] = with_adapter(NCC + f"""
, joined AS (
  SELECT p.country, p.country_code, p.user_id AS account_user, e.user_id AS event_user, e.id, e.fee, e.volume
  FROM placed p LEFT JOIN uevents e ON e.user_id = p.user_id
), per_code AS (
  SELECT country, country_code,
         count(DISTINCT account_user) AS users, count(DISTINCT event_user) AS active,
         coalesce(sum(fee), 0) AS revenue, coalesce(sum(volume), 0) AS vol, count(id) AS n_events
  FROM joined GROUP BY country, country_code
)
SELECT country, users AS total_users, active AS active_users,
       {R(PCT('active', 'users'), 2)} AS activation_rate,
       {R('revenue', 2)} AS total_revenue,
       {R(DIV('revenue', 'active'), 2)} AS revenue_per_active_user,
       {R(DIV('vol', 'active'), 2)} AS volume_per_active_user,
       {R(DIV('n_events', 'active'), 2)} AS events_per_active_user
FROM per_code WHERE users >= 10
""")


def _share(attr: str, count_name: str, share_name: str, having: str, leaders: int | None) -> str:
    lead = _leaders(leaders) if leaders else ""
    restrict = "JOIN leaders l ON l.country = p.country" if leaders else ""
    return with_adapter(NCC + lead + f"""
, pairs AS (
  SELECT p.country, u.{attr} AS {attr}
  FROM placed p JOIN user_info u ON u.user_id = p.user_id {restrict}
  WHERE u.{attr} IS NOT NULL
), counted AS (
  SELECT country, {attr}, count(*) AS n FROM pairs GROUP BY country, {attr} {having}
), totals AS (SELECT country, sum(n) AS country_n FROM counted GROUP BY country)
SELECT c.country, c.{attr}, c.n AS {count_name}, {R(PCT('c.n', 't.country_n'), 2)} AS {share_name}
FROM counted c JOIN totals t ON t.country = c.country
""")


SQL["country_platform_share"] = _share("platform", "users", "platform_share", "HAVING count(*) >= 5", None)
SQL["os_by_top_countries"] = _share("os", "users", "os_share", "", 10)

SQL["country_engagement"] = with_adapter(NCC + f"""
, joined AS (
  SELECT p.country, u.user_id, u.created_date, u.last_login, {LIFE('u')} AS life, e.id, e.volume, e.fee
  FROM placed p
  JOIN user_info u ON u.user_id = p.user_id
  LEFT JOIN uevents e ON e.user_id = u.user_id
), person AS (
  SELECT country, user_id, created_date, last_login, any_value(life) AS life,
         count(id) AS n_events, sum(volume) AS vol, sum(fee) AS spent
  FROM joined GROUP BY country, user_id, created_date, last_login
)
SELECT country, count(*) AS total_users,
       {R('avg(life)', 1)} AS avg_user_lifespan_days,
       {R('avg(n_events)', 1)} AS avg_events_per_user,
       {R('avg(vol)', 1)} AS avg_volume_per_user,
       {R('CAST(sum(spent) AS DOUBLE) / count(spent)', 2)} AS avg_revenue_per_user,
       count(*) FILTER (WHERE n_events > 0) AS engaged_users,
       {R(PCT('count(*) FILTER (WHERE n_events > 0)', 'count(*)'), 2)} AS engagement_rate
FROM person GROUP BY country HAVING count(*) >= 20
""")

SQL["seasonal_by_top_countries"] = with_adapter(NCC + _leaders(5) + """
, joined AS (
  SELECT p.country, CAST(month(e.date) AS BIGINT) AS month, e.user_id, e.id, e.volume, e.fee
  FROM placed p JOIN leaders l ON l.country = p.country
  JOIN oevents e ON e.user_id = p.user_id
)
SELECT country, month, count(DISTINCT user_id) AS active_users, count(id) AS total_events,
       sum(volume) AS total_volume, CAST(sum(fee) AS DOUBLE) AS total_revenue
FROM joined GROUP BY country, month
""")

SQL["country_clusters"] = with_adapter(NCC + f"""
, joined AS (
  SELECT p.country, geo.latitude, geo.longitude, p.user_id, {LIFE('u')} AS life, e.fee
  FROM placed p
  JOIN geography geo ON geo.code = p.country_code
  JOIN user_info u ON u.user_id = p.user_id
  LEFT JOIN uevents e ON e.user_id = p.user_id
), per_country AS (
  SELECT country, latitude, longitude, count(DISTINCT user_id) AS people, avg(life) AS mean_life,
         CAST(coalesce(sum(fee), 0) AS DOUBLE) / count(DISTINCT user_id) AS rev_per_person,
         count(*) FILTER (WHERE life <= 3) AS short_rows
  FROM joined GROUP BY country, latitude, longitude
)
SELECT country, latitude, longitude, people AS user_count,
       {R('mean_life', 1)} AS avg_retention_days,
       {R('rev_per_person', 2)} AS revenue_per_user,
       short_rows AS trial_abuse_users,
       {R(PCT('short_rows', 'people'), 2)} AS abuse_rate,
       CASE WHEN rev_per_person > 2000 AND mean_life > 30 THEN 'High Value'
            WHEN rev_per_person > 1000 OR mean_life > 20 THEN 'Medium Value'
            WHEN CAST(short_rows AS DOUBLE) / people > 0.2 THEN 'High Risk'
            ELSE 'Standard' END AS market_classification
FROM per_country WHERE people >= 10
""")

# longitude bands: inclusive on both ends, the first listed band wins on a shared edge
_bands = [(-180, -120, "UTC-8 to UTC-11"), (-120, -60, "UTC-4 to UTC-8"), (-60, 0, "UTC-0 to UTC-4"),
          (0, 60, "UTC+0 to UTC+4"), (60, 120, "UTC+4 to UTC+8"), (120, 180, "UTC+8 to UTC+12")]
_band_case = "CASE " + " ".join(f"WHEN geo.longitude >= {lo} AND geo.longitude <= {hi} THEN '{lab}'"
                                for lo, hi, lab in _bands) + " END"
SQL["timezone_usage"] = with_adapter(NCC + f"""
, person AS (
  SELECT p.country, p.user_id, geo.longitude, any_value({_band_case}) AS band,
         count(e.id) AS n_events, sum(e.fee) AS spent
  FROM placed p
  JOIN geography geo ON geo.code = p.country_code
  LEFT JOIN uevents e ON e.user_id = p.user_id
  GROUP BY p.country, p.user_id, geo.longitude
)
SELECT band AS timezone_region, count(DISTINCT user_id) AS users,
       CAST(sum(n_events) AS BIGINT) AS total_events,
       {R('sum(spent)', 2)} AS total_revenue,
       {R('avg(n_events)', 1)} AS avg_events_per_user,
       {R('CAST(sum(spent) AS DOUBLE) / count(spent)', 2)} AS avg_revenue_per_user
FROM person WHERE band IS NOT NULL
GROUP BY band
""")
