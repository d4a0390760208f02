"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; there are no Python UDFs anywhere in the library.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def rnd(c, n: int) -> Column:
    """Round half away from zero on doubles, identical on every engine.

    ``sign(x) * floor(|x| * 10^n + 0.5) / 10^n``; adding 0.0 turns -0.0
    into 0.0.  From 2^53 on a scaled double has no digits left to round and
    stays as it is.
    """
    x = dbl(c)
    scale = float(10 ** n)
    scaled = F.abs(x) * F.lit(scale)
    whole = F.when(scaled < F.lit(float(1 << 53)), F.floor(scaled + F.lit(0.5)).cast("double"))
    return F.coalesce(F.signum(x) * whole / F.lit(scale), x) + F.lit(0.0)


EXACT_TYPE = "decimal(27,12)"
COUNT_TYPE = "decimal(10,0)"
EXACT_LIMIT = 1e12


def exact_sum(c, weight=None) -> Column:
    """SUM of a double (times a whole ``weight``) that does not depend on the
    order rows arrive in (stable under retries and across engines).

    Products below 1e12 are accumulated as decimals, exactly to 12 places; what
    a decimal cannot hold (larger products, digits beyond the 12th place) goes
    into a second sum of doubles, so no value raises, is lost or becomes 0."""
    x, w = dbl(c), F.lit(1.0) if weight is None else dbl(weight)
    held = F.when(F.abs(x * w) < F.lit(EXACT_LIMIT), x.try_cast(EXACT_TYPE))
    product = held if weight is None else held * col(weight).try_cast(COUNT_TYPE)
    rest = F.when(product.isNull(), x * w).otherwise((x - dbl(held)) * w)
    return F.coalesce(dbl(F.sum(product)), F.lit(0.0)) + F.sum(rest)


def exact_avg(c) -> Column:
    """AVG of a double, accumulated by ``exact_sum``."""
    return F.try_divide(exact_sum(c), dbl(F.count(col(c))))


def div(a, b) -> Column:
    """a / b as double; NULL instead of an error when b is 0 or NULL."""
    return F.try_divide(dbl(a), dbl(b))


def pct(a, b) -> Column:
    """a * 100 / b as double (the literal is a double, not a decimal)."""
    return F.try_divide(dbl(a) * F.lit(100.0), dbl(b))


def date_lit(d: dt.date) -> Column:
    return F.lit(d).cast("date")


def life_days(as_of: dt.date, created="created_date", last_login="last_login") -> Column:
    """Days between creation and last login, open accounts censored at as_of."""
    return F.datediff(F.coalesce(col(last_login), date_lit(as_of)), col(created))


def month_boundaries(as_of: dt.date, created="created_date") -> Column:
    """Calendar-month boundaries crossed between created and as_of."""
    c = col(created)
    return (F.lit(as_of.year) - F.year(c)) * 12 + (F.lit(as_of.month) - F.month(c))


def percent_text(x: Column) -> Column:
    """Render a rounded percentage as text with a '%' suffix; whole numbers
    print without a trailing '.0'."""
    return F.concat(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("%"))


def minutes_between(start, end) -> Column:
    """Whole elapsed minutes (truncated), as the gaming report uses."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def days_between_ts(start, end) -> Column:
    """Whole elapsed 24-hour periods between two timestamps."""
    return F.timestamp_diff("DAY", col(start), col(end))


def first_match(cases: list[tuple[Column, object]], default) -> Column:
    """Searched CASE: the first true condition wins, else ``default``."""
    expr = None
    for cond, value in cases:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def order_key(c, labels: list[str]) -> Column:
    """Position of a label in ``labels`` (1-based) for presentation ordering."""
    return first_match([(col(c) == lab, F.lit(i + 1)) for i, lab in enumerate(labels)], F.lit(None))
