"""Date cleaning, parsing and calendar features.

All of it is native Spark SQL: no Python UDF touches a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi

# Date dialects seen in the inputs, tried in this order (day-first wins over ISO
# only when the string is day-first shaped, so the order is unambiguous).
DAY_FIRST_DATE = "dd-MM-yyyy"
ISO_DATE = "yyyy-MM-dd"
HOURLY_STAMP = "dd-MM-yyyy HH:mm"
DATE_PATTERNS = (DAY_FIRST_DATE, ISO_DATE, "dd/MM/yyyy", "yyyy/MM/dd")
STAMP_PATTERNS = (HOURLY_STAMP, "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
                  "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def fix_date_format(s) -> Column:
    """F1: ``'01-06-2023 5.30'`` -> ``'01-06-2023 05:00'``; anything else unchanged.

    The string is split on dots and whitespace; when a second part exists and
    reads as a number its integer part becomes the hour and the minutes are
    dropped, as in the reference.
    """
    s = _c(s)
    parts = F.split(s, r"[.\s]")
    hour = F.try_element_at(parts, F.lit(2)).try_cast("double").try_cast("bigint")
    fixed = F.concat(F.try_element_at(parts, F.lit(1)), F.lit(" "), F.format_string("%02d", hour), F.lit(":00"))
    return F.when((F.size(parts) >= 2) & hour.isNotNull(), fixed).otherwise(s)


def parse_hourly(s) -> Column:
    """strict ``dd-MM-yyyy HH:mm`` parse, bad strings become NULL."""
    return F.to_timestamp_ntz(F.try_to_timestamp(_c(s), F.lit(HOURLY_STAMP)))


def parse_date(s, patterns=DATE_PATTERNS) -> Column:
    """First pattern that parses wins; unparseable -> NULL."""
    s = F.trim(_c(s).cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in patterns])


def parse_timestamp(s, patterns=STAMP_PATTERNS + DATE_PATTERNS) -> Column:
    """Timestamp version of :func:`parse_date` (hourly readings)."""
    s = F.trim(_c(s).cast("string"))
    return F.coalesce(*[F.to_timestamp_ntz(F.try_to_timestamp(s, F.lit(p))) for p in patterns])


def month_start(ym) -> Column:
    """``'YYYY-MM'`` -> first day of that month."""
    return F.to_date(F.concat(_c(ym), F.lit("-01")), "yyyy-MM-dd")


def month_end(ym) -> Column:
    """``'YYYY-MM'`` -> last day of that month."""
    return F.last_day(month_start(ym))


def horizon_days(start, end) -> Column:
    """inclusive number of days between two dates."""
    return F.datediff(_c(end), _c(start)) + F.lit(1)


def cyc_sin(x, period: float) -> Column:
    return F.sin(F.lit(TWO_PI) * _c(x) / F.lit(float(period)))


def cyc_cos(x, period: float) -> Column:
    return F.cos(F.lit(TWO_PI) * _c(x) / F.lit(float(period)))


def calendar_columns(date="date", day_of_year: bool = True) -> dict[str, Column]:
    """F5-F8 as a dict for ``withColumns`` (F6 is ``dayofyear``).

    Day/Month/Year, month sin/cos over 12 and day-of-year sin/cos over 365
    (365 also in leap years, as in the reference).
    """
    d = _c(date)
    cols = {
        "day": F.dayofmonth(d),
        "month": F.month(d),
        "year": F.year(d),
        "month_sin": cyc_sin(F.month(d), 12),
        "month_cos": cyc_cos(F.month(d), 12),
    }
    if day_of_year:
        cols["dayofyear"] = F.dayofyear(d)
        cols["dayofyear_sin"] = cyc_sin(F.dayofyear(d), 365)
        cols["dayofyear_cos"] = cyc_cos(F.dayofyear(d), 365)
    return cols


def to_number(s) -> Column:
    """text -> double, invalid text -> NULL (callers decide to raise)."""
    return F.trim(_c(s).cast("string")).try_cast("double")
