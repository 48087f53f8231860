"""Calendar scalar expressions (PRJ-03, DT-01..06).

All are built-in Column expressions, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark ``dayofweek``: 1 = Sunday ... 7 = Saturday.
SUN, MON, TUE, WED, THU, FRI, SAT = range(1, 8)
# Weekend of the market the engine prices for (Friday and Saturday).
DEFAULT_WEEKEND = (FRI, SAT)
# Weekend as the demand fact's T-SQL computes it (Sunday and Saturday).
FACT_WEEKEND = (SUN, SAT)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week0(d) -> Column:
    """0 = Sunday ... 6 = Saturday (T-SQL ``DATEPART(WEEKDAY) - 1``)."""
    return F.dayofweek(_c(d)) - 1


def us_week(d) -> Column:
    """US week of year: week 1 holds 1 January, weeks start on Sunday."""
    d = _c(d)
    return F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7).cast("int") + 1


def is_weekend(d, weekend_days=DEFAULT_WEEKEND) -> Column:
    return F.dayofweek(_c(d)).isin(list(weekend_days))


def day_number(d) -> Column:
    """Days since 1970-01-01: the numeric order key for RANGE frames."""
    return F.datediff(_c(d), F.lit("1970-01-01").cast("date"))


def calendar_parts(d, weekend_days=FACT_WEEKEND) -> list[Column]:
    """The fact table's calendar columns for date column ``d``."""
    d = _c(d)
    return [
        day_of_week0(d).cast("int").alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_month"),
        us_week(d).alias("week_of_year"),
        F.month(d).alias("month_of_year"),
        F.quarter(d).alias("quarter"),
        is_weekend(d, weekend_days).alias("is_weekend"),
    ]
