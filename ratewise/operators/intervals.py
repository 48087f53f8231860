"""Range joins (FLT-02 on many dates).

A join on ``start <= day and (end is null or end >= day)`` alone is a nested
loop.  Here an interval is posted under every bucket of days that it touches
within the days asked for, and a day meets the intervals of its one bucket: an
equi-join on the keys and the bucket, with the exact predicate after it.  A
shuffle or broadcast join is the planner's choice, and AQE splits hot buckets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket: an interval is posted once for so many days at most.
BUCKET_DAYS = 32


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width))


def interval_join(days: DataFrame, intervals: DataFrame, day: str, start: str, end: str, low: dt.date, high: dt.date,
                  on: tuple[str, ...] = (), width: int = BUCKET_DAYS) -> DataFrame:
    """Rows of ``days`` with each row of ``intervals`` (equal in ``on``) that
    holds on the day; the end belongs to the interval and NULL means open.

    ``low`` and ``high`` bound the days asked for, and with them how often an
    interval is posted; days outside them have no result.  NULL days, NULL
    starts and intervals that end before they start hold nothing.  Other columns
    than ``on`` must have different names."""
    asked = days.where(F.col(day).between(F.lit(low), F.lit(high))).withColumn("_bucket", _bucket(F.col(day), width))
    first = F.greatest(F.col(start), F.lit(low))
    last = F.least(F.coalesce(F.col(end), F.lit(high)), F.lit(high))
    touching = intervals.where((F.col(start) <= F.lit(high)) & (F.col(end).isNull() | (F.col(end) >= F.lit(low)) & (F.col(end) >= F.col(start))))
    posted = touching.withColumn("_bucket", F.explode(F.sequence(_bucket(first, width), _bucket(last, width))))
    holds = (F.col(start) <= F.col(day)) & (F.col(end).isNull() | (F.col(end) >= F.col(day)))
    return asked.join(posted, [*on, "_bucket"]).where(holds).drop("_bucket")
