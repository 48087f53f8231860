"""Daily update and backfill of the calendar tables (CAL-05).

A table is partitioned by the year or month of its date.  A chunk of a range is
one restartable step: its rows are computed whole and merged by key into the
partitions that its dates lie in.  So any split of a range gives the same
table, and a chunk that is repeated after a failure changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.sinks import io

#: Rows of a table whose date is in [first, last].
Source = Callable[[dt.date, dt.date], DataFrame]


def chunks(first: dt.date, last: dt.date, days: int) -> Iterator[tuple[dt.date, dt.date]]:
    """The range in steps of ``days`` days, the last one shorter."""
    while first <= last:
        end = min(first + dt.timedelta(days=days - 1), last)
        yield first, end
        first = end + dt.timedelta(days=1)


class DatedTable:
    """A table with a date, merged by ``keys`` (the date among them)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], date: str, unit: str = "month"):
        self.spark, self.path, self.keys, self.date, self.unit = spark, path, keys, date, unit

    def _part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.trunc(self.date, self.unit))

    def read(self, schema) -> DataFrame:
        """All rows; none before the first merge."""
        return self.spark.read.schema(schema).parquet(self.path).drop("part") if self._there() else self.spark.createDataFrame([], schema)

    def _there(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True

    def merge(self, rows: DataFrame, first: dt.date, last: dt.date) -> int:
        """Upserts rows dated in [first, last]; how many there were.  Only the
        partitions of the range are read and written."""
        rows = io.materialize(rows.where(F.col(self.date).between(F.lit(first), F.lit(last))), "chunk")
        n = rows.count()
        if n:
            low, high = F.trunc(F.lit(first), self.unit), F.trunc(F.lit(last), self.unit)
            if self._there():
                old = self.spark.read.parquet(self.path).where(F.col("part").between(low, high)).drop("part")
                rows = io.materialize(io.merge_by_key(old, rows, self.keys, created_col=None, updated_col=None).select(rows.columns), "merged")
            io.write_partitioned(self._part(rows), self.path, ["part"])
        return n


class CalendarTables:
    """Holidays by year and event signals by month under one folder."""

    def __init__(self, spark: SparkSession, folder: str, holidays: Source, events: Source):
        self.sources = {"holidays": holidays, "events": events}
        self.tables = {"holidays": DatedTable(spark, f"{folder}/holidays", ["tenant_id", "holiday_date", "holiday_name"], "holiday_date", "year"),
                       "events": DatedTable(spark, f"{folder}/events", ["tenant_id", "event_date", "city_name"], "event_date", "month")}

    def fill(self, name: str, first: dt.date, last: dt.date, days: int) -> int:
        """Backfill in chunks of ``days`` days; rows inserted or updated."""
        return sum(self.tables[name].merge(self.sources[name](a, b), a, b) for a, b in chunks(first, last, days))

    def backfill(self, first_year: int, last_year: int, events_to: dt.date, days: int = 90) -> dict[str, int]:
        """Holidays of whole years, and of the year after; events up to a day."""
        first = dt.date(first_year, 1, 1)
        return {"holidays": self.fill("holidays", first, dt.date(last_year + 1, 12, 31), 366),
                "events": self.fill("events", first, events_to, days)}

    def daily_update(self, today: dt.date, horizon_days: int = 365) -> dict[str, int]:
        """Holidays from today over the horizon, and today's events."""
        return {"holidays": self.fill("holidays", today, today + dt.timedelta(days=horizon_days), horizon_days + 1),
                "events": self.fill("events", today, today, 1)}

    def read(self, name: str) -> DataFrame:
        any_day = dt.date(2000, 1, 1)
        return self.tables[name].read(self.sources[name](any_day, any_day).schema)
