"""Structured Streaming re-aims of the daily feeds (STM-01..05).

The reference refreshes its tables with once-a-day scripts.  Here each feed is
a streaming query over the files of a table: ``readStream`` -> one partial
result per micro-batch -> a Parquet folder ``epoch=<batch id>`` of the feed's
table.  Files of a backfill come in any order, so no row may be dropped as
late: a micro-batch is aggregated by itself, without a watermark, and readers
add the partial results up.

A feed has a stable name: table and checkpoint live in one folder named after
feed and source, and a later run takes up new files only.  A table of one file
that is rewritten in place is another source, and starts a new feed.  A replayed batch
overwrites its own folder, so nothing is counted twice; no other folder is
touched.  Two feeds keep state by period of time instead of sums: one drops what
was seen within a day (STM-04), one merges rows by key (STM-03).  Triggered with ``availableNow`` the query processes what is there and
stops; run continuously it keeps the table fresh.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.session import checkpoint_dir
from ratewise.sinks.io import FILES_PER_PARTITION

#: Files of a micro-batch.
MAX_FILES = 64


def single_file(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether the table at ``path`` is one Parquet file (no folder), and then
    its version: when it was written, and its size."""
    name = path.rstrip("/").rpartition("/")[2]
    try:
        found = spark.read.parquet(path).select("_metadata.file_path", F.unix_micros("_metadata.file_modification_time"),
                                                "_metadata.file_size").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False, ""
        raise
    if found and found[0][0].rpartition("/")[2] == name:
        return True, f"@{found[0][1]}-{found[0][2]}"
    return False, ""


class FeedTable:
    """A feed's partial results, one folder per micro-batch, and its checkpoint."""

    def __init__(self, spark: SparkSession, name: str, source: str):
        self.spark = spark
        mark = hashlib.sha256((source + single_file(spark, source)[1]).encode()).hexdigest()[:16]
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/ratewise-streams/{name}-{mark}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/data/epoch={epoch}")

    def read(self) -> DataFrame | None:
        """All partial results with their ``epoch``; None before the first."""
        return _read(self.spark.read, f"{self.root}/data")


def stream_table(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """A streaming read of the table at ``path``, one Parquet file or a folder
    of them (new files of a folder are picked up as they land)."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files)
    if single_file(spark, path)[0]:  # one file: a stream needs its folder
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


Partial = Callable[[DataFrame], DataFrame]


def run_available(stream: DataFrame, table: FeedTable, partial: Partial) -> DataFrame:
    """Run ``stream`` over all input that is new (``availableNow``), writing
    ``partial`` of every micro-batch, and return the table's partial results."""
    def write(batch: DataFrame, epoch: int) -> None:
        table.write(partial(batch), epoch)

    _run(stream, table, write)
    out = table.read()
    if out is None:
        raise RuntimeError("the stream has produced no batch: its source holds no files")
    return out


#: How a kept table is partitioned by time: the pattern of a partition's name.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


class PeriodTable(FeedTable):
    """Rows kept by period of time, and within it by micro-batch, so that a
    micro-batch reads the periods it touches and no others."""

    def __init__(self, spark: SparkSession, name: str, source: str, period: str = "month"):
        super().__init__(spark, f"{name}-{period}", source)
        self.pattern = PERIODS[period]

    def periods(self, rows: DataFrame, *times: Column) -> list[str]:
        """The periods of the given times: as many as the calendar has."""
        each = rows.select(F.explode(F.array(*[F.date_format(t, self.pattern) for t in times])).alias("p"))
        return sorted(r.p for r in each.distinct().collect())

    def write_periods(self, rows: DataFrame, time: str, epoch: int) -> None:
        """Adds rows as of a micro-batch; a replayed one overwrites its own."""
        named = rows.withColumn("period", F.date_format(time, self.pattern)).withColumn("epoch", F.lit(epoch))
        (named.repartition("period", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES_PER_PARTITION))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("period", "epoch").parquet(f"{self.root}/data"))

    def read_periods(self, periods: list[str]) -> DataFrame | None:
        """Rows of these periods alone, with ``period`` and ``epoch``."""
        some = "{" + ",".join(periods) + "}"
        return _read(self.spark.read.option("basePath", f"{self.root}/data"), f"{self.root}/data/period={some}") if periods else None


def _read(reader, *paths: str) -> DataFrame | None:
    try:
        return reader.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _run(stream: DataFrame, table: FeedTable, write: Callable[[DataFrame, int], None]) -> None:
    query = (stream.writeStream.option("checkpointLocation", table.checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def apart(rows: DataFrame, keys: list[str], time: str, ttl: dt.timedelta) -> DataFrame:
    """Of rows with different (keys, time), the earliest of each key and then
    always the next that is at least ``ttl`` after the last one taken.  A task
    reads its keys in order of time and holds one row of each."""
    width, n = ttl // dt.timedelta(microseconds=1), len(keys)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, 0
        for batch in batches:
            at = []
            for i, (*k, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(n + 1)], strict=True)):
                if k != key or t >= until:
                    key, until = k, t + width
                    at.append(i)
            yield batch.take(pa.array(at, pa.int64())).drop_columns(["_at"])

    shape = rows.select(*keys, time).schema
    ordered = rows.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), time)
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, "_at")
    return ordered.mapInArrow(take, shape)


def not_seen(new: DataFrame, kept: DataFrame | None, keys: list[str], time: str, ttl: dt.timedelta) -> DataFrame:
    """The rows (keys, time) of ``new`` to keep beside ``kept``: no two kept
    rows of a key are less than ``ttl`` apart, and each row that is not kept is
    less than ``ttl`` from a kept one."""
    new = new.select(*keys, time).dropDuplicates()
    if kept is not None:
        old = kept.select(*keys, time, F.lit(True).alias("_old"))
        at = F.col(time).cast("timestamp")
        every = Window.partitionBy(*keys).orderBy(time)
        seen = F.when(F.col("_old"), at)
        both = new.withColumn("_old", F.lit(False)).unionByName(old)
        both = (both.withColumn("_before", F.last(seen, ignorenulls=True).over(every))  # a range: rows at the same time count
                .withColumn("_after", F.first(seen, ignorenulls=True).over(every.rangeBetween(Window.currentRow, Window.unboundedFollowing))))
        far = lambda a, b: a.isNull() | b.isNull() | (F.unix_micros(b) - F.unix_micros(a) >= ttl // dt.timedelta(microseconds=1))
        new = both.where(~F.col("_old") & far(F.col("_before"), at) & far(at, F.col("_after"))).select(*keys, time)
    return apart(new, keys, time, ttl)


def run_deduplicated(stream: DataFrame, table: PeriodTable, keys: list[str], time: str, rows: Partial,
                     ttl: dt.timedelta = dt.timedelta(hours=24)) -> DataFrame:
    """STM-04: like :func:`run_available`, keeping of each micro-batch's
    ``rows`` those whose ``keys`` have not been kept within ``ttl`` of their
    ``time``; a key seen again after that counts again.

    A micro-batch is compared with the kept rows of the periods within ``ttl``
    of its own times, whenever they were written, and with no others.  So files
    may come in any order, a late file's rows stay, and the rows that are read
    do not grow with the history.  Rows without a time take no part."""
    def write(batch: DataFrame, epoch: int) -> None:
        new = rows(batch).where(F.col(time).isNotNull()).select(*keys, time)
        at = F.col(time).cast("timestamp")
        kept = table.read_periods(table.periods(new, at - ttl, at, at + ttl))
        if kept is not None:  # a replayed batch must not see its own earlier rows
            kept = kept.where(F.col("epoch") < epoch)
        table.write_periods(not_seen(new, kept, keys, time, ttl), time, epoch)

    _run(stream, table, write)
    out = table.read()
    if out is None:
        raise RuntimeError("the stream has produced no batch: its source holds no files")
    return out.select(*keys, time)


class UpsertTable(PeriodTable):
    """A table of one row per key that micro-batches merge into (STM-03).

    A micro-batch rewrites the periods that its keys lie in: it reads their
    last versions, puts the new rows in, and writes new versions beside them.
    A small log says which periods a micro-batch wrote; a reader takes each
    period's last version.  So readers never see half a merge, and a replayed
    micro-batch starts from the same versions as the first time."""

    def versions(self, before: int | None = None) -> dict[str, int]:
        """Each period's last version: as many as the calendar has periods."""
        log = _read(self.spark.read, f"{self.root}/log")
        if log is None:
            return {}
        log = log if before is None else log.where(F.col("epoch") < before)
        return {r.period: r.epoch for r in log.groupBy("period").agg(F.max("epoch").alias("epoch")).collect()}

    def _at(self, versions: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.root}/data/period={p}/epoch={e}" for p, e in sorted(versions.items())]
        return _read(self.spark.read, *paths) if paths else None

    def merge(self, rows: DataFrame, keys: list[str], time: str, order: list[str], epoch: int) -> None:
        """Rows go in by ``keys``; of several of a key the last in ``order`` stays."""
        touched = self.periods(rows, F.col(time))
        if not touched:
            return
        last = self.versions(epoch)
        before = self._at({p: last[p] for p in touched if p in last})
        self.write_periods(_latest(rows if before is None else rows.unionByName(before), keys, order), time, epoch)
        self.spark.createDataFrame([(p,) for p in touched], "period string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/epoch={epoch}")

    def current(self) -> DataFrame | None:
        return self._at(self.versions())


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def run_upserts(stream: DataFrame, table: UpsertTable, keys: list[str], time: str, order: list[str], rows: Partial) -> DataFrame:
    """STM-03: merges ``rows`` of every micro-batch into the table; the last row
    of a key in ``order`` wins, whichever file brings it.  ``time`` is one of
    the keys.  Rows without a time take no part."""
    _run(stream, table, lambda batch, epoch: table.merge(rows(batch).where(F.col(time).isNotNull()), keys, time, order, epoch))
    out = table.current()
    if out is None:
        raise RuntimeError("the stream has produced no batch: its source holds no files")
    return out


def daily_demand_partial(lineitem: DataFrame, supplier: DataFrame, vehicles: DataFrame, tenant_id: int) -> DataFrame:
    """STM-01, a micro-batch: executed rentals per branch x category x day, as
    count, sum, least and greatest rate, which add up over micro-batches."""
    li = lineitem.where(F.col("l_linestatus") == "F")
    j = (li.join(supplier.select("s_suppkey", "s_nationkey"), li.l_suppkey == supplier.s_suppkey)
           .join(vehicles.select(F.col("vehicle_id").alias("l_partkey"), "category_id"), "l_partkey"))
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    return j.groupBy(F.lit(tenant_id).alias("tenant_id"), F.col("s_nationkey").alias("branch_id"), "category_id",
                     F.to_date("l_shipdate").alias("demand_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count(rate).alias("n_rates"), F.sum(rate).alias("sum_rate"),
        F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))


def daily_demand(partials: DataFrame) -> DataFrame:
    """STM-01: the fact that the partial results add up to."""
    return partials.groupBy("tenant_id", "branch_id", "category_id", "demand_date").agg(
        F.sum("n").alias("executed_rentals_count"), F.try_divide(F.sum("sum_rate"), F.sum("n_rates")).alias("avg_rate"),
        F.min("min_rate").alias("min_rate"), F.max("max_rate").alias("max_rate"))


def activity_partial(events: DataFrame, event_city: DataFrame) -> DataFrame:
    """STM-02, a micro-batch: events per city and 7-day window, sliding by a
    day; days are counted first, so a row becomes seven only per city and day."""
    days = (events.join(F.broadcast(event_city), "event_type")  # a fixed vocabulary
            .groupBy("city_name", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    slid = days.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("start", F.date_sub("day", F.col("k")))
    return slid.groupBy("start", "city_name").agg(F.sum("n").alias("n"))


def activity(partials: DataFrame) -> DataFrame:
    """STM-02: trailing 7-day event activity per city."""
    g = partials.groupBy("start", "city_name").agg(F.sum("n").alias("events_7d"))
    return g.select(F.to_timestamp("start").alias("window_start"), F.to_timestamp(F.date_add("start", 7)).alias("window_end"),
                    "city_name", "events_7d")


def event_partial(events: DataFrame, event_city: DataFrame, tenant_id: int, shift_months: int) -> DataFrame:
    """STM-05, a micro-batch: events per city and (moved) day."""
    e = events.join(F.broadcast(event_city), "event_type")  # a fixed vocabulary
    return e.groupBy(F.lit(tenant_id).alias("tenant_id"), F.add_months(F.to_date("ts"), shift_months).alias("event_date"),
                     "city_name").agg(F.count(F.lit(1)).alias("n"))


def event_readings(events: DataFrame, event_city: DataFrame, tenant_id: int, shift_months: int) -> DataFrame:
    """STM-03, a micro-batch: each event as a reading of its city and (moved) day."""
    e = events.join(F.broadcast(event_city), "event_type")  # a fixed vocabulary
    return e.select(F.lit(tenant_id).alias("tenant_id"), F.add_months(F.to_date("ts"), shift_months).alias("event_date"), "city_name",
                    F.col("value").alias("last_value"), F.col("ts").alias("last_seen"), F.col("event_id").alias("last_event_id"))


def event_signal(partials: DataFrame) -> DataFrame:
    """STM-05: event volume per city and day, and its ln(1 + volume) score."""
    g = partials.groupBy("tenant_id", "event_date", "city_name").agg(F.sum("n").alias("event_volume"))
    return g.withColumn("event_score", F.round(F.log1p("event_volume"), 4))
