"""Holiday, event and calendar-feature operators (SRC-04..06, SIG-E,
CAL-01..04, WIN-06..08, JN-08).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.calendar import DEFAULT_WEEKEND, day_number, is_weekend

MAJOR_EVENT_SCORE = 3.0


def fixed_holidays(years: DataFrame, rules, tenant_id: int) -> DataFrame:
    """SRC-06: fixed-date national days for every year in ``years``.

    ``rules`` is the fixed list of (month, day, name, type); each year row
    expands the literal rule array, so no join is needed.
    """
    arr = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(dd).alias("d"), F.lit(n).alias("name"),
                             F.lit(t).alias("type")) for m, dd, n, t in rules])
    x = years.select("year", F.explode(arr).alias("r"))
    return x.select(
        F.lit(tenant_id).alias("tenant_id"),
        F.make_date("year", "r.m", "r.d").alias("holiday_date"),
        F.col("r.name").alias("holiday_name"),
        F.lit(None).cast("string").alias("holiday_name_ar"),
        F.col("r.type").alias("holiday_type"),
        F.lit(True).alias("is_public_holiday"),
    )


def event_score(volume) -> F.Column:
    """SIG-E: ln(1 + volume), 4 dp."""
    return F.round(F.log1p(volume), 4)


def event_signal(events: DataFrame, tenant_id: int) -> DataFrame:
    """STM-05 / SIG-E batch: event volume and score per city and day.

    ``events`` carries one row per raw event with ``event_date`` and
    ``city_name``; a grouped count with partial aggregation.
    """
    g = events.groupBy("event_date", "city_name").agg(F.count(F.lit(1)).alias("event_volume"))
    return g.select(
        F.lit(tenant_id).alias("tenant_id"), "event_date", "city_name", "event_volume",
        event_score(F.col("event_volume")).alias("event_score"),
    )


def day_spine(bounds: DataFrame, name: str = "cal_date") -> DataFrame:
    """DT-05: one row per day between ``lo`` and ``hi`` of each bounds row."""
    keep = [c for c in bounds.columns if c not in ("lo", "hi")]
    return bounds.select(*keep, F.explode(F.sequence("lo", "hi")).alias(name))


def holiday_by_date(holidays: DataFrame) -> DataFrame:
    """One row per tenant and date: flag, first name (by name), its type,
    public flag OR-ed (two holidays on a date give one feature row)."""
    return holidays.groupBy("tenant_id", "holiday_date").agg(
        F.min("holiday_name").alias("holiday_name"),
        F.min_by("holiday_type", "holiday_name").alias("holiday_type"),
        F.max(F.col("is_public_holiday").cast("int")).cast("boolean").alias("is_public_holiday"))


def holiday_window(spine: DataFrame, holidays: DataFrame, n: int | None = 7) -> DataFrame:
    """WIN-08 / JN-08 on a daily spine (tenant_id, cal_date):

    days to the next holiday (>= today) and since the last (<= today), -1
    when none within ``n`` days (``n=None``: unbounded as-of), name of the
    next holiday, holidays within +/- n (today counts on both sides).
    """
    h = holiday_by_date(holidays).select("tenant_id", F.col("holiday_date").alias("cal_date"),
                                         F.lit(1).alias("_h"), F.col("holiday_name").alias("_hn"))
    s = spine.join(h, ["tenant_id", "cal_date"], "left")
    dn = day_number("cal_date")
    w = Window.partitionBy("tenant_id").orderBy(dn)
    fwd = w.rangeBetween(0, n if n is not None else Window.unboundedFollowing)
    back = w.rangeBetween(-n if n is not None else Window.unboundedPreceding, 0)
    hd = F.when(F.col("_h") == 1, dn)
    nxt = F.min(F.when(F.col("_h") == 1, F.struct(dn.alias("d"), F.col("_hn").alias("name")))).over(fwd)
    cols = [
        "tenant_id", "cal_date",
        F.coalesce(F.col("_h") == 1, F.lit(False)).alias("is_holiday"),
        F.coalesce(F.min(hd).over(fwd) - dn, F.lit(-1)).alias("days_to_next_holiday"),
        F.coalesce(dn - F.max(hd).over(back), F.lit(-1)).alias("days_since_last_holiday"),
        nxt.getField("name").alias("next_holiday_name"),
    ]
    if n is not None:
        cols.append(F.coalesce(F.sum("_h").over(w.rangeBetween(-n, n)), F.lit(0)).cast("int")
                    .alias("holidays_in_window"))
    return s.select(*cols)


def calendar_features(spine: DataFrame, holidays: DataFrame, events: DataFrame,
                      weekend_days=DEFAULT_WEEKEND) -> DataFrame:
    """CAL-01 / CAL-02: per tenant, city and day: holiday flag / name /
    type, weekend, event volume and score today, 3- and 7-day event score
    means (existing rows, 4 dp, 0 when none).

    ``spine`` has (tenant_id, city_name, cal_date) for every day; the
    event windows are RANGE frames over that spine per city.
    """
    h = holiday_by_date(holidays).withColumnRenamed("holiday_date", "cal_date")
    e = events.select("tenant_id", "city_name", F.col("event_date").alias("cal_date"),
                      "event_volume", "event_score")
    s = spine.join(h, ["tenant_id", "cal_date"], "left").join(e, ["tenant_id", "city_name", "cal_date"], "left")
    w = Window.partitionBy("tenant_id", "city_name").orderBy(day_number("cal_date"))
    from ratewise.functions.mathx import rnd
    return s.select(
        "tenant_id", "city_name", "cal_date",
        F.when(F.col("holiday_name").isNotNull(), 1).otherwise(0).alias("is_holiday"),
        "holiday_name", "holiday_type",
        is_weekend("cal_date", weekend_days).cast("int").alias("is_weekend"),
        F.coalesce("event_volume", F.lit(0)).alias("event_volume_today"),
        F.coalesce("event_score", F.lit(0.0)).alias("event_score_today"),
        F.coalesce(rnd(F.avg("event_score").over(w.rangeBetween(-2, 0)), 4), F.lit(0.0)).alias("event_score_3d_avg"),
        F.coalesce(rnd(F.avg("event_score").over(w.rangeBetween(-6, 0)), 4), F.lit(0.0)).alias("event_score_7d_avg"),
    )


def holiday_type_priority(types_col, priority) -> F.Column:
    """CAL-04: first priority entry contained (case-insensitively) in any
    of the types, else the first type, else 'Unknown'."""
    t = F.col(types_col) if isinstance(types_col, str) else types_col
    def contains(p):
        return lambda x: F.lower(x).contains(p.lower())

    picks = [F.when(F.exists(t, contains(p)), F.lit(p)) for p in priority]
    return F.coalesce(*picks, F.try_element_at(t, F.lit(1)), F.lit("Unknown"))


def holiday_payload(holidays: DataFrame) -> DataFrame:
    """The holiday provider's yearly payload, built from holiday rows:
    response.holidays[] with date.iso, name, name_local and a type list."""
    item = F.struct(
        F.struct(F.date_format("holiday_date", "yyyy-MM-dd'T'00:00:00").alias("iso")).alias("date"),
        F.col("holiday_name").alias("name"),
        F.col("holiday_name_ar").alias("name_local"),
        F.array(F.col("holiday_type")).alias("type"),
    )
    g = holidays.groupBy("tenant_id", F.year("holiday_date").alias("year")).agg(
        F.array_sort(F.collect_list(item)).alias("holidays"))
    return g.select("tenant_id", "year",
                    F.to_json(F.struct(F.struct("holidays").alias("response"))).alias("payload"))


HOLIDAY_PAYLOAD_SCHEMA = ("response struct<holidays: array<struct<date: struct<iso: string>, name: string, "
                          "name_local: string, type: array<string>>>>")


def normalise_holiday_payload(payloads: DataFrame, priority) -> DataFrame:
    """SRC-04: payload -> one row per holiday; ISO date prefix (10 chars),
    empty dates skipped, a missing name is Unknown, priority type (CAL-04), public when any type
    names a national holiday."""
    p = payloads.select("tenant_id", F.explode(
        F.from_json("payload", HOLIDAY_PAYLOAD_SCHEMA).getField("response").getField("holidays")).alias("h"))
    iso = F.col("h.date.iso")
    p = p.where(iso.isNotNull() & (F.length(iso) >= 10))
    return p.select(
        "tenant_id",
        F.to_date(F.substring(iso, 1, 10)).alias("holiday_date"),
        F.coalesce("h.name", F.lit("Unknown")).alias("holiday_name"),
        F.col("h.name_local").alias("holiday_name_ar"),
        holiday_type_priority(F.col("h.type"), priority).alias("holiday_type"),
        F.exists(F.col("h.type"), lambda x: x == "National holiday").alias("is_public_holiday"),
    )


def holiday_summary(holidays: DataFrame) -> DataFrame:
    """AGG-13: holidays, date range, distinct years."""
    return holidays.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("holidays"), F.min("holiday_date").alias("min_date"),
        F.max("holiday_date").alias("max_date"),
        F.countDistinct(F.year("holiday_date")).alias("years"))


def event_summary(events: DataFrame) -> DataFrame:
    """AGG-14: event rows, date range, distinct cities."""
    return events.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("event_rows"), F.min("event_date").alias("min_date"),
        F.max("event_date").alias("max_date"), F.countDistinct("city_name").alias("cities"))
