"""Streaming queries (STM-01..05), run with an availableNow trigger; each
is checked against the SQL of its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.calendar import FACT_WEEKEND, calendar_parts
from ratewise.functions.mathx import rnd
from ratewise.plans import misc_plans  # noqa: F401
from ratewise.plans.demand_plans import FACT_SQL
from ratewise.plans.oracle_views import with_views
from ratewise.plans.registry import query
from ratewise.sources.domain import EVENT_SHIFT_MONTHS
from ratewise.sources.fixed import TENANT_ID
from ratewise.streaming import incremental as st


def _feed(d, name, table):
    """The stream over a source table, and the table that the feed keeps."""
    path = f"{d.t.sf_dir}/{table}.parquet"
    return st.stream_table(d.spark, path), st.FeedTable(d.spark, name, path)


@query("stm_01", with_views(FACT_SQL, "contracts", "vehicles"))
def stm_01(d):
    """STM-01: incremental daily demand fact from arriving contract lines;
    equals the batch fact (AGG-01)."""
    stream, feed = _feed(d, "daily_demand", "lineitem")
    t = st.daily_demand(st.run_available(
        stream, feed, lambda b: st.daily_demand_partial(b, d.t.supplier, d.vehicles, d.tenant_id)))
    return t.select("tenant_id", "branch_id", "category_id", "demand_date", "executed_rentals_count",
                    rnd("avg_rate", 4).alias("avg_base_price_paid"), rnd("min_rate", 4).alias("min_base_price_paid"),
                    rnd("max_rate", 4).alias("max_base_price_paid"), *calendar_parts("demand_date", FACT_WEEKEND))


@query("stm_02", with_views("""
    SELECT CAST(CAST(ts AS DATE) - CAST(k AS INTEGER) AS TIMESTAMP) AS window_start,
           CAST(CAST(ts AS DATE) - CAST(k AS INTEGER) + 7 AS TIMESTAMP) AS window_end,
           ec.city_name, count(*) AS events_7d
    FROM events JOIN event_city ec ON ec.event_type = events.event_type, range(0, 7) r(k)
    GROUP BY 1, 2, 3""", "event_city"))
def stm_02(d):
    """STM-02: trailing 7-day event activity, sliding daily windows."""
    stream, feed = _feed(d, "activity_7d", "events")
    return st.activity(st.run_available(stream, feed, lambda b: st.activity_partial(b, d.fixed("event_city"))))


@query("stm_03", with_views(f"""
    SELECT {TENANT_ID} AS tenant_id, event_date, city_name, value AS last_value, ts AS last_seen, event_id AS last_event_id
    FROM (SELECT *, CAST(CAST(ts AS DATE) + INTERVAL '{EVENT_SHIFT_MONTHS} months' AS DATE) AS event_date FROM events JOIN event_city USING (event_type))
    QUALIFY row_number() OVER (PARTITION BY event_date, city_name ORDER BY ts DESC, event_id DESC) = 1""", "event_city"))
def stm_03(d):
    """STM-03: incremental upsert of each city's last reading of a day; a later
    file replaces what an earlier one brought, in the months it touches alone."""
    path = f"{d.t.sf_dir}/events.parquet"
    table = st.UpsertTable(d.spark, "event_readings", path)
    return st.run_upserts(st.stream_table(d.spark, path), table, ["tenant_id", "event_date", "city_name"], "event_date", ["last_seen", "last_event_id"],
                          lambda b: st.event_readings(b, d.fixed("event_city"), d.tenant_id, EVENT_SHIFT_MONTHS))


@query("stm_04", with_views("""
    SELECT DISTINCT competitor_name, vehicle_name, CAST(price_date AS TIMESTAMP) AS quoted_at FROM listings""", "listings"))
def stm_04(d):
    """STM-04: competitor quotes without those of a supplier and vehicle seen
    within 24 hours.  Quotes of the given tables are dated by day, so each day
    counts anew, whatever the order of the files."""
    catalog = d.vehicle_catalog.select("p_partkey", "vehicle_name")
    suppliers = d.t.supplier.select("s_suppkey", F.col("s_name").alias("competitor_name"))

    def quotes(li):
        return (li.join(catalog, li.l_partkey == catalog.p_partkey).join(suppliers, li.l_suppkey == suppliers.s_suppkey)
                .select("competitor_name", "vehicle_name", F.date_trunc("day", "l_shipdate").alias("quoted_at")))

    path = f"{d.t.sf_dir}/lineitem.parquet"
    table = st.PeriodTable(d.spark, "quotes_ttl", path)
    return st.run_deduplicated(st.stream_table(d.spark, path), table, ["competitor_name", "vehicle_name"], "quoted_at", quotes)


@query("stm_04_ttl", with_views("""
    RECURSIVE seen AS (SELECT DISTINCT event_type, user_id, ts FROM events),
    kept AS (SELECT event_type, user_id, min(ts) AS ts FROM seen GROUP BY ALL UNION ALL
      SELECT k.event_type, k.user_id, (SELECT min(s.ts) FROM seen s WHERE s.event_type = k.event_type AND s.user_id = k.user_id
        AND s.ts >= k.ts + INTERVAL 24 HOUR) AS ts FROM kept k WHERE k.ts IS NOT NULL)
    SELECT event_type, user_id, ts AS seen_at FROM kept WHERE ts IS NOT NULL""".replace("    RECURSIVE", "WITH RECURSIVE", 1)))
def stm_04_ttl(d):
    """STM-04: a user's events of a type, once within 24 hours of the last one kept."""
    path = f"{d.t.sf_dir}/events.parquet"
    table = st.PeriodTable(d.spark, "events_ttl", path)
    return st.run_deduplicated(st.stream_table(d.spark, path), table, ["event_type", "user_id"], "seen_at",
                               lambda b: b.withColumnRenamed("ts", "seen_at"))


@query("stm_05", with_views("SELECT * FROM event_signal", "event_signal"))
def stm_05(d):
    """STM-05: event volume and score per city and day (tumbling window)."""
    stream, feed = _feed(d, "event_volume", "events")
    return st.event_signal(st.run_available(
        stream, feed, lambda b: st.event_partial(b, d.fixed("event_city"), d.tenant_id, EVENT_SHIFT_MONTHS)))
