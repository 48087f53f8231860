"""Queries for scans, filters, the demand fact and calendar parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.calendar import calendar_parts
from ratewise.functions.mathx import rnd_sql as R
from ratewise.operators import demand as dm
from ratewise.plans import params as P
from ratewise.plans.oracle_views import with_views
from ratewise.plans.registry import query

# SQL fragments shared by several oracles ----------------------------------
US_WEEK_SQL = "CAST(floor((dayofyear({d}) + dayofweek(date_trunc('year', {d})) - 1) / 7) AS INTEGER) + 1"


def calendar_sql(d: str, weekend=(0, 6)) -> str:
    """Oracle form of :func:`calendar_parts` (DuckDB dayofweek 0 = Sunday)."""
    wk = ", ".join(str(x) for x in weekend)
    return (
        f"CAST(dayofweek({d}) AS INTEGER) AS day_of_week, CAST(day({d}) AS INTEGER) AS day_of_month, "
        f"{US_WEEK_SQL.format(d=d)} AS week_of_year, CAST(month({d}) AS INTEGER) AS month_of_year, "
        f"CAST(quarter({d}) AS INTEGER) AS quarter, dayofweek({d}) IN ({wk}) AS is_weekend"
    )


FACT_SQL = f"""
    SELECT tenant_id, branch_id, category_id, demand_date, executed_rentals_count,
           {R('avg_p', 4)} AS avg_base_price_paid, {R('min_p', 4)} AS min_base_price_paid,
           {R('max_p', 4)} AS max_base_price_paid, {calendar_sql('demand_date')}
    FROM (SELECT c.tenant_id, c.branch_id, v.category_id, c.start_date AS demand_date,
                 count(*) AS executed_rentals_count, avg(daily_rate) AS avg_p,
                 min(daily_rate) AS min_p, max(daily_rate) AS max_p
          FROM contracts c JOIN vehicles v ON c.tenant_id = v.tenant_id AND c.vehicle_id = v.vehicle_id
          WHERE c.status_id = 211
          GROUP BY 1, 2, 3, 4)"""


@query("flt_01", with_views(f"""
    SELECT contract_id, branch_id, vehicle_id, start_date, daily_rate FROM contracts
    WHERE status_id = 211 AND tenant_id = 1
      AND start_date BETWEEN DATE '{P.FILTER_FROM}' AND DATE '{P.FILTER_TO}'""", "contracts"))
def flt_01(d):
    """FLT-01: executed rentals of the tenant in a start-date window."""
    ex = dm.executed_rentals(d.contracts, P.FILTER_FROM, P.FILTER_TO, d.tenant_id)
    return ex.select("contract_id", "branch_id", "vehicle_id", "start_date", "daily_rate")


@query("jn_01", with_views("""
    SELECT c.contract_id, c.branch_id, c.vehicle_id, v.model_id, v.category_id, c.start_date
    FROM contracts c JOIN vehicles v ON c.tenant_id = v.tenant_id AND c.vehicle_id = v.vehicle_id
    WHERE c.status_id = 211""", "contracts", "vehicles"))
def jn_01(d):
    """JN-01: executed contract -> vehicle -> model -> category."""
    ex = dm.with_category(dm.executed_rentals(d.contracts), d.vehicles)
    return ex.select("contract_id", "branch_id", "vehicle_id", "model_id", "category_id", "start_date")


@query("agg_01", with_views(FACT_SQL, "contracts", "vehicles"))
def agg_01(d):
    """AGG-01: daily demand fact over the whole contract history."""
    return dm.build_daily_demand(d)


@query("prj_03", with_views(f"""
    SELECT DISTINCT start_date AS d, {calendar_sql('start_date', (5, 6))}
    FROM contracts""", "contracts"))
def prj_03(d):
    """PRJ-03 / DT-02: calendar parts of every contract start day
    (weekend = Friday + Saturday)."""
    from ratewise.functions.calendar import DEFAULT_WEEKEND
    days = d.contracts.select(F.col("start_date").alias("d")).distinct()
    return days.select("d", *calendar_parts("d", DEFAULT_WEEKEND))
