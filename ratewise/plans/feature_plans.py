"""Queries for time-series features, the feature store and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd_sql as R
from ratewise.operators import boosted as bo
from ratewise.operators import demand as dm
from ratewise.operators import features as fe
from ratewise.operators import timeseries as ts
from ratewise.plans import params as P
from ratewise.plans.demand_plans import FACT_SQL
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sinks import io

CUT = f"DATE '{P.SPLIT_CUTOFF}'"
DAYNO = "(demand_date - DATE '1970-01-01')"
SER = "PARTITION BY tenant_id, branch_id, category_id ORDER BY " + DAYNO

register_view("fact", FACT_SQL, ("contracts", "vehicles"))
register_view("rentals", """
    SELECT c.*, v.model_id, v.category_id FROM contracts c
    JOIN vehicles v ON c.tenant_id = v.tenant_id AND c.vehicle_id = v.vehicle_id
    WHERE c.status_id = 211""", ("contracts", "vehicles"))
register_view("fleet_size", """
    SELECT tenant_id, branch_id, category_id, count(DISTINCT vehicle_id) AS fleet_size
    FROM vehicles WHERE NOT is_deleted GROUP BY 1, 2, 3""", ("vehicles",))
register_view("on_rent_daily", """
    SELECT tenant_id, branch_id, category_id, day, count(DISTINCT vehicle_id) AS vehicles_on_rent
    FROM (SELECT tenant_id, branch_id, category_id, vehicle_id,
                 CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
          FROM rentals WHERE start_date <= end_date)
    GROUP BY 1, 2, 3, 4""", ("rentals",))
register_view("holiday_flags", """
    SELECT tenant_id, holiday_date AS demand_date,
           bool_or(is_public_holiday) AS is_public_holiday,
           bool_or(lower(holiday_type) IN ('religious', 'islamic', 'muslim')) AS is_religious_holiday
    FROM holidays GROUP BY 1, 2""", ("holidays",))
register_view("feature_store", f"""
    SELECT f.*,
           {R('CAST(o.vehicles_on_rent AS DOUBLE) / nullif(fs.fleet_size, 0)', 4)} AS utilization_contracts,
           CAST(NULL AS DOUBLE) AS utilization_bookings,
           w.t_max AS temperature_max, w.t_min AS temperature_min, w.t_mean AS temperature_avg,
           w.precipitation_sum AS precipitation_mm, w.wind_max AS wind_speed_kmh,
           coalesce(h.is_public_holiday, FALSE) AS is_public_holiday,
           coalesce(h.is_religious_holiday, FALSE) AS is_religious_holiday,
           FALSE AS is_school_holiday,
           e.event_score, coalesce(e.event_score >= 3, FALSE) AS has_major_event,
           CASE WHEN f.demand_date < {CUT} THEN 'TRAIN' ELSE 'VALIDATION' END AS split_flag
    FROM (SELECT *,
           max(executed_rentals_count) OVER ({SER} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS rentals_lag_1d,
           max(executed_rentals_count) OVER ({SER} RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS rentals_lag_7d,
           {R(f'avg(executed_rentals_count) OVER ({SER} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)', 4)} AS rentals_rolling_7d_avg,
           {R(f'avg(executed_rentals_count) OVER ({SER} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)', 4)} AS rentals_rolling_30d_avg
          FROM fact) f
    LEFT JOIN on_rent_daily o ON o.tenant_id = f.tenant_id AND o.branch_id = f.branch_id
         AND o.category_id = f.category_id AND o.day = f.demand_date
    LEFT JOIN fleet_size fs ON fs.tenant_id = f.tenant_id AND fs.branch_id = f.branch_id
         AND fs.category_id = f.category_id
    LEFT JOIN weather w ON w.tenant_id = f.tenant_id AND w.branch_id = f.branch_id AND w.weather_date = f.demand_date
    LEFT JOIN holiday_flags h ON h.tenant_id = f.tenant_id AND h.demand_date = f.demand_date
    LEFT JOIN branches b ON b.tenant_id = f.tenant_id AND b.branch_id = f.branch_id
    LEFT JOIN event_signal e ON e.tenant_id = f.tenant_id AND e.event_date = f.demand_date
         AND e.city_name = b.city_name""",
              ("fact", "on_rent_daily", "fleet_size", "weather", "holiday_flags", "branches", "event_signal"))

KEYS = "tenant_id, branch_id, category_id, demand_date"


def _fs(d):
    """The feature store of the default split (one DataFrame per Domain)."""
    if "_fs" not in d.__dict__:
        d.__dict__["_fs"] = fe.build_feature_store(d, P.SPLIT_CUTOFF)
    return d.__dict__["_fs"]


def _fact_split(d):
    """The demand fact with its split flag: what the forecasting and
    pricing queries read (the full feature store is not needed there)."""
    if "_fs" in d.__dict__:
        return d.__dict__["_fs"]
    if "_fact_split" not in d.__dict__:
        d.__dict__["_fact_split"] = dm.build_daily_demand(d).withColumn(
            "split_flag", ts.split_flag("demand_date", P.SPLIT_CUTOFF))
    return d.__dict__["_fact_split"]


def _lags(d):
    return ts.calendar_lags(dm.build_daily_demand(d))


def _lag_sql(expr: str, alias: str) -> str:
    return with_views(f"SELECT {KEYS}, {expr} AS {alias} FROM fact", "fact")


@query("win_02", _lag_sql(f"max(executed_rentals_count) OVER ({SER} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)",
                          "rentals_lag_1d"))
def win_02(d):
    """WIN-02: calendar lag of 1 day (NULL when that day has no row)."""
    return _lags(d).select(*dm.FACT_KEYS, "rentals_lag_1d")


@query("win_03", _lag_sql(f"max(executed_rentals_count) OVER ({SER} RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING)",
                          "rentals_lag_7d"))
def win_03(d):
    """WIN-03: calendar lag of 7 days."""
    return _lags(d).select(*dm.FACT_KEYS, "rentals_lag_7d")


@query("win_04", _lag_sql(R(f"avg(executed_rentals_count) OVER ({SER} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)", 4),
                          "rentals_rolling_7d_avg"))
def win_04(d):
    """WIN-04: trailing 7-day mean, today excluded, existing rows only."""
    return _lags(d).select(*dm.FACT_KEYS, "rentals_rolling_7d_avg")


@query("win_05", _lag_sql(R(f"avg(executed_rentals_count) OVER ({SER} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)", 4),
                          "rentals_rolling_30d_avg"))
def win_05(d):
    """WIN-05: trailing 30-day mean."""
    return _lags(d).select(*dm.FACT_KEYS, "rentals_rolling_30d_avg")


@query("fst_05", with_views(f"""
    SELECT {KEYS}, rentals_lag_1d, rentals_lag_7d, rentals_rolling_7d_avg, rentals_rolling_30d_avg
    FROM feature_store""", "feature_store"))
def fst_05(d):
    """FST-05: the four lag features in one window pass."""
    return _lags(d).select(*dm.FACT_KEYS, "rentals_lag_1d", "rentals_lag_7d",
                           "rentals_rolling_7d_avg", "rentals_rolling_30d_avg")


@query("fst_06", with_views(f"""
    SELECT {KEYS}, CASE WHEN demand_date < {CUT} THEN 'TRAIN' ELSE 'VALIDATION' END AS split_flag
    FROM fact""", "fact"))
def fst_06(d):
    """FST-06: TRAIN / VALIDATION split by cutoff date."""
    return dm.build_daily_demand(d).select(*dm.FACT_KEYS, ts.split_flag("demand_date", P.SPLIT_CUTOFF).alias("split_flag"))


@query("fst_01", with_views("SELECT * FROM feature_store", "feature_store"))
def fst_01(d):
    """FST-01: the full feature store (fact, utilization, weather, holidays,
    events, lags, split)."""
    return _fs(d)


@query("fst_02", with_views(f"""
    SELECT {KEYS}, temperature_max, temperature_min, temperature_avg, precipitation_mm, wind_speed_kmh
    FROM feature_store""", "feature_store"))
def fst_02(d):
    """FST-02: weather features joined by branch and date."""
    f = fe.enrich_weather(dm.build_daily_demand(d), d.weather)
    return f.select(*dm.FACT_KEYS, "temperature_max", "temperature_min", "temperature_avg",
                    "precipitation_mm", "wind_speed_kmh")


@query("fst_03", with_views(f"""
    SELECT {KEYS}, is_public_holiday, is_religious_holiday FROM feature_store""", "feature_store"))
def fst_03(d):
    """FST-03: holiday flags (deduplicated per date)."""
    f = fe.enrich_holidays(dm.build_daily_demand(d), d.holidays)
    return f.select(*dm.FACT_KEYS, "is_public_holiday", "is_religious_holiday")


@query("fst_04", with_views(f"""
    SELECT {KEYS}, event_score, has_major_event FROM feature_store""", "feature_store"))
def fst_04(d):
    """FST-04: event score of the branch's city; major event flag."""
    f = fe.enrich_events(dm.build_daily_demand(d), d.event_signal, d.branches)
    return f.select(*dm.FACT_KEYS, "event_score", "has_major_event")


@query("fst_08", with_views(f"""
    SELECT {KEYS}, executed_rentals_count, avg_base_price_paid FROM feature_store
    WHERE split_flag = 'VALIDATION'""", "feature_store"))
def fst_08(d):
    """FST-08: split retrieval (the VALIDATION rows)."""
    return _fact_split(d).where(F.col("split_flag") == "VALIDATION").select(
        *dm.FACT_KEYS, "executed_rentals_count", "avg_base_price_paid")


@query("agg_11", with_views(f"""
    SELECT tenant_id, count(*) AS total_rows, min(demand_date) AS min_date, max(demand_date) AS max_date,
           CAST(sum(CASE WHEN split_flag = 'TRAIN' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
           CAST(sum(CASE WHEN split_flag = 'VALIDATION' THEN 1 ELSE 0 END) AS BIGINT) AS validation_rows,
           {R('avg(CAST(executed_rentals_count AS DOUBLE))', 4)} AS target_avg,
           min(executed_rentals_count) AS target_min, max(executed_rentals_count) AS target_max,
           {R('stddev_samp(CAST(executed_rentals_count AS DOUBLE))', 4)} AS target_std,
           {R('sum(CASE WHEN temperature_avg IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*)', 2)} AS weather_pct,
           {R('sum(CASE WHEN rentals_lag_1d IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*)', 2)} AS lag_1d_pct,
           {R('sum(CASE WHEN rentals_rolling_7d_avg IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*)', 2)} AS rolling_7d_pct,
           count(DISTINCT branch_id) AS branches, count(DISTINCT category_id) AS categories
    FROM feature_store GROUP BY tenant_id""", "feature_store"))
def agg_11(d):
    """AGG-11: feature-store statistics in one pass."""
    return fe.feature_stats(_fs(d))


@query("val_01", with_views(f"""
    SELECT tenant_id, c.check_name, c.passed, c.value, c.threshold FROM (
      SELECT tenant_id, unnest([
        {{'check_name': 'minimum_rows', 'passed': n >= 1000, 'value': CAST(n AS DOUBLE), 'threshold': CAST(1000 AS DOUBLE)}},
        {{'check_name': 'target_variance', 'passed': coalesce(sd > 0.1, FALSE),
          'value': coalesce({R('sd', 4)}, CAST(0 AS DOUBLE)), 'threshold': CAST(0.1 AS DOUBLE)}},
        {{'check_name': 'split_exists', 'passed': n_train > 0 AND n_val > 0,
          'value': CAST(least(n_train, n_val) AS DOUBLE), 'threshold': CAST(1 AS DOUBLE)}},
        {{'check_name': 'missing_rate', 'passed': {R('n_price_null * 100.0 / n', 4)} < 50,
          'value': {R('n_price_null * 100.0 / n', 4)}, 'threshold': CAST(50 AS DOUBLE)}}]) AS c
      FROM (SELECT tenant_id, count(*) AS n, stddev_samp(CAST(executed_rentals_count AS DOUBLE)) AS sd,
                   sum(CASE WHEN split_flag = 'TRAIN' THEN 1 ELSE 0 END) AS n_train,
                   sum(CASE WHEN split_flag = 'VALIDATION' THEN 1 ELSE 0 END) AS n_val,
                   sum(CASE WHEN avg_base_price_paid IS NULL THEN 1 ELSE 0 END) AS n_price_null
            FROM feature_store GROUP BY tenant_id))""", "feature_store"))
def val_01(d):
    """VAL-01: the feature-store quality gate as one row per check."""
    return fe.quality_gate(_fact_split(d))


@query("fst_07", with_views(f"""
    WITH med AS (SELECT tenant_id, quantile_cont(avg_base_price_paid, 0.5) AS m FROM feature_store GROUP BY 1),
         cats AS (SELECT tenant_id, category_id,
                         CAST(dense_rank() OVER (PARTITION BY tenant_id ORDER BY category_id) - 1 AS INTEGER) AS code
                  FROM (SELECT DISTINCT tenant_id, category_id FROM feature_store)),
         branch AS (SELECT branch_id, CAST(dense_rank() OVER (ORDER BY branch_id) - 1 AS INTEGER) AS code
                    FROM (SELECT DISTINCT branch_id FROM feature_store))
    SELECT f.tenant_id, f.branch_id, f.category_id, f.demand_date, split_flag,
           CAST(executed_rentals_count AS DOUBLE) AS target, branch.code AS branch_code, cats.code AS category_code,
           day_of_week, day_of_month, week_of_year, month_of_year, quarter,
           CAST(is_weekend AS INTEGER) AS is_weekend, CAST(is_public_holiday AS INTEGER) AS is_public_holiday,
           CAST(is_religious_holiday AS INTEGER) AS is_religious_holiday,
           CAST(has_major_event AS INTEGER) AS has_major_event,
           coalesce(CAST(rentals_lag_1d AS DOUBLE), 0.0) AS lag_1d,
           coalesce(CAST(rentals_lag_7d AS DOUBLE), 0.0) AS lag_7d,
           coalesce(rentals_rolling_7d_avg, 0.0) AS rolling_7d,
           coalesce(rentals_rolling_30d_avg, 0.0) AS rolling_30d,
           coalesce(temperature_avg, 30.0) AS temperature_avg,
           coalesce(precipitation_mm, 0.0) AS precipitation_mm,
           coalesce(event_score, 0.0) AS event_score,
           {R('coalesce(avg_base_price_paid, med.m)', 4)} AS price
    FROM feature_store f JOIN med ON f.tenant_id = med.tenant_id
    JOIN cats ON cats.tenant_id = f.tenant_id AND cats.category_id = f.category_id
    JOIN branch ON branch.branch_id = f.branch_id""", "feature_store"))
def fst_07(d):
    """FST-07: model matrix (codes of the fitted indexers, 0/1 flags, NULL fills, median price)."""
    return bo.model_matrix(io.materialize(_fs(d), "feature_store"))
