"""Queries for holidays, events, calendar features and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd_sql as R
from ratewise.operators import calendar as cal
from ratewise.operators import weather as wx
from ratewise.plans import params as P
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sources.fixed import HOLIDAY_TYPE_PRIORITY

N = P.HOLIDAY_WINDOW_DAYS
AS_OF = f"DATE '{P.SPLIT_CUTOFF}'"

register_view("day_spine", """
    SELECT tenant_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS cal_date
    FROM (SELECT tenant_id, min(start_date) AS lo, max(start_date) AS hi FROM contracts GROUP BY tenant_id)""",
              ("contracts",))
register_view("city_spine", """
    SELECT s.tenant_id, s.cal_date, c.city_name FROM day_spine s
    JOIN (SELECT DISTINCT tenant_id, city_name FROM branches) c ON c.tenant_id = s.tenant_id""",
              ("day_spine", "branches"))
register_view("holiday_by_date", """
    SELECT tenant_id, holiday_date, min(holiday_name) AS holiday_name,
           arg_min(holiday_type, holiday_name) AS holiday_type, bool_or(is_public_holiday) AS is_public_holiday
    FROM holidays GROUP BY 1, 2""", ("holidays",))


def _holiday_window_sql(n):
    fwd = f"RANGE BETWEEN CURRENT ROW AND {n} FOLLOWING" if n is not None else \
        "RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    back = f"RANGE BETWEEN {n} PRECEDING AND CURRENT ROW" if n is not None else \
        "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    o = "PARTITION BY tenant_id ORDER BY dn"
    extra = (f", CAST(coalesce(sum(_h) OVER ({o} RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING), 0) AS INTEGER)"
             f" AS holidays_in_window") if n is not None else ""
    return f"""
    SELECT tenant_id, cal_date, coalesce(_h = 1, FALSE) AS is_holiday,
           CAST(coalesce(min(CASE WHEN _h = 1 THEN dn END) OVER ({o} {fwd}) - dn, -1) AS INTEGER) AS days_to_next_holiday,
           CAST(coalesce(dn - max(CASE WHEN _h = 1 THEN dn END) OVER ({o} {back}), -1) AS INTEGER) AS days_since_last_holiday,
           (min(CASE WHEN _h = 1 THEN {{'d': dn, 'name': _hn}} END) OVER ({o} {fwd})).name AS next_holiday_name
           {extra}
    FROM (SELECT s.tenant_id, s.cal_date, CAST(s.cal_date - DATE '1970-01-01' AS INTEGER) AS dn,
                 CASE WHEN h.holiday_date IS NOT NULL THEN 1 END AS _h, h.holiday_name AS _hn
          FROM day_spine s LEFT JOIN holiday_by_date h
            ON h.tenant_id = s.tenant_id AND h.holiday_date = s.cal_date)"""


register_view("holiday_window", _holiday_window_sql(N), ("day_spine", "holiday_by_date"))


@query("src_06", with_views("SELECT * FROM holidays", "holidays"))
def src_06(d):
    """SRC-06: fixed-date national days for every contract year."""
    return d.holidays


@query("sig_e", with_views("SELECT * FROM event_signal", "event_signal"))
def sig_e(d):
    """SIG-E / STM-05 batch: event volume and ln(1+volume) score per city-day."""
    return d.event_signal


@query("win_08", with_views("SELECT * FROM holiday_window", "holiday_window"))
def win_08(d):
    """WIN-08 / CAL-03: holiday proximity within +/-7 days on a daily spine."""
    return cal.holiday_window(d.day_spine, d.holidays, N)


@query("jn_08", with_views(_holiday_window_sql(None), "day_spine", "holiday_by_date"))
def jn_08(d):
    """JN-08: as-of nearest joins (next holiday >= d, last <= d), unbounded."""
    return cal.holiday_window(d.day_spine, d.holidays, None)


CAL_SQL = f"""
    SELECT s.tenant_id, s.city_name, s.cal_date,
           CASE WHEN h.holiday_name IS NOT NULL THEN 1 ELSE 0 END AS is_holiday, h.holiday_name, h.holiday_type,
           CAST(dayofweek(s.cal_date) IN (5, 6) AS INTEGER) AS is_weekend,
           coalesce(e.event_volume, 0) AS event_volume_today, coalesce(e.event_score, 0.0) AS event_score_today,
           coalesce({R("avg(e.event_score) OVER (PARTITION BY s.tenant_id, s.city_name ORDER BY (s.cal_date - DATE '1970-01-01') RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", 4)}, 0.0) AS event_score_3d_avg,
           coalesce({R("avg(e.event_score) OVER (PARTITION BY s.tenant_id, s.city_name ORDER BY (s.cal_date - DATE '1970-01-01') RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)", 4)}, 0.0) AS event_score_7d_avg
    FROM city_spine s
    LEFT JOIN holiday_by_date h ON h.tenant_id = s.tenant_id AND h.holiday_date = s.cal_date
    LEFT JOIN event_signal e ON e.tenant_id = s.tenant_id AND e.city_name = s.city_name AND e.event_date = s.cal_date"""
register_view("calendar_features", CAL_SQL, ("city_spine", "holiday_by_date", "event_signal"))


def _cal(d):
    if "_cal" not in d.__dict__:
        d.__dict__["_cal"] = cal.calendar_features(d.city_spine, d.holidays, d.event_signal)
    return d.__dict__["_cal"]


@query("cal_01", with_views("SELECT * FROM calendar_features", "calendar_features"))
def cal_01(d):
    """CAL-01 / CAL-02: calendar and event features per city and day."""
    return _cal(d)


@query("win_06", with_views("SELECT city_name, cal_date, event_score_3d_avg FROM calendar_features",
                            "calendar_features"))
def win_06(d):
    """WIN-06: 3-day event score mean including today (0 when none)."""
    return _cal(d).select("city_name", "cal_date", "event_score_3d_avg")


@query("win_07", with_views("SELECT city_name, cal_date, event_score_7d_avg FROM calendar_features",
                            "calendar_features"))
def win_07(d):
    """WIN-07: 7-day event score mean including today."""
    return _cal(d).select("city_name", "cal_date", "event_score_7d_avg")


@query("src_04", with_views("""
    SELECT tenant_id, holiday_date, holiday_name, holiday_name_ar,
           CASE WHEN contains(lower(holiday_type), 'national holiday') THEN 'National holiday'
                WHEN contains(lower(holiday_type), 'religious') THEN 'Religious'
                WHEN contains(lower(holiday_type), 'muslim') THEN 'Muslim'
                WHEN contains(lower(holiday_type), 'observance') THEN 'Observance'
                ELSE coalesce(holiday_type, 'Unknown') END AS holiday_type,
           contains(holiday_type, 'National holiday') AS is_public_holiday
    FROM holidays""", "holidays"))
def src_04(d):
    """SRC-04 + CAL-04: holiday feed payload -> rows with priority type."""
    return cal.normalise_holiday_payload(cal.holiday_payload(d.holidays), HOLIDAY_TYPE_PRIORITY)


@query("agg_13", with_views("""
    SELECT tenant_id, count(*) AS holidays, min(holiday_date) AS min_date, max(holiday_date) AS max_date,
           count(DISTINCT year(holiday_date)) AS years FROM holidays GROUP BY tenant_id""", "holidays"))
def agg_13(d):
    """AGG-13: holiday summary."""
    return cal.holiday_summary(d.holidays)


@query("agg_14", with_views("""
    SELECT tenant_id, count(*) AS event_rows, min(event_date) AS min_date, max(event_date) AS max_date,
           count(DISTINCT city_name) AS cities FROM event_signal GROUP BY tenant_id""", "event_signal"))
def agg_14(d):
    """AGG-14: event summary."""
    return cal.event_summary(d.event_signal)


# ---- weather ------------------------------------------------------------------

def _score_sql():
    rain = ("CASE WHEN precipitation_sum > 20 THEN 0.4 WHEN precipitation_sum > 10 THEN 0.3 "
            "WHEN precipitation_sum > 5 THEN 0.2 WHEN precipitation_sum > 0 THEN 0.1 ELSE 0.0 END")
    wind = "CASE WHEN wind_max > 50 THEN 0.3 WHEN wind_max > 30 THEN 0.2 WHEN wind_max > 20 THEN 0.1 ELSE 0.0 END"
    code = ("CASE WHEN weather_code >= 95 THEN 0.3 WHEN weather_code >= 61 THEN 0.2 "
            "WHEN weather_code >= 45 THEN 0.1 ELSE 0.0 END")
    return R(f"least(CAST({rain} AS DOUBLE) + CAST({wind} AS DOUBLE) + CAST({code} AS DOUBLE), 1.0)", 2)


register_view("weather_scored", f"""
    SELECT *, {_score_sql()} AS bad_weather_score,
           CASE WHEN t_max > 43.0 THEN 1 ELSE 0 END AS extreme_heat_flag,
           weather_date >= {AS_OF} AS is_forecast
    FROM weather""", ("weather",))


def _wx(d):
    if "_wx" not in d.__dict__:
        d.__dict__["_wx"] = wx.score_weather(d.weather, P.SPLIT_CUTOFF)
    return d.__dict__["_wx"]


@query("sig_w1", with_views("SELECT branch_id, weather_date, bad_weather_score FROM weather_scored",
                            "weather_scored"))
def sig_w1(d):
    """SIG-W1: bad-weather score from rain, wind and weather code (cap 1)."""
    return _wx(d).select("branch_id", "weather_date", "bad_weather_score")


@query("sig_w2", with_views("SELECT branch_id, weather_date, extreme_heat_flag FROM weather_scored",
                            "weather_scored"))
def sig_w2(d):
    """SIG-W2: extreme heat flag (t_max > 43)."""
    return _wx(d).select("branch_id", "weather_date", "extreme_heat_flag")


WTH_FROM, WTH_TO = "DATE '2000-01-01'", "DATE '2000-12-31'"


@query("wth_01", with_views(f"""
    SELECT tenant_id, branch_id, weather_date, coalesce(t_max, 0.0) AS t_max, coalesce(t_min, 0.0) AS t_min,
           coalesce(t_mean, 0.0) AS t_mean, coalesce(precipitation_sum, 0.0) AS precipitation_sum,
           coalesce(wind_max, 0.0) AS wind_max, coalesce(weather_code, 0) AS weather_code
    FROM weather WHERE weather_date BETWEEN {WTH_FROM} AND {WTH_TO}""", "weather"))
def wth_01(d):
    """WTH-01: weather of all branches over a date range, NULL -> 0."""
    import datetime as dt
    return wx.weather_range(d.weather, dt.date(2000, 1, 1), dt.date(2000, 12, 31))


@query("wth_02", with_views("""
    SELECT branch_id, start_date, end_date, CAST(i AS INTEGER) AS chunk_no,
           CAST(start_date + INTERVAL (i * 100) DAY AS DATE) AS chunk_start,
           least(CAST(start_date + INTERVAL (i * 100 + 99) DAY AS DATE), end_date) AS chunk_end
    FROM (SELECT branch_id, min(weather_date) AS start_date, max(weather_date) AS end_date
          FROM weather GROUP BY branch_id) r,
         range(0, CAST(ceil(((end_date - start_date) + 1) / 100.0) AS BIGINT)) t(i)""", "weather"))
def wth_02(d):
    """WTH-02: each branch's weather range split into <= 100-day chunks."""
    r = d.weather.groupBy("branch_id").agg(F.min("weather_date").alias("start_date"),
                                           F.max("weather_date").alias("end_date"))
    return wx.chunk_ranges(r, 100)


@query("wth_03", with_views("""
    SELECT branch_id, branch_name, city_id, city_name, CAST(city_id * 10 AS DOUBLE) AS latitude,
           CAST(city_id * 20 AS DOUBLE) AS longitude FROM branches
    WHERE is_active AND branch_id IN (SELECT branch_id FROM contracts)""", "branches", "contracts"))
def wth_03(d):
    """WTH-03: locations, with coordinates, of the active branches that have contracts."""
    act = d.contracts.select("branch_id").distinct()
    return d.branches.where("is_active").join(act, "branch_id", "left_semi").select(
        "branch_id", "branch_name", "city_id", "city_name", (F.col("city_id") * 10).cast("double").alias("latitude"),
        (F.col("city_id") * 20).cast("double").alias("longitude"))


@query("agg_12", with_views("""
    SELECT tenant_id, count(*) AS total_rows, count(DISTINCT branch_id) AS branches,
           min(weather_date) AS min_date, max(weather_date) AS max_date,
           CAST(sum(CASE WHEN is_forecast THEN 1 ELSE 0 END) AS BIGINT) AS forecast_rows,
           CAST(sum(CASE WHEN NOT is_forecast THEN 1 ELSE 0 END) AS BIGINT) AS historical_rows
    FROM weather_scored GROUP BY tenant_id""", "weather_scored"))
def agg_12(d):
    """AGG-12: weather summary (forecast vs historical)."""
    return wx.weather_summary(_wx(d))


@query("src_02", with_views("""
    SELECT tenant_id, branch_id, weather_date, t_max, t_min, t_mean, precipitation_sum, wind_max, weather_code,
           bad_weather_score, extreme_heat_flag, is_forecast FROM weather_scored""", "weather_scored"))
def src_02(d):
    """SRC-02: provider payload (parallel daily arrays) -> rows, scored."""
    return wx.normalise_payload(wx.weather_payload(d.weather), P.SPLIT_CUTOFF)
