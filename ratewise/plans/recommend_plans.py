"""Queries for signals, the recommendation run (flagship) and workflow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ratewise.functions.mathx import money_sql as M, rnd, rnd_sql as R
from ratewise.operators import calendar as cal
from ratewise.operators import competitor as cpo
from ratewise.operators import demand as dm
from ratewise.operators import forecast as fc
from ratewise.operators import quarantine
from ratewise.operators import recommend as rc
from ratewise.operators import utilization as ut
from ratewise.operators import weather as wx
from ratewise.plans import calendar_plans, competitor_plans, feature_plans, forecast_plans  # noqa: F401
from ratewise.plans import params as P
from ratewise.plans.competitor_plans import base_rates, fact, window_quotes
from ratewise.plans.feature_plans import _fact_split
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sinks.io import materialize, new_table
from ratewise.sources.fixed import CATEGORIES, DEFAULT_COMPETITOR_TYPE, GENERIC_GUARDRAIL, SIGNAL_WEIGHTS, fixed_table_sql

RUN = f"DATE '{P.RUN_DATE}'"
H = P.HORIZON
W = dict(SIGNAL_WEIGHTS)
NAMES = rc.SIGNALS

# ---- SQL views ----------------------------------------------------------------
register_view("cells", """
    SELECT b.tenant_id, b.branch_id, c.category_id FROM branches b CROSS JOIN categories c""",
              ("branches", "categories"))
register_view("spine", f"""
    SELECT c.*, CAST(unnest(generate_series({RUN}, {RUN} + {H - 1}, INTERVAL 1 DAY)) AS DATE) AS forecast_date
    FROM cells c""", ("cells",))
register_view("weights_cfg", """
    SELECT t.tenant_id, signal_name, weight, TRUE AS is_enabled
    FROM (SELECT DISTINCT tenant_id FROM contracts) t CROSS JOIN signal_weights_default""",
              ("signal_weights_default", "contracts"))
register_view("weights", f"""
    SELECT tenant_id, {", ".join(
        f"coalesce(max(CASE WHEN nm = '{n}' THEN w END), CAST({W[n]!r} AS DOUBLE)) AS w_{n}" for n in NAMES)}
    FROM (SELECT tenant_id, CASE WHEN signal_name = 'demand_forecast' THEN 'forecast' ELSE signal_name END AS nm,
                 CASE WHEN is_enabled THEN weight ELSE 0.0 END AS w FROM weights_cfg)
    GROUP BY tenant_id""", ("weights_cfg",))
register_view("guardrail_config", fixed_table_sql("guardrail_config"))
register_view("guardrails", f"""
    SELECT c.tenant_id, c.branch_id, c.category_id, g.max_price AS guardrail_max_price,
           CASE WHEN g.rn = 1 THEN coalesce(nullif(g.min_price, 0), {GENERIC_GUARDRAIL[0]}) ELSE d.guardrail_min_price END AS guardrail_min_price,
           CASE WHEN g.rn = 1 THEN coalesce(nullif(g.max_discount_pct, 0), {GENERIC_GUARDRAIL[1]}) ELSE d.guardrail_max_discount_pct END AS guardrail_max_discount_pct,
           CASE WHEN g.rn = 1 THEN coalesce(nullif(g.max_premium_pct, 0), {GENERIC_GUARDRAIL[2]}) ELSE d.guardrail_max_premium_pct END AS guardrail_max_premium_pct
    FROM cells c JOIN guardrails_default d USING (tenant_id, branch_id, category_id)
    LEFT JOIN (SELECT f.branch_id, f.category_id, g.*, row_number() OVER (
                 PARTITION BY f.branch_id, f.category_id
                 ORDER BY 2 * CAST(g.of_branch IS NOT NULL AS INTEGER) + CAST(g.of_category IS NOT NULL AS INTEGER) DESC) AS rn
               FROM cells f JOIN (SELECT guardrail_id, category_id AS of_category, branch_id AS of_branch, * EXCLUDE (
                                    guardrail_id, category_id, branch_id) FROM guardrail_config) g
                 ON coalesce(g.of_category = f.category_id, TRUE) AND coalesce(g.of_branch = f.branch_id, TRUE)) g
      ON g.branch_id = c.branch_id AND g.category_id = c.category_id AND g.rn = 1""",
              ("cells", "guardrails_default", "guardrail_config"))
register_view("guardrails_default", f"""
    SELECT c.tenant_id, c.branch_id, c.category_id,
           coalesce(k.default_min_price, {GENERIC_GUARDRAIL[0]}) AS guardrail_min_price,
           coalesce(k.default_max_discount_pct, {GENERIC_GUARDRAIL[1]}) AS guardrail_max_discount_pct,
           coalesce(k.default_max_premium_pct, {GENERIC_GUARDRAIL[2]}) AS guardrail_max_premium_pct
    FROM cells c LEFT JOIN categories k ON k.category_id = c.category_id""", ("cells", "categories"))
register_view("mean_train", """
    SELECT tenant_id, branch_id, category_id, avg(CAST(executed_rentals_count AS DOUBLE)) AS mean_train_demand
    FROM feature_store WHERE split_flag = 'TRAIN' GROUP BY 1, 2, 3""", ("feature_store",))
register_view("latest_fc", """
    SELECT tenant_id, branch_id, category_id, forecast_date, arg_max(forecast_demand, run_date) AS forecast_demand
    FROM forecast_runs GROUP BY 1, 2, 3, 4""", ("forecast_runs",))
register_view("holiday_cal", """
    SELECT tenant_id, cal_date AS forecast_date, is_holiday,
           CASE WHEN days_to_next_holiday >= 0 THEN days_to_next_holiday END AS days_to_holiday,
           FALSE AS is_school_holiday, dayofweek(cal_date) IN (5, 6) AS is_weekend
    FROM holiday_window""", ("holiday_window",))

_SIG_SQL = """
    CASE WHEN utilization_contracts IS NULL THEN 0.5
         WHEN uu >= 0.9 THEN 1.0 WHEN uu >= 0.7 THEN 0.5 + (uu - 0.7) * 2.5
         WHEN uu >= 0.5 THEN 0.3 + (uu - 0.5) ELSE uu * 0.6 END AS utilization_signal,
    CASE WHEN forecast_demand IS NULL OR mean_train_demand IS NULL OR mean_train_demand = 0 THEN 0.5
         WHEN forecast_demand / mean_train_demand >= 1.5 THEN 1.0
         WHEN forecast_demand / mean_train_demand >= 1.0 THEN 0.5 + (forecast_demand / mean_train_demand - 1.0)
         WHEN forecast_demand / mean_train_demand >= 0.5 THEN forecast_demand / mean_train_demand - 0.5
         ELSE 0.0 END AS forecast_signal,
    CASE WHEN competitor_avg_price IS NULL OR competitor_avg_price = 0 THEN 0.5
         WHEN base_daily / competitor_avg_price < 0.8 THEN least(1.0, 0.7 + (0.8 - base_daily / competitor_avg_price) * 1.5)
         WHEN base_daily / competitor_avg_price <= 1.2 THEN 0.4 + (1.2 - base_daily / competitor_avg_price) * 0.5
         ELSE greatest(0.0, 0.3 - (base_daily / competitor_avg_price - 1.2) * 0.5) END AS competitor_signal,
    CASE WHEN NOT coalesce(_wx, FALSE) THEN 0.5
         WHEN coalesce(bad_weather_score, 0.0) >= 0.7 OR coalesce(extreme_heat_flag, 0) = 1 THEN 0.3
         WHEN coalesce(bad_weather_score, 0.0) >= 0.4 OR coalesce(precipitation_sum, 0.0) > 10 THEN 0.4
         WHEN coalesce(bad_weather_score, 0.0) <= 0.1 THEN 0.6 ELSE 0.5 END AS weather_signal,
    CASE WHEN _cal IS NULL THEN (CASE WHEN dayofweek(forecast_date) IN (5, 6) THEN 0.7 ELSE 0.5 END)
         WHEN coalesce(is_holiday, FALSE) THEN 0.9
         WHEN days_to_holiday IS NOT NULL AND days_to_holiday >= 1 AND days_to_holiday <= 3 THEN 0.75
         WHEN coalesce(is_school_holiday, FALSE) THEN 0.7
         WHEN coalesce(is_weekend, FALSE) THEN 0.6 ELSE 0.5 END AS holiday_signal"""

_WSUM = " + ".join(f"{n}_signal * w_{n}" for n in NAMES)
_RAW = R(f"CASE WHEN ({_WSUM}) >= 0.5 THEN (({_WSUM}) - 0.5) * 80.0 ELSE (({_WSUM}) - 0.5) * 60.0 END", 4)
_CAP = ("CASE WHEN raw_adjustment_pct > guardrail_max_premium_pct THEN guardrail_max_premium_pct "
        "WHEN raw_adjustment_pct < -guardrail_max_discount_pct THEN -guardrail_max_discount_pct "
        "ELSE raw_adjustment_pct END")
_P0 = f"(base_daily * (1 + ({_CAP}) / 100.0))"
_BELOW = f"({_P0} < guardrail_min_price)"
_ABOVE = f"coalesce({_P0} > guardrail_max_price, FALSE)"
_BOUND = f"(CASE WHEN {_BELOW} THEN guardrail_min_price WHEN {_ABOVE} THEN guardrail_max_price END)"


def _factor_sql():
    parts = [
        "CASE WHEN utilization_signal >= 0.7 THEN 'High utilization (+)' "
        "WHEN utilization_signal <= 0.3 THEN 'Low utilization (-)' END",
        "CASE WHEN forecast_signal >= 0.7 THEN 'High forecast demand (+)' "
        "WHEN forecast_signal <= 0.3 THEN 'Low forecast demand (-)' END",
        "CASE WHEN competitor_signal >= 0.7 THEN 'Competitors priced higher (+)' "
        "WHEN competitor_signal <= 0.3 THEN 'Competitors priced lower (-)' END",
        "CASE WHEN weather_signal <= 0.3 THEN 'Bad weather expected (-)' "
        "WHEN weather_signal >= 0.7 THEN 'Good weather expected (+)' END",
        "CASE WHEN holiday_signal >= 0.7 THEN 'Holiday/weekend period (+)' END",
    ]
    f = "concat_ws('. ', " + ", ".join(parts) + ")"
    text = f"CASE WHEN {f} = '' THEN 'Normal conditions' ELSE {f} END"
    suffix = (f"printf('. Adjusted within guardrails (raw: %.1f%% -> final: %.1f%%)', "
              f"{R('raw_adjustment_pct', 1)}, {R('premium_discount_pct', 1)})")
    return f"CASE WHEN guardrail_applied THEN {text} || {suffix} ELSE {text} END"


register_view("recommendations", f"""
    WITH j AS (
      SELECT s.tenant_id, s.branch_id, s.category_id, s.forecast_date,
             CAST(s.forecast_date - {RUN} + 1 AS INTEGER) AS horizon_day,
             b.base_daily, b.base_weekly, b.base_monthly,
             g.guardrail_min_price, g.guardrail_max_discount_pct, g.guardrail_max_premium_pct, g.guardrail_max_price,
             {", ".join("w.w_" + n for n in NAMES)},
             u.utilization_contracts, u.utilization_contracts + coalesce(u.utilization_bookings, 0.0) AS uu,
             f.forecast_demand, m.mean_train_demand, ci.competitor_avg_price,
             ws.bad_weather_score, ws.extreme_heat_flag, ws.precipitation_sum, ws._wx,
             hc.is_holiday, hc.days_to_holiday, hc.is_school_holiday, hc.is_weekend, hc._cal
      FROM spine s
      LEFT JOIN base_rates b ON b.tenant_id = s.tenant_id AND b.branch_id = s.branch_id AND b.category_id = s.category_id
      LEFT JOIN guardrails g ON g.tenant_id = s.tenant_id AND g.branch_id = s.branch_id AND g.category_id = s.category_id
      LEFT JOIN weights w ON w.tenant_id = s.tenant_id
      LEFT JOIN (SELECT tenant_id, branch_id, category_id, demand_date, utilization_contracts, utilization_bookings
                 FROM feature_store) u
        ON u.tenant_id = s.tenant_id AND u.branch_id = s.branch_id AND u.category_id = s.category_id
       AND u.demand_date = s.forecast_date
      LEFT JOIN latest_fc f ON f.tenant_id = s.tenant_id AND f.branch_id = s.branch_id
       AND f.category_id = s.category_id AND f.forecast_date = s.forecast_date
      LEFT JOIN mean_train m ON m.tenant_id = s.tenant_id AND m.branch_id = s.branch_id AND m.category_id = s.category_id
      LEFT JOIN comp_index ci ON ci.tenant_id = s.tenant_id AND ci.branch_id = s.branch_id
       AND ci.category_id = s.category_id AND ci.index_date = s.forecast_date
      LEFT JOIN (SELECT *, TRUE AS _wx FROM weather_scored) ws ON ws.tenant_id = s.tenant_id
       AND ws.branch_id = s.branch_id AND ws.weather_date = s.forecast_date
      LEFT JOIN (SELECT *, TRUE AS _cal FROM holiday_cal) hc ON hc.tenant_id = s.tenant_id
       AND hc.forecast_date = s.forecast_date),
    sg AS (SELECT *, {_SIG_SQL} FROM j),
    ad AS (SELECT *, {_RAW} AS raw_adjustment_pct FROM sg),
    cl AS (SELECT *, {M(f'coalesce({_BOUND}, {_P0})')} AS rec_daily,
                  {M(f'CASE WHEN {_BOUND} IS NOT NULL THEN ({_BOUND} / base_daily - 1) * 100.0 ELSE {_CAP} END', 4)}
                    AS premium_discount_pct,
                  (raw_adjustment_pct > guardrail_max_premium_pct OR raw_adjustment_pct < -guardrail_max_discount_pct
                   OR {_BELOW} OR {_ABOVE}) AS guardrail_applied
           FROM ad)
    SELECT tenant_id, branch_id, category_id, {RUN} AS run_date, forecast_date, horizon_day,
           {M('base_daily')} AS base_daily, {M('base_weekly')} AS base_weekly,
           {M('base_monthly')} AS base_monthly, rec_daily,
           {M('base_weekly * (1 + premium_discount_pct / 100.0)')} AS rec_weekly,
           {M('base_monthly * (1 + premium_discount_pct / 100.0)')} AS rec_monthly,
           premium_discount_pct, {", ".join(R(n + '_signal', 4) + ' AS ' + n + '_signal' for n in NAMES)},
           raw_adjustment_pct, guardrail_applied, guardrail_min_price, guardrail_max_discount_pct,
           guardrail_max_premium_pct, guardrail_max_price, {_factor_sql()} AS explanation_text,
           'pricing_engine_v1' AS model_name, '1.0.0' AS model_version, 'pending' AS status
    FROM cl""", ("spine", "base_rates", "guardrails", "weights", "feature_store", "latest_fc", "mean_train",
                 "comp_index", "weather_scored", "holiday_cal"))


# ---- Spark side -----------------------------------------------------------------

def _cells(d):
    return rc.cell_grid(d.branches, [c[0] for c in CATEGORIES])


def _weights(d, tenants=None):
    """Weight configuration of every tenant that has contracts."""
    if tenants is None:
        tenants = d.contracts.select("tenant_id").distinct()
    cfg = tenants.select("tenant_id", F.explode(F.array(*[
            F.struct(F.lit(n).alias("signal_name"), F.lit(w).alias("weight")) for n, w in SIGNAL_WEIGHTS]))
            .alias("w")).select("tenant_id", "w.signal_name", "w.weight", F.lit(True).alias("is_enabled"))
    return rc.signal_weights(cfg, W)


def guardrail_config(d):
    """The guardrail configuration rows, all active, of the tenant."""
    return d.fixed("guardrail_config").withColumn("tenant_id", F.lit(d.tenant_id)).withColumn("is_active", F.lit(True))


def _calendar(d):
    return rc.holiday_calendar(cal.holiday_window(d.day_spine, d.holidays, P.HOLIDAY_WINDOW_DAYS))


def _mean_train(d):
    return _fact_split(d).where(F.col("split_flag") == "TRAIN").groupBy(*rc.CELL).agg(
        F.avg(F.col("executed_rentals_count").cast("double")).alias("mean_train_demand"))


def run_inputs(d, run_date=P.RUN_DATE, forecasts=None):
    """What builds each input of a run (``rc.INPUT_KEYS``), by name.  Only the
    window is read for utilization and competitor quotes: the date bounds
    reach the parquet scans."""
    end = run_date + dt.timedelta(days=H - 1)

    def util():
        rentals = dm.with_category(dm.executed_rentals(d.contracts, tenant_id=d.tenant_id), d.vehicles)
        on_rent = ut.on_rent_daily(rentals.where((F.col("start_date") <= F.lit(end))
                                                 & (F.col("end_date") >= F.lit(run_date))), run_date, end)
        return (fact(d).where(F.col("demand_date").between(F.lit(run_date), F.lit(end)))
                .select(*rc.CELL, F.col("demand_date").alias("day"))
                .join(on_rent, rc.CELL + ["day"]).join(ut.fleet_size(d.vehicles), rc.CELL)
                .select(*rc.CELL, F.col("day").alias("forecast_date"),
                        rnd(F.col("vehicles_on_rent") / F.col("fleet_size"), 4).alias("utilization_contracts"),
                        F.lit(None).cast("double").alias("utilization_bookings")))

    def forecast():
        runs = forecast_plans.forecast_runs(d) if forecasts is None else forecasts
        return fc.latest_forecast(runs).select(*rc.CELL, "forecast_date", "forecast_demand")

    def comp():
        index = cpo.competitor_index(window_quotes(d, run_date, end), d.fixed("competitor_mapping"), base_rates(d), DEFAULT_COMPETITOR_TYPE)
        return index.select(*rc.CELL, F.col("index_date").alias("forecast_date"), "competitor_avg_price")

    def weather():
        return wx.score_weather(d.weather, P.SPLIT_CUTOFF).where(F.col("weather_date").between(F.lit(run_date), F.lit(end))).select(
            "tenant_id", "branch_id", F.col("weather_date").alias("forecast_date"), "bad_weather_score", "extreme_heat_flag", "precipitation_sum")

    return {"base": lambda: base_rates(d).drop("base_source"),
            "guard": lambda: rc.resolve_guardrails(_cells(d), guardrail_config(d), d.categories, GENERIC_GUARDRAIL),
            "weights": lambda: _weights(d, fact(d).select("tenant_id").distinct()), "util": util, "forecast": forecast,
            "mean_demand": lambda: _mean_train(d), "comp": comp, "weather": weather, "calendar": lambda: _calendar(d)}


def share_fact(d):
    """The fact with its split, written once for the branches of this query."""
    d.__dict__["_fs"] = d.__dict__["_fact"] = materialize(_fact_split(d), "fact")


def share_base_rates(d):
    d.__dict__["_base"] = materialize(base_rates(d), "base_rates")


def recommendations(d, run_date=P.RUN_DATE, forecasts=None):
    """PRC-05 over every branch x category for the run window.

    Inputs are computed once each and, where several signal branches read
    them, materialized (fact with split, base rates, forecasts)."""
    key = ("_recs", run_date)
    if key not in d.__dict__:
        share_fact(d)
        share_base_rates(d)
        if forecasts is None:
            forecasts = materialize(forecast_plans.forecast_runs(d), "forecast_runs")
        inputs = {name: build() for name, build in run_inputs(d, run_date, forecasts).items()}
        d.__dict__[key] = rc.generate(rc.horizon_spine(_cells(d), run_date, H), inputs, run_date)
    return d.__dict__[key]


@query("prc_05", with_views("SELECT * FROM recommendations", "recommendations"))
def prc_05(d):
    """PRC-05 (flagship): 30-day recommendations for every branch x category."""
    return recommendations(d)


#: Tables that more than one input of the signal reads.
SHARED = {"forecast": share_fact, "competitor": share_base_rates}


def _sig_query(name):
    @query(f"sig_{name[0]}", with_views(f"""
        SELECT branch_id, category_id, forecast_date, {name}_signal FROM recommendations""", "recommendations"))
    def q(d):
        if name in SHARED:
            SHARED[name](d)
        build = run_inputs(d)
        inputs = {i: build[i]() for i in rc.SIGNAL_INPUTS[name]}
        return rc.signal_of_days(rc.horizon_spine(_cells(d), P.RUN_DATE, H), name, inputs).drop("tenant_id")
    q.__doc__ = f"SIG-{name[0].upper()}: the {name} signal of every cell-day, from that signal's inputs alone."
    return q


for _n in ("utilization", "forecast", "competitor", "weather", "holiday"):
    _sig_query(_n)


@query("sig_a", with_views("""
    SELECT branch_id, category_id, forecast_date, raw_adjustment_pct FROM recommendations""", "recommendations"))
def sig_a(d):
    """SIG-A: weighted signal sum -> raw adjustment percent."""
    return recommendations(d).select("branch_id", "category_id", "forecast_date", "raw_adjustment_pct")


@query("prc_01", with_views("""
    SELECT branch_id, category_id, forecast_date, base_daily, raw_adjustment_pct, rec_daily,
           premium_discount_pct, guardrail_applied FROM recommendations""", "recommendations"))
def prc_01(d):
    """PRC-01: guardrail clamp of every cell-day."""
    return recommendations(d).select("branch_id", "category_id", "forecast_date", "base_daily",
                                     "raw_adjustment_pct", "rec_daily", "premium_discount_pct", "guardrail_applied")


@query("prc_06", with_views("""
    SELECT branch_id, category_id, forecast_date, explanation_text FROM recommendations""", "recommendations"))
def prc_06(d):
    """PRC-06: explanation text."""
    return recommendations(d).select("branch_id", "category_id", "forecast_date", "explanation_text")


@query("prc_02", with_views("""
    SELECT g.* FROM guardrails_default g
    WHERE (g.tenant_id, g.branch_id, g.category_id) IN (SELECT tenant_id, branch_id, category_id FROM fleet_size)""",
                            "guardrails_default", "fleet_size"))
def prc_02(d):
    """PRC-02: guardrails of every cell that has a fleet where no
    configuration row exists (category default, generic)."""
    cells = ut.fleet_size(d.vehicles).select(*rc.CELL)
    return rc.resolve_guardrails(cells, None, d.categories, GENERIC_GUARDRAIL)


@query("prc_03", with_views("SELECT * FROM base_rates", "base_rates"))
def prc_03(d):
    """PRC-03: base rates per cell (config -> history -> category -> 150)."""
    return base_rates(d)


@query("prc_04", with_views("""
    SELECT tenant_id, branch_id, category_id, forecast_date,
           CAST(forecast_date - DATE '{run}' + 1 AS INTEGER) AS horizon_day FROM spine""".format(run=P.RUN_DATE),
                            "spine"))
def prc_04(d):
    """PRC-04: horizon spine (start + 0..29) x branch x category."""
    return rc.horizon_spine(_cells(d), P.RUN_DATE, H)


@query("agg_24", with_views("SELECT * FROM mean_train", "mean_train"))
def agg_24(d):
    """AGG-24: mean TRAIN demand per series (true mean, not truncated)."""
    return _mean_train(d)


@query("prc_07", with_views("""
    SELECT tenant_id, run_date, count(DISTINCT branch_id) AS branches_processed,
           count(DISTINCT category_id) AS categories_processed,
           count(DISTINCT (branch_id, category_id)) AS cells, count(*) AS recommendations_generated,
           CAST(sum(CAST(guardrail_applied AS INTEGER)) AS BIGINT) AS guardrail_applied_count
    FROM recommendations GROUP BY 1, 2""", "recommendations"))
def prc_07(d):
    """PRC-07: full run over the scope with run statistics."""
    return rc.run_statistics(recommendations(d))


#: Rate sheets: a text per branch and category, the last one sent; some are no rates.
register_view("rate_sheets", """
    SELECT c_nationkey AS branch_id, CAST(c_custkey % 6 + 1 AS INTEGER) AS category_id,
           CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS sheet_rate
    FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 6 ORDER BY c_custkey DESC) = 1""")


def rate_sheets(d):
    key = F.col("c_custkey")
    text = F.when(key % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return d.t.customer.groupBy(F.col("c_nationkey").alias("branch_id"), (key % 6 + 1).cast("int").alias("category_id")).agg(
        F.max_by(text, key).alias("sheet_rate"))


@query("prc_07_run", with_views("""
    WITH checked AS (SELECT r.*, CASE WHEN TRY_CAST(sheet_rate AS DOUBLE) IS NULL AND sheet_rate IS NOT NULL THEN 'rate is not a number'
        WHEN TRY_CAST(sheet_rate AS DOUBLE) <= 0 THEN 'rate is not positive' END AS reason
      FROM recommendations r LEFT JOIN rate_sheets USING (branch_id, category_id))
    SELECT tenant_id, run_date, count(DISTINCT CASE WHEN reason IS NULL THEN (branch_id, category_id) END) AS units_processed,
           count(DISTINCT CASE WHEN reason IS NOT NULL THEN (branch_id, category_id) END) AS units_failed,
           count(*) AS recommendations_generated, count_if(reason IS NULL) AS recommendations_saved, count_if(reason IS NOT NULL) AS recommendations_quarantined,
           (SELECT list_sort(list(DISTINCT 'B' || branch_id || '/C' || category_id || ': ' || reason)) FROM checked WHERE reason IS NOT NULL) AS errors
    FROM checked GROUP BY 1, 2""", "recommendations", "rate_sheets"))
def prc_07_run(d):
    """PRC-07: a run saved with its statistics.  Cells whose rate sheet cannot be
    used are set aside with the reason; the others are saved."""
    rows = recommendations(d).join(rate_sheets(d), ["branch_id", "category_id"], "left")
    rate = F.col("sheet_rate").try_cast("double")
    rules = {"rate is not a number": F.col("sheet_rate").isNotNull() & rate.isNull(), "rate is not positive": rate <= 0,
             "price is missing": F.col("rec_daily").isNull() | F.isnan("rec_daily")}
    folder, run = new_table(d.spark, "recommendation-run"), ["tenant_id", "run_date"]
    saved, aside = quarantine.save_run(rows, folder, rc.CELL, rules, run)
    return quarantine.run_statistics(saved, aside, rc.CELL, run, {"branch_id": "B", "category_id": "C"})


#: City of a branch that no location names (fixed value).
DEFAULT_CITY = "Riyadh"


@query("sig_b", with_views(f"""
    SELECT w.tenant_id, w.branch_id, coalesce(b.city_name, '{DEFAULT_CITY}') AS city_name, w.weather_date AS signal_date, w.bad_weather_score,
           w.extreme_heat_flag, coalesce(h.is_holiday, FALSE) AS is_holiday, h.days_to_holiday,
           coalesce(h.is_weekend, dayofweek(w.weather_date) IN (5, 6)) AS is_weekend
    FROM weather_scored w LEFT JOIN branches b ON b.tenant_id = w.tenant_id AND b.branch_id = w.branch_id
      AND b.is_airport
    LEFT JOIN holiday_cal h ON h.tenant_id = w.tenant_id AND h.forecast_date = w.weather_date""",
                           "weather_scored", "branches", "holiday_cal"))
def sig_b(d):
    """SIG-B: combined external signals per branch and date (weather +
    calendar, city via the mapping of airport branches, else the default)."""
    from ratewise.functions.calendar import is_weekend
    w = wx.score_weather(d.weather, P.SPLIT_CUTOFF)
    c = _calendar(d).withColumnRenamed("forecast_date", "weather_date")
    b = d.branches.where("is_airport").select("tenant_id", "branch_id", F.col("city_name").alias("_c"))
    j = w.join(F.broadcast(b), ["tenant_id", "branch_id"], "left").join(c, ["tenant_id", "weather_date"], "left")
    return j.select("tenant_id", "branch_id", F.coalesce("_c", F.lit(DEFAULT_CITY)).alias("city_name"),
                    F.col("weather_date").alias("signal_date"), "bad_weather_score", "extreme_heat_flag",
                    F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"), "days_to_holiday",
                    F.coalesce("is_weekend", is_weekend("weather_date")).alias("is_weekend"))

