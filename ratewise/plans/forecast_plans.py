"""Queries for forecasting: totals, models, backtests, allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd_sql as R
from ratewise.operators import forecast as fc
from ratewise.operators import timeseries as ts
from ratewise.plans import params as P
from ratewise.plans.feature_plans import _fact_split as _fs
from ratewise.plans.feature_plans import _fs as _full_fs
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sinks import io

H = P.HORIZON
CUT = f"DATE '{P.SPLIT_CUTOFF}'"
RUN = f"DATE '{P.RUN_DATE}'"
PREV_RUN = P.RUN_DATE.replace(month=P.RUN_DATE.month - 1)

register_view("total_all", """
    SELECT tenant_id, demand_date, CAST(sum(executed_rentals_count) AS DOUBLE) AS y
    FROM feature_store GROUP BY 1, 2""", ("feature_store",))
register_view("total_train", """
    SELECT tenant_id, demand_date, CAST(sum(executed_rentals_count) AS DOUBLE) AS y
    FROM feature_store WHERE split_flag = 'TRAIN' GROUP BY 1, 2""", ("feature_store",))


def naive_sql(src: str, keys: str = "tenant_id", horizon: int = H) -> str:
    """Seasonal naive over view ``src`` (keys, demand_date, y)."""
    kj = " AND ".join(f"r.{k.strip()} = hz.{k.strip()}" for k in keys.split(","))
    hk = ", ".join(f"hz.{k.strip()}" for k in keys.split(","))
    return f"""
    SELECT {hk}, CAST(hz.h AS INTEGER) AS horizon_day, CAST(hz.last_date + CAST(hz.h AS INTEGER) AS DATE) AS forecast_date,
           {R('greatest(coalesce(r.y, hz.mean_tail), 0.0)', 4)} AS forecast_demand
    FROM (SELECT s.*, t.h, 7 - ((t.h - 1) % 7) AS need
          FROM (SELECT {keys}, avg(y) AS mean_tail, max(demand_date) AS last_date
                FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY demand_date DESC) AS rn FROM {src})
                WHERE rn <= 7 GROUP BY {keys}) s, range(1, {horizon + 1}) t(h)) hz
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY demand_date DESC) AS rn FROM {src}) r
      ON {kj} AND r.rn = hz.need"""


def holt_winters_sql(src: str, keys: str = "tenant_id", horizon: int = H) -> str:
    """Holt-Winters over view ``src`` (keys, demand_date, y) as a recursion
    over the days of a series, one row per series and step."""
    using = f"USING ({keys})"
    return f"""
    SELECT {keys}, CAST(h AS INTEGER) AS horizon_day, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS forecast_date,
           {R('greatest((l + h * t) * s[(i - 1 + h) % 7 + 1], 0.0)', 4)} AS forecast_demand
    FROM (WITH RECURSIVE
      pts AS (SELECT {keys}, y, demand_date, row_number() OVER (PARTITION BY {keys} ORDER BY demand_date) AS i FROM {src}),
      fit AS (SELECT {keys}, count(*) AS n, max(demand_date) AS last_date, sum(y) / count(*) AS mean,
                     sum(y) FILTER (i <= 7) / 7.0 AS l0, sum(y) FILTER (i BETWEEN 8 AND 14) / 7.0 AS l1,
                     list(y ORDER BY i) FILTER (i <= 7) AS week
              FROM pts GROUP BY {keys}),
      step AS (
        SELECT {keys}, n, last_date, CASE WHEN n < 14 THEN n ELSE 7 END AS i, CASE WHEN n < 14 THEN mean ELSE l0 END AS l,
               CASE WHEN n < 14 THEN 0.0 ELSE (l1 - l0) / 7.0 END AS t,
               CASE WHEN n < 14 THEN list_transform(range(7), lambda x: CAST(1 AS DOUBLE))
                    ELSE list_transform(week, lambda x: x / greatest(l0, 1.0)) END AS s
        FROM fit
        UNION ALL
        SELECT {keys}, n, last_date, i + 1, nl, 0.1 * (nl - l) + 0.9 * t,
               list_transform(s, lambda q, j: CASE WHEN j = i % 7 + 1 THEN 0.2 * (y / greatest(nl, 1.0)) + 0.8 * q ELSE q END)
        FROM (SELECT {keys}, n, last_date, step.i, l, t, s, y, 0.3 * (y / greatest(s[step.i % 7 + 1], 0.01)) + 0.7 * (l + t) AS nl
              FROM step JOIN (SELECT {keys}, i AS at, y FROM pts) p {using} WHERE p.at = step.i + 1))
      SELECT * FROM step WHERE i = n), range(1, {horizon + 1}) r(h)"""


register_view("naive_fc", naive_sql("total_train"), ("total_train",))
register_view("ets_fc", holt_winters_sql("total_train"), ("total_train",))
register_view("series_share", """
    SELECT tenant_id, branch_id, category_id, series_mean,
           series_mean / greatest(sum(series_mean) OVER (PARTITION BY tenant_id), 1.0) AS share
    FROM (SELECT tenant_id, branch_id, category_id, avg(CAST(executed_rentals_count AS DOUBLE)) AS series_mean
          FROM feature_store GROUP BY 1, 2, 3)""", ("feature_store",))
register_view("naive_alloc", f"""
    SELECT f.tenant_id, s.branch_id, s.category_id, f.horizon_day, f.forecast_date,
           {R('f.forecast_demand * s.share', 2)} AS forecast_demand
    FROM naive_fc f JOIN series_share s ON s.tenant_id = f.tenant_id""", ("naive_fc", "series_share"))


def _metrics_sql(pairs: str, keys: str) -> str:
    return f"""
    SELECT {keys}, {R('avg(abs(y - p))', 4)} AS mae,
           {R('avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100', 4)} AS mape,
           {R('avg(CASE WHEN (abs(y) + abs(p)) / 2 <> 0 THEN abs(y - p) / ((abs(y) + abs(p)) / 2) END) * 100', 4)} AS smape,
           {R('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse, count(*) AS n_points
    FROM {pairs} GROUP BY {keys}"""


def _total_train(d):
    return fc.total_demand(_fs(d).where(F.col("split_flag") == "TRAIN"))


@query("agg_25", with_views("SELECT * FROM total_all", "total_all"))
def agg_25(d):
    """AGG-25: total demand per date across series."""
    return fc.total_demand(_fs(d))


@query("agg_26", with_views("SELECT * FROM series_share", "series_share"))
def agg_26(d):
    """AGG-26: series mean and share of the total of means."""
    return fc.series_share(_fs(d))


@query("fct_01", with_views("SELECT * FROM naive_fc", "naive_fc"))
def fct_01(d):
    """FCT-01: seasonal-naive forecast of the TRAIN total, 30 days."""
    return fc.seasonal_naive(_total_train(d), H, ["tenant_id"])


@query("fct_01_series", with_views(naive_sql("fact", "tenant_id, branch_id, category_id")
                                   .replace("FROM fact", "FROM (SELECT tenant_id, branch_id, category_id, demand_date, "
                                            "CAST(executed_rentals_count AS DOUBLE) AS y FROM fact)"), "fact"))
def fct_01_series(d):
    """FCT-01 per series: seasonal naive on every branch x category."""
    from ratewise.operators import demand as dm
    f = dm.build_daily_demand(d).select("tenant_id", "branch_id", "category_id", "demand_date",
                                        F.col("executed_rentals_count").cast("double").alias("y"))
    return fc.seasonal_naive(f, H, ["tenant_id", "branch_id", "category_id"])


@query("fct_02", with_views("SELECT * FROM ets_fc", "ets_fc"))
def fct_02(d):
    """FCT-02: Holt-Winters (a=.3, b=.1, g=.2, m=7) on the TRAIN total."""
    return fc.holt_winters(_total_train(d), H, ["tenant_id"])


register_view("fact_series", """
    SELECT tenant_id, branch_id, category_id, demand_date, CAST(executed_rentals_count AS DOUBLE) AS y FROM fact""", ("fact",))


@query("fct_02_series", with_views(holt_winters_sql("fact_series", "tenant_id, branch_id, category_id"), "fact_series"))
def fct_02_series(d):
    """FCT-02 per series: Holt-Winters on every branch x category."""
    from ratewise.operators import demand as dm
    f = dm.build_daily_demand(d).select("tenant_id", "branch_id", "category_id", "demand_date",
                                        F.col("executed_rentals_count").cast("double").alias("y"))
    return fc.holt_winters(f, H, ["tenant_id", "branch_id", "category_id"])


def _pairs_sql(forecast: str) -> str:
    return f"""(SELECT v.tenant_id, v.y, f.forecast_demand AS p FROM
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY demand_date) AS pos
                      FROM total_all WHERE demand_date >= {CUT}) WHERE pos <= {H}) v
      JOIN {forecast} f ON f.tenant_id = v.tenant_id AND f.forecast_date = v.demand_date)"""


NAIVE_PAIRS = _pairs_sql("naive_fc")
register_view("backtest", f"""
    SELECT 'seasonal_naive' AS model_name, * FROM ({_metrics_sql(NAIVE_PAIRS, "tenant_id")})
    UNION ALL SELECT 'simple_ets', * FROM ({_metrics_sql(_pairs_sql("ets_fc"), "tenant_id")})""",
              ("total_all", "naive_fc", "ets_fc"))
register_view("best_model", """
    SELECT tenant_id, arg_min(model_name, (coalesce(mae, 'Infinity'::DOUBLE), model_name)) AS selected_model,
           min(coalesce(mae, 'Infinity'::DOUBLE)) AS metric_value
    FROM backtest GROUP BY tenant_id""", ("backtest",))


@query("fct_06", with_views(_metrics_sql(NAIVE_PAIRS, "tenant_id"), "total_all", "naive_fc"))
def fct_06(d):
    """FCT-06: MAE / MAPE / sMAPE / RMSE of the seasonal-naive holdout."""
    return fc.backtest(fc.total_demand(_fs(d)), P.SPLIT_CUTOFF, H, models=("seasonal_naive",)).drop("model_name")


@query("fct_07", with_views("SELECT * FROM backtest", "backtest"))
def fct_07(d):
    """FCT-07: holdout backtest of both models on the total series."""
    return fc.backtest(fc.total_demand(_fs(d)), P.SPLIT_CUTOFF, H)


FOLDS = 3
register_view("fold_hist", f"""
    SELECT t.*, CAST(f.fold AS INTEGER) AS fold,
           CAST({CUT} - CAST(f.fold * {H} AS INTEGER) AS DATE) AS fold_cutoff
    FROM total_all t, range(0, {FOLDS}) f(fold)""", ("total_all",))
register_view("fold_train", """
    SELECT tenant_id, fold, demand_date, y FROM fold_hist WHERE demand_date < fold_cutoff""", ("fold_hist",))
register_view("fold_fc", naive_sql("fold_train", "tenant_id, fold"), ("fold_train",))


@query("fct_08", with_views(_metrics_sql(f"""(SELECT v.tenant_id, v.fold, v.y, f.forecast_demand AS p
      FROM fold_hist v JOIN fold_fc f ON f.tenant_id = v.tenant_id AND f.fold = v.fold
        AND f.forecast_date = v.demand_date
      WHERE v.demand_date >= v.fold_cutoff AND v.demand_date < v.fold_cutoff + {H})""", "tenant_id, fold"),
                            "fold_hist", "fold_fc"))
def fct_08(d):
    """FCT-08: rolling-origin backtest, 3 folds of 30 days (seasonal naive)."""
    return fc.rolling_backtest(fc.total_demand(_fs(d)), P.SPLIT_CUTOFF, H, FOLDS)


@query("fct_08_ets", with_views(_metrics_sql(f"""(SELECT v.tenant_id, v.fold, v.y, f.forecast_demand AS p
      FROM fold_hist v JOIN ({holt_winters_sql("fold_train", "tenant_id, fold")}) f
        ON f.tenant_id = v.tenant_id AND f.fold = v.fold AND f.forecast_date = v.demand_date
      WHERE v.demand_date >= v.fold_cutoff AND v.demand_date < v.fold_cutoff + {H})""", "tenant_id, fold"),
                                "fold_hist", "fold_train"))
def fct_08_ets(d):
    """FCT-08: the same folds with Holt-Winters."""
    return fc.rolling_backtest(fc.total_demand(_fs(d)), P.SPLIT_CUTOFF, H, FOLDS, model="simple_ets")


@query("fct_09", with_views("SELECT * FROM best_model", "best_model"))
def fct_09(d):
    """FCT-09 / TOP-06: best model by MAE (failures count as infinite)."""
    return fc.select_best(fc.backtest(fc.total_demand(_fs(d)), P.SPLIT_CUTOFF, H))


@query("fct_10", with_views("SELECT * FROM naive_alloc", "naive_alloc"))
def fct_10(d):
    """FCT-10: top-down allocation of the total forecast by series share."""
    return fc.allocate(fc.seasonal_naive(_total_train(d), H, ["tenant_id"]), fc.series_share(_fs(d)))


@query("fct_11", with_views(f"""
    SELECT tenant_id, forecast_date, {R('sum(forecast_demand)', 2)} AS total_forecast
    FROM naive_alloc GROUP BY 1, 2""", "naive_alloc"))
def fct_11(d):
    """FCT-11: bottom-up sum of the series forecasts per date."""
    alloc = fc.allocate(fc.seasonal_naive(_total_train(d), H, ["tenant_id"]), fc.series_share(_fs(d)))
    return fc.bottom_up(alloc)


register_view("forecast_runs", f"""
    SELECT *, {RUN} AS run_date, 'seasonal_naive' AS model_name, '1.0' AS model_version FROM naive_alloc
    UNION ALL
    SELECT f.tenant_id, s.branch_id, s.category_id, f.horizon_day, f.forecast_date,
           {R('f.forecast_demand * s.share', 2)} AS forecast_demand, DATE '{PREV_RUN}' AS run_date,
           'seasonal_naive' AS model_name, '1.0' AS model_version
    FROM ({naive_sql("(SELECT * FROM total_all WHERE demand_date < DATE '" + str(PREV_RUN) + "')")}) f
    JOIN series_share s ON s.tenant_id = f.tenant_id""", ("naive_alloc", "total_all", "series_share"))


def forecast_runs(d):
    """Two seasonal-naive runs (a month apart) as a versioned forecast table."""
    if "_runs" not in d.__dict__:
        fs = _fs(d)
        shares = fc.series_share(fs)
        total = fc.total_demand(fs)
        out = None
        for run in (P.RUN_DATE, PREV_RUN):
            f = fc.allocate(fc.seasonal_naive(total.where(F.col("demand_date") < F.lit(run)), H, ["tenant_id"]),
                            shares)
            f = f.select("*", F.lit(run).alias("run_date"), F.lit("seasonal_naive").alias("model_name"),
                         F.lit("1.0").alias("model_version"))
            out = f if out is None else out.unionByName(f)
        d.__dict__["_runs"] = out
    return d.__dict__["_runs"]


@query("fct_12", with_views("SELECT * FROM forecast_runs", "forecast_runs"))
def fct_12(d):
    """FCT-12: the versioned forecast table: each run is written as the
    partition of its date, the other runs stay, and the table is read back."""
    runs = forecast_runs(d)
    path = io.new_table(d.spark, "forecasts")
    for run in (PREV_RUN, P.RUN_DATE):
        io.write_partitioned(runs.where(F.col("run_date") == F.lit(run)), path, ["run_date"])
    return d.spark.read.schema(runs.schema).parquet(path).select(runs.columns)


@query("win_12", with_views("""
    SELECT tenant_id, branch_id, category_id, forecast_date,
           arg_max(forecast_demand, run_date) AS forecast_demand, max(run_date) AS run_date,
           arg_max(model_name, run_date) AS model_name
    FROM forecast_runs GROUP BY 1, 2, 3, 4""", "forecast_runs"))
def win_12(d):
    """WIN-12 / FCT-13: latest run's forecast per cell and date."""
    return fc.latest_forecast(forecast_runs(d))


@query("fct_14", with_views(f"""
    SELECT f.tenant_id, s.branch_id, s.category_id, f.horizon_day, f.forecast_date,
           {R('f.forecast_demand * s.share', 2)} AS forecast_demand, {RUN} AS run_date, f.model_name, '1.0' AS model_version
    FROM (SELECT 'seasonal_naive' AS model_name, * FROM naive_fc
          UNION ALL SELECT 'simple_ets', * FROM ets_fc) f
    JOIN best_model b ON b.tenant_id = f.tenant_id AND b.selected_model = f.model_name
    JOIN series_share s ON s.tenant_id = f.tenant_id""", "naive_fc", "ets_fc", "best_model", "series_share"))
def fct_14(d):
    """FCT-14: full train pipeline -- backtest, pick the best model, forecast
    with it and allocate to series."""
    fact = io.materialize(_fs(d), "fact")
    best = fc.select_best(fc.backtest(fc.total_demand(fact), P.SPLIT_CUTOFF, H))
    runs = [fc.forecast_run(fact, P.RUN_DATE, H, m) for m in fc.MODELS]
    allr = runs[0].unionByName(runs[1])
    return allr.join(best.select("tenant_id", F.col("selected_model").alias("model_name")),
                     ["tenant_id", "model_name"], "left_semi")


@query("win_13", with_views(f"""
    SELECT tenant_id, branch_id, category_id,
           max(CASE WHEN rn = 1 THEN executed_rentals_count END) AS last_value,
           max(CASE WHEN rn = 7 THEN executed_rentals_count END) AS value_7_back,
           {R('avg(CASE WHEN rn <= 7 THEN executed_rentals_count END)', 4)} AS mean_last_7,
           {R('avg(executed_rentals_count)', 4)} AS mean_last_30, max(demand_date) AS last_date
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, branch_id, category_id ORDER BY demand_date DESC) AS rn
          FROM fact) WHERE rn <= 30 GROUP BY 1, 2, 3""", "fact"))
def win_13(d):
    """WIN-13: last-k tail statistics per series (row based)."""
    from ratewise.operators import demand as dm
    return ts.tail_stats(dm.build_daily_demand(d), "executed_rentals_count",
                         ["tenant_id", "branch_id", "category_id"], "demand_date")


_FEATURES = ("target", "lag_1d", "lag_7d", "rolling_7d", "temperature_avg")
register_view("sequences", f"""
    SELECT * FROM (
      SELECT tenant_id, branch_id, category_id, demand_date, target,
             list({{{", ".join(f"'{c}': {c}" for c in _FEATURES)}}}) OVER (
               PARTITION BY tenant_id, branch_id, category_id ORDER BY demand_date
               ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS sequence
      FROM (SELECT tenant_id, branch_id, category_id, demand_date, CAST(executed_rentals_count AS DOUBLE) AS target,
                   coalesce(CAST(rentals_lag_1d AS DOUBLE), 0.0) AS lag_1d, coalesce(CAST(rentals_lag_7d AS DOUBLE), 0.0) AS lag_7d,
                   coalesce(rentals_rolling_7d_avg, 0.0) AS rolling_7d, coalesce(temperature_avg, 30.0) AS temperature_avg
            FROM feature_store))
    WHERE len(sequence) = 14""", ("feature_store",))


@query("win_14", with_views("SELECT * FROM sequences", "sequences"))
def win_14(d):
    """WIN-14: 14-step sliding sequences of 5 features -> next value."""
    from ratewise.operators import features as fe
    mm = fe.model_matrix(_full_fs(d))
    return ts.sliding_sequences(mm, ["target", "lag_1d", "lag_7d", "rolling_7d", "temperature_avg"], "target",
                                ["tenant_id", "branch_id", "category_id"], "demand_date", 14)
