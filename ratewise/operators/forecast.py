"""Forecasting (AGG-25, AGG-26, FCT-01..11, FCT-13, TOP-06).

Series are independent, so every model is a per-series computation keyed
by the series columns:

* seasonal naive: a descending ``row_number`` keeps the last 7 rows per
  series (Spark limits each group before the shuffle), then a join on the
  seasonal offset of each horizon day;
* Holt-Winters: the series' ordered values as one array (bounded by the
  number of days in the history) folded with the SQL higher-order
  ``aggregate`` -- pure Catalyst, no Python worker;
* metrics, backtests, selection and allocation are joins and grouped
  aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd

SEASON = 7


def total_demand(fact: DataFrame, value: str = "executed_rentals_count",
                 keys=("tenant_id",), date_col: str = "demand_date") -> DataFrame:
    """AGG-25: total demand per date (sum across series)."""
    return fact.groupBy(*keys, date_col).agg(F.sum(value).cast("double").alias("y"))


def seasonal_naive(history: DataFrame, horizon: int, keys, date_col: str = "demand_date",
                   value: str = "y", m: int = SEASON) -> DataFrame:
    """FCT-01: h-th forecast = history[-m + (h-1) % m]; when the history is
    shorter than that, the mean of the last m values; floored at 0."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    tail = history.select(*keys, date_col, F.col(value).cast("double").alias("v"),
                          F.row_number().over(w).alias("rn")).where(F.col("rn") <= m)
    stats = tail.groupBy(*keys).agg(F.avg("v").alias("mean_tail"), F.max(date_col).alias("last_date"))
    hz = stats.select(*keys, "mean_tail", "last_date",
                      F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_day"))
    hz = hz.withColumn("rn", F.lit(m) - (F.col("horizon_day") - 1) % m)
    j = hz.join(tail.select(*keys, "rn", "v"), keys + ["rn"], "left")
    return j.select(
        *keys, "horizon_day",
        F.date_add("last_date", F.col("horizon_day")).alias("forecast_date"),
        rnd(F.greatest(F.coalesce("v", "mean_tail"), F.lit(0.0)), 4).alias("forecast_demand"),
    )


def _hw_state_expr(alpha: float, beta: float, gamma: float, m: int) -> str:
    """SQL for the fitted state struct(l, t, s, n) of column ``ys``."""
    mean = lambda arr, k: f"(aggregate({arr}, CAST(0 AS DOUBLE), (a, x) -> a + x) / {k})"
    l0 = mean(f"slice(ys, 1, {m})", m)
    t0 = f"(({mean(f'slice(ys, {m + 1}, {m})', m)} - {l0}) / {m})"
    s0 = f"transform(slice(ys, 1, {m}), y -> y / greatest({l0}, 1.0))"
    step = (
        f"(st, y) -> transform(array({alpha} * (y / greatest(element_at(st.s, (st.i % {m}) + 1), 0.01))"
        f" + (1 - {alpha}) * (st.l + st.t)), nl -> named_struct("
        f"'l', nl, 't', {beta} * (nl - st.l) + (1 - {beta}) * st.t, "
        f"'s', transform(st.s, (q, j) -> IF(j = st.i % {m}, {gamma} * (y / greatest(nl, 1.0)) + (1 - {gamma}) * q, q)), "
        f"'i', st.i + 1))[0]"
    )
    long_fit = (f"aggregate(slice(ys, {m + 1}, size(ys) - {m}), "
                f"named_struct('l', {l0}, 't', {t0}, 's', {s0}, 'i', {m}), {step})")
    short_fit = (f"named_struct('l', {mean('ys', 'size(ys)')}, 't', CAST(0 AS DOUBLE), "
                 f"'s', array_repeat(CAST(1 AS DOUBLE), {m}), 'i', size(ys))")
    return f"CASE WHEN size(ys) < {2 * m} THEN {short_fit} ELSE {long_fit} END"


def holt_winters(history: DataFrame, horizon: int, keys, date_col: str = "demand_date",
                 value: str = "y", alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2,
                 m: int = SEASON, phase: str = "aligned") -> DataFrame:
    """FCT-02: Holt-Winters, additive trend and multiplicative season.

    Short histories (< 2m) use the mean, no trend and a flat season.  The
    forecast season slot is ``(n - 1 + h) % m`` (``phase='aligned'``) or
    ``h % m`` (``phase='as_coded'``).  Floored at 0.
    """
    keys = list(keys)
    ordered = history.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(date_col).alias("d"),
                                             F.col(value).cast("double").alias("v")))).alias("pts"))
    fitted = ordered.select(*keys, F.col("pts.v").alias("ys"), F.element_at(F.col("pts.d"), -1).alias("last_date"))
    fitted = fitted.select(*keys, "last_date", F.expr(_hw_state_expr(alpha, beta, gamma, m)).alias("st"))
    hz = fitted.select(*keys, "last_date", "st", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_day"))
    h = F.col("horizon_day")
    slot = (F.col("st.i") - 1 + h) % m if phase == "aligned" else h % m
    f = (F.col("st.l") + h * F.col("st.t")) * F.element_at(F.col("st.s"), slot + 1)
    return hz.select(*keys, "horizon_day", F.date_add("last_date", h).alias("forecast_date"),
                     rnd(F.greatest(f, F.lit(0.0)), 4).alias("forecast_demand"))


MODELS = {"seasonal_naive": seasonal_naive, "simple_ets": holt_winters}


def metrics(pairs: DataFrame, keys, y: str = "y", p: str = "p") -> DataFrame:
    """FCT-06: MAE, MAPE (y != 0), sMAPE (denominator != 0), RMSE."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    den = (F.abs(yy) + F.abs(pp)) / 2
    return pairs.groupBy(*keys).agg(
        rnd(F.avg(F.abs(yy - pp)), 4).alias("mae"),
        rnd(F.avg(F.when(yy != 0, F.abs((yy - pp) / yy))) * 100, 4).alias("mape"),
        rnd(F.avg(F.when(den != 0, F.abs(yy - pp) / den)) * 100, 4).alias("smape"),
        rnd(F.sqrt(F.avg((yy - pp) * (yy - pp))), 4).alias("rmse"),
        F.count(F.lit(1)).alias("n_points"),
    )


def backtest(total: DataFrame, cutoff: dt.date, horizon: int, keys=("tenant_id",),
             models=("seasonal_naive", "simple_ets")) -> DataFrame:
    """FCT-07: fit each model on dates before ``cutoff``, forecast the
    horizon and score it against the actual totals of the first
    ``horizon`` validation dates (aligned by date)."""
    keys = list(keys)
    train = total.where(F.col("demand_date") < F.lit(cutoff))
    w = Window.partitionBy(*keys).orderBy("demand_date")
    val = (total.where(F.col("demand_date") >= F.lit(cutoff))
                .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= horizon))
    out = None
    for name in models:
        fc = MODELS[name](train, horizon, keys).select(
            *keys, F.col("forecast_date").alias("demand_date"), F.col("forecast_demand").alias("p"))
        pairs = val.join(fc, keys + ["demand_date"]).withColumn("model_name", F.lit(name))
        out = pairs if out is None else out.unionByName(pairs)
    return metrics(out, keys + ["model_name"])


def rolling_backtest(total: DataFrame, cutoff: dt.date, horizon: int, n_folds: int,
                     keys=("tenant_id",), model: str = "seasonal_naive") -> DataFrame:
    """FCT-08: rolling-origin evaluation; fold k uses the cutoff moved back
    k * horizon days.  One folds table joined to the history replicates
    the (aggregated, small) total series once per fold."""
    keys = list(keys)
    hist = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    hist = hist.withColumn("fold_cutoff", F.date_sub(F.lit(cutoff), F.col("fold") * horizon))
    train = hist.where(F.col("demand_date") < F.col("fold_cutoff"))
    fc = MODELS[model](train.drop("fold_cutoff"), horizon, keys + ["fold"])
    val = hist.where((F.col("demand_date") >= F.col("fold_cutoff"))
                     & (F.col("demand_date") < F.date_add("fold_cutoff", horizon)))
    pairs = val.join(fc.select(*keys, "fold", F.col("forecast_date").alias("demand_date"),
                               F.col("forecast_demand").alias("p")), keys + ["fold", "demand_date"])
    return metrics(pairs, keys + ["fold"])


def select_best(metrics_df: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """FCT-09 / TOP-06: model with minimum MAE (failed = infinite MAE)."""
    mae = F.coalesce(F.col("mae"), F.lit(float("inf")))
    return metrics_df.groupBy(*keys).agg(
        F.min_by("model_name", F.struct(mae, F.col("model_name"))).alias("selected_model"),
        F.min(mae).alias("metric_value"))


def series_share(context: DataFrame, keys=("tenant_id",), series=("branch_id", "category_id"),
                 value: str = "executed_rentals_count") -> DataFrame:
    """AGG-26: series mean and its share of the summed series means,
    divided by max(total, 1)."""
    keys, series = list(keys), list(series)
    means = context.groupBy(*keys, *series).agg(F.avg(F.col(value).cast("double")).alias("series_mean"))
    w = Window.partitionBy(*keys)
    return means.withColumn("share", F.col("series_mean") / F.greatest(F.sum("series_mean").over(w), F.lit(1.0)))


def allocate(total_fc: DataFrame, shares: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """FCT-10: top-down allocation of the total forecast by mean share (2 dp)."""
    keys = list(keys)
    j = total_fc.join(shares, keys)
    return j.select(*keys, "branch_id", "category_id", "horizon_day", "forecast_date",
                    rnd(F.col("forecast_demand") * F.col("share"), 2).alias("forecast_demand"))


def bottom_up(series_fc: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """FCT-11: sum of series forecasts per date."""
    return series_fc.groupBy(*keys, "forecast_date").agg(
        rnd(F.sum("forecast_demand"), 2).alias("total_forecast"))


def forecast_run(fact_fs: DataFrame, run_date: dt.date, horizon: int, model: str,
                 keys=("tenant_id",), version: str = "1.0") -> DataFrame:
    """FCT-14 output: fit ``model`` on the TRAIN total, forecast the
    horizon, allocate to series by their mean over TRAIN + VALIDATION;
    stamped with run date, model name and version."""
    total = total_demand(fact_fs.where(F.col("split_flag") == "TRAIN"))
    fc = MODELS[model](total, horizon, keys)
    shares = series_share(fact_fs, keys)
    out = allocate(fc, shares, keys)
    return out.select("*", F.lit(run_date).alias("run_date"), F.lit(model).alias("model_name"),
                      F.lit(version).alias("model_version"))


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    """WIN-12 / FCT-13: the latest run's forecast per cell and date."""
    k = ["tenant_id", "branch_id", "category_id", "forecast_date"]
    return forecasts.groupBy(*k).agg(
        F.max_by(F.struct("forecast_demand", "run_date", "model_name"), "run_date").alias("x")).select(
        *k, "x.forecast_demand", "x.run_date", "x.model_name")
