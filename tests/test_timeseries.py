"""Calendar lags, seasonal naive, Holt-Winters vs a plain re-computation,
metrics and allocation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import forecast as fc
from ratewise.operators import timeseries as ts

D0 = dt.date(2024, 1, 1)


def _series(spark, values, days=None):
    days = days or list(range(len(values)))
    rows = [(1, 1, 1, D0 + dt.timedelta(days=d), v) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "tenant_id int, branch_id int, category_id int, demand_date date, "
                                       "executed_rentals_count int")


def test_calendar_lag_on_gaps(spark):
    f = ts.calendar_lags(_series(spark, [5, 7, 9], [1, 3, 4])).orderBy("demand_date").collect()
    assert [r.rentals_lag_1d for r in f] == [None, None, 7]
    assert [r.rentals_rolling_7d_avg for r in f] == [None, 5.0, 6.0]


def test_lag_equals_self_join(spark):
    """Differential: RANGE-window lags == the self-join definition."""
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(200, 90, replace=False).tolist())
    s = _series(spark, rng.integers(1, 30, len(days)).tolist(), days)
    w = ts.calendar_lags(s)
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("b.demand_date") >= F.date_sub("a.demand_date", 7))
               & (F.col("b.demand_date") <= F.date_sub("a.demand_date", 1)), "left")
    sj = j.groupBy("a.demand_date").agg(F.round(F.avg("b.executed_rentals_count"), 4).alias("m"))
    got = {r.demand_date: r.rentals_rolling_7d_avg for r in w.collect()}
    for r in sj.collect():
        exp = r.m
        assert (got[r.demand_date] is None and exp is None) or got[r.demand_date] == pytest.approx(exp)


def _hist(spark, values):
    rows = [(1, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tenant_id int, demand_date date, y double")


def test_seasonal_naive(spark):
    out = fc.seasonal_naive(_hist(spark, [9, 9, 1, 2, 3, 4, 5, 6, 7]), 9, ["tenant_id"]).orderBy("horizon_day")
    assert [r.forecast_demand for r in out.collect()] == [1, 2, 3, 4, 5, 6, 7, 1, 2]


def test_seasonal_naive_short(spark):
    out = fc.seasonal_naive(_hist(spark, [10, 20]), 7, ["tenant_id"]).orderBy("horizon_day").collect()
    assert out[0].forecast_demand == 15 and out[5].forecast_demand == 10 and out[6].forecast_demand == 20


def _hw_reference(y, h, a=0.3, b=0.1, g=0.2, m=7):
    """Plain re-computation of the Holt-Winters recursion (aligned phase)."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 2 * m:
        lvl, tr, s = float(np.mean(y)), 0.0, np.ones(m)
    else:
        lvl = float(np.mean(y[:m]))
        tr = (float(np.mean(y[m:2 * m])) - lvl) / m
        s = np.array([y[i] / max(lvl, 1) for i in range(m)])
        for t in range(m, n):
            k = t % m
            prev = lvl
            lvl = a * (y[t] / max(s[k], 0.01)) + (1 - a) * (lvl + tr)
            tr = b * (lvl - prev) + (1 - b) * tr
            s[k] = g * (y[t] / max(lvl, 1)) + (1 - g) * s[k]
    return [max(0.0, (lvl + i * tr) * s[(n - 1 + i) % m]) for i in range(1, h + 1)]


@pytest.mark.parametrize("n", [5, 13, 14, 40, 120])
def test_holt_winters_matches_recursion(spark, n):
    rng = np.random.default_rng(n)
    y = (20 + 10 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 2, n)).round(0)
    out = fc.holt_winters(_hist(spark, y.tolist()), 10, ["tenant_id"]).orderBy("horizon_day").collect()
    exp = _hw_reference(y, 10)
    assert [r.forecast_demand for r in out] == pytest.approx(exp, abs=1e-3)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 8.0)], "k int, y double, p double")
    r = fc.metrics(df, ["k"]).first()
    assert r.mae == pytest.approx(1.5)
    assert r.mape == pytest.approx(20.0)
    assert r.smape == pytest.approx(111.1111, abs=1e-4)
    assert r.rmse == pytest.approx(2.5 ** 0.5, abs=1e-4)


def test_allocation_sums_to_total(spark):
    ctx = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 1, 3), (1, 2, 1, 1)],
                                "tenant_id int, branch_id int, category_id int, executed_rentals_count int")
    shares = fc.series_share(ctx)
    tot = spark.createDataFrame([(1, 1, D0, 8.0)], "tenant_id int, horizon_day int, forecast_date date, "
                                                   "forecast_demand double")
    out = {r.branch_id: r.forecast_demand for r in fc.allocate(tot, shares).collect()}
    assert out == {1: 6.0, 2: 2.0}
