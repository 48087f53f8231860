"""Boundary values of the piecewise signal functions and the clamp
(hand-derived cases)."""

import pytest
from pyspark.sql import functions as F

from ratewise.functions import signals as sg


def _eval(spark, col, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col.alias("v")).collect()]


@pytest.mark.parametrize("u,expected", [
    (0.0, 0.0), (0.49, 0.294), (0.50, 0.30), (0.69, 0.49), (0.70, 0.50), (0.80, 0.75), (0.90, 1.0),
    (1.4, 1.0), (None, 0.5)])
def test_utilization_signal(spark, u, expected):
    (v,) = _eval(spark, sg.utilization_signal("u", "b"), [(u, None)], "u double, b double")
    assert v == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("r,expected", [(0.49, 0.0), (0.5, 0.0), (0.75, 0.25), (1.0, 0.5), (1.25, 0.75),
                                        (1.5, 1.0)])
def test_forecast_signal(spark, r, expected):
    (v,) = _eval(spark, sg.forecast_signal("f", "m"), [(r * 10.0, 10.0)], "f double, m double")
    assert v == pytest.approx(expected, abs=1e-9)


def test_forecast_signal_missing(spark):
    vals = _eval(spark, sg.forecast_signal("f", "m"), [(None, 1.0), (3.0, None), (3.0, 0.0)], "f double, m double")
    assert vals == [0.5, 0.5, 0.5]


@pytest.mark.parametrize("r,expected", [(0.5, 1.0), (0.6, 1.0), (0.75, 0.775), (0.8, 0.6), (1.0, 0.5), (1.2, 0.4),
                                        (1.4, 0.2), (1.8, 0.0), (2.5, 0.0)])
def test_competitor_signal(spark, r, expected):
    (v,) = _eval(spark, sg.competitor_signal("o", "a"), [(r * 100.0, 100.0)], "o double, a double")
    assert v == pytest.approx(expected, abs=1e-9)


def test_competitor_signal_missing(spark):
    assert _eval(spark, sg.competitor_signal("o", "a"), [(100.0, None), (100.0, 0.0)], "o double, a double") == [0.5, 0.5]


@pytest.mark.parametrize("rain,wind,code,expected", [(0, 0, 0, 0.0), (5, 20, 45, 0.2), (10, 30, 61, 0.5),
                                                     (20, 50, 94, 0.7), (21, 51, 95, 1.0)])
def test_bad_weather_score(spark, rain, wind, code, expected):
    (v,) = _eval(spark, sg.bad_weather_score("r", "w", "c"), [(float(rain), float(wind), code)],
                 "r double, w double, c int")
    assert v == pytest.approx(expected)


@pytest.mark.parametrize("bad,heat,rain,expected", [(0.7, 0, 0.0, 0.3), (0.2, 1, 0.0, 0.3), (0.4, 0, 0.0, 0.4),
                                                    (0.2, 0, 11.0, 0.4), (0.1, 0, 0.0, 0.6), (0.2, 0, 0.0, 0.5),
                                                    (0.05, 0, 11.0, 0.4)])
def test_weather_signal(spark, bad, heat, rain, expected):
    (v,) = _eval(spark, sg.weather_signal("b", "h", "r", F.lit(True)), [(bad, heat, rain)],
                 "b double, h int, r double")
    assert v == pytest.approx(expected)


def test_weather_signal_missing_row(spark):
    (v,) = _eval(spark, sg.weather_signal("b", "h", "r", F.lit(False)), [(0.9, 1, 20.0)], "b double, h int, r double")
    assert v == 0.5


@pytest.mark.parametrize("hol,days,school,wkd,expected", [(True, 0, False, False, 0.9), (False, 3, False, False, 0.75),
                                                          (False, 4, True, False, 0.7), (False, None, False, True, 0.6),
                                                          (False, None, False, False, 0.5)])
def test_holiday_signal(spark, hol, days, school, wkd, expected):
    (v,) = _eval(spark, sg.holiday_signal("h", "d", "s", "w"), [(hol, days, school, wkd)],
                 "h boolean, d int, s boolean, w boolean")
    assert v == expected


@pytest.mark.parametrize("level,expected", [(0.5, 0.0), (1.0, 40.0), (0.0, -30.0)])
def test_weighted_adjustment(spark, level, expected):
    names = ["utilization", "forecast", "competitor", "weather", "holiday"]
    w = dict(zip(names, [0.30, 0.25, 0.25, 0.10, 0.10]))
    col = sg.weighted_adjustment({n: F.col("s") for n in names}, {n: F.lit(w[n]) for n in names})
    (v,) = _eval(spark, col, [(level,)], "s double")
    assert v == pytest.approx(expected)


@pytest.mark.parametrize("base,raw,price,pct,applied", [
    (100.0, 10.0, 110.0, 10.0, False), (100.0, 50.0, 150.0, 50.0, False), (100.0, 60.0, 150.0, 50.0, True),
    (100.0, -40.0, 75.0, -25.0, True), (60.0, -25.0, 50.0, -16.6667, True), (40.0, 0.0, 50.0, 25.0, True)])
def test_clamp(spark, base, raw, price, pct, applied):
    c = sg.clamp_price("b", "r", F.lit(50.0), F.lit(25.0), F.lit(50.0))
    df = spark.createDataFrame([(base, raw)], "b double, r double")
    row = df.select(c["price"].alias("p"), c["pct"].alias("q"), c["applied"].alias("a")).first()
    assert (row.p, row.q, row.a) == (pytest.approx(price), pytest.approx(pct), applied)


def test_clamp_properties(spark):
    """Clamp is idempotent and never prices below the minimum."""
    import random
    rnd = random.Random(7)
    rows = [(rnd.uniform(20, 400), rnd.uniform(-60, 80)) for _ in range(300)]
    c = sg.clamp_price("b", "r", F.lit(50.0), F.lit(25.0), F.lit(50.0))
    df = spark.createDataFrame(rows, "b double, r double").select("b", c["price"].alias("p"), c["pct"].alias("q"))
    c2 = sg.clamp_price("b", "q", F.lit(50.0), F.lit(25.0), F.lit(50.0))
    out = df.select("p", "q", c2["pct"].alias("q2")).collect()
    for r in out:
        assert r.p >= 50.0 - 1e-9
        assert r.q2 == pytest.approx(r.q, abs=1e-3)


def test_explanation(spark):
    df = spark.createDataFrame([(0.8, 0.5, 0.5, 0.5, 0.5, 60.0, 50.0, True), (0.5, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0, False)],
                               "u double, f double, c double, w double, h double, r double, p double, a boolean")
    e = sg.explanation("u", "f", "c", "w", "h", "r", "p", "a")
    got = [r[0] for r in df.select(e).collect()]
    assert got[0] == "High utilization (+). Adjusted within guardrails (raw: 60.0% -> final: 50.0%)"
    assert got[1] == "Normal conditions"


@pytest.mark.parametrize("v,expected", [(0.145, 0.15), (1.005, 1.01), (1.015, 1.02), (-1.005, -1.01), (115.00499999999998, 115.01),
                                        (1.0049, 1.0), (None, None), (float("inf"), None)])
def test_money_is_half_up(spark, v, expected):
    import duckdb
    from ratewise.functions.mathx import money, money_sql
    assert _eval(spark, money("v"), [(v,)], "v double") == [expected]
    with duckdb.connect() as con:
        assert con.execute(f"SELECT {money_sql('v')} FROM (SELECT CAST(? AS DOUBLE) AS v)", [v]).fetchall() == [(expected,)]


def test_highest_price(spark):
    clamp = lambda top: sg.clamp_price("b", "r", F.lit(50.0), F.lit(25.0), F.lit(50.0), top)
    for top, price, pct, applied in ((F.lit(110.0), 110.0, 10.0, True), (F.lit(130.0), 120.0, 20.0, False),
                                     (F.lit(None).cast("double"), 120.0, 20.0, False), (F.lit(40.0), 40.0, -60.0, True)):
        c = clamp(top)
        assert [_eval(spark, c[k], [(100.0, 20.0)], "b double, r double")[0] for k in ("price", "pct", "applied")] == [price, pct, applied]


def test_signal_weights_do_not_depend_on_order(spark):
    from ratewise.operators import recommend as rc
    defaults = {n: 0.2 for n in rc.SIGNALS}
    rows = [(1, "demand_forecast", 0.9, True), (1, "forecast", 0.3, True), (1, "forecast", 0.1, True), (1, "weather", 0.5, False),
            (2, "demand_forecast", 0.7, True)]
    for some in (rows, rows[::-1]):
        got = {r.tenant_id: r for r in rc.signal_weights(
            spark.createDataFrame(some, "tenant_id int, signal_name string, weight double, is_enabled boolean"), defaults).collect()}
        assert (got[1].w_forecast, got[1].w_weather, got[1].w_holiday, got[2].w_forecast) == (0.3, 0.0, 0.2, 0.7)
