"""Property tests: every signal stays within [0, 1] and the adjustment is
monotone in the weighted signal level."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewise.functions import signals as sg

VAL = st.one_of(st.none(), st.floats(min_value=0, max_value=3, allow_nan=False))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(VAL, VAL, VAL, VAL), min_size=1, max_size=30))
def test_signals_in_unit_interval(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = [sg.utilization_signal("a", "b"), sg.forecast_signal("a", "b"), sg.competitor_signal("c", "d"),
            sg.weather_signal("a", F.lit(0), "c", F.lit(True))]
    for r in df.select(*[c.alias(f"s{i}") for i, c in enumerate(cols)]).collect():
        for v in r:
            assert 0.0 <= v <= 1.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=2, max_size=20))
def test_adjustment_monotone(spark, levels):
    names = ["utilization", "forecast", "competitor", "weather", "holiday"]
    w = dict(zip(names, [0.30, 0.25, 0.25, 0.10, 0.10]))
    adj = sg.weighted_adjustment({n: F.col("s") for n in names}, {n: F.lit(w[n]) for n in names})
    df = spark.createDataFrame([(x,) for x in sorted(levels)], "s double")
    out = [r[0] for r in df.select(adj).collect()]
    assert all(a <= b + 1e-9 for a, b in zip(out, out[1:]))
    assert -30.0 - 1e-9 <= min(out) and max(out) <= 40.0 + 1e-9
