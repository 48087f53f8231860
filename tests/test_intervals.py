"""Range joins against brute force, and their plans."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratewise.operators.intervals import interval_join

D0 = dt.date(1999, 12, 20)
_DAY = st.one_of(st.none(), st.integers(-80, 80).map(lambda n: D0 + dt.timedelta(days=n)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.tuples(st.integers(0, 2), _DAY), max_size=12), spans=st.lists(st.tuples(st.integers(0, 2), _DAY, _DAY), max_size=12),
       width=st.sampled_from([1, 7, 32]))
def test_range_join_equals_brute_force(spark, days, spans, width):
    low, high = D0 - dt.timedelta(days=40), D0 + dt.timedelta(days=50)
    left = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(days)], "i int, k int, d date")
    right = spark.createDataFrame([(i, k, a, b) for i, (k, a, b) in enumerate(spans)], "j int, k int, a date, b date")
    got = interval_join(left, right, "d", "a", "b", low, high, ("k",), width)
    want = [(i, j) for i, (k, d) in enumerate(days) for j, (q, a, b) in enumerate(spans)
            if k == q and d and a and low <= d <= high and a <= d and (b is None or b >= d)]
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want


@pytest.mark.parametrize("name", ["flt_02_days", "flt_02_prices"])
def test_range_joins_are_no_nested_loops(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
