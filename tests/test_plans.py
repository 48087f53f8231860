"""Plan-shape checks: the properties the design relies on at scale."""

import re

import pytest

import __spark_entry__ as E
from ratewise.sinks import io

SMALL = "/root/testdata/sf0.001"


def _plan(spark, name):
    return E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_topk_is_limited_before_the_shuffle(spark):
    p = _plan(spark, "top_03")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_fact_reads_only_needed_columns(spark):
    p = _plan(spark, "agg_01")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    li = [s for s in scans if "l_shipdate" in s]
    assert li and all("l_tax" not in s and "l_discount" not in s for s in li)


def test_flagship_pushes_the_window_into_the_quote_scan(spark):
    p = _plan(spark, "prc_05")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", p)


def test_no_python_udfs_in_headline_plans(spark):
    for n in ("agg_01", "fst_05", "cmp_04", "fct_02_series"):
        p = _plan(spark, n)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, n


def test_a_signal_reads_its_own_inputs_alone(spark):
    for name, reads, leaves in (("sig_w", "o_totalprice", "l_shipdate"), ("sig_h", "l_shipdate", "o_totalprice")):
        p = _plan(spark, name)
        assert reads in p and leaves not in p, name


def test_signals_are_the_columns_of_the_run(spark):
    run = {(r.branch_id, r.category_id, r.forecast_date): r for r in E.queries()["prc_05"](spark, SMALL).collect()}
    for name in ("utilization", "forecast", "competitor", "weather", "holiday"):
        rows = E.queries()[f"sig_{name[0]}"](spark, SMALL).collect()
        assert len(rows) == len(run)
        assert all(r[3] == run[tuple(r)[:3]][f"{name}_signal"] for r in rows), name


def test_guardrails_read_their_configuration_twice_at_most(spark):
    p = _plan(spark, "prc_02_tenants")
    assert len(re.findall(r"FileScan parquet \[[^\]]*o_orderstatus", p)) <= 2


def test_no_table_of_vehicles_and_months_or_days_is_held(spark):
    """A hash table of (cell, vehicle, month) grew with a task's contracts."""
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", _plan(spark, "jn_06_daily"))
    assert keys and not any("vehicle_id" in k for k in keys)


def _holds_vehicle_days(plan):
    """Aggregates with the vehicle and one key more than a cell and its vehicle."""
    return [k for k in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan) if "vehicle_id" in k and k.count("#") > 4]


def test_statistics_of_the_feature_store_hold_no_table_of_vehicle_days(spark):
    assert not _holds_vehicle_days(_plan(spark, "agg_11"))


def test_sequences_hold_no_table_of_vehicle_days(spark):
    assert not _holds_vehicle_days(_plan(spark, "win_14"))


def _plan_of_first_written(spark, monkeypatch, name):
    """The plan of the first table that a query writes for its own use."""
    class Seen(Exception):
        pass

    def materialize(df, name="table"):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(io, "materialize", materialize)
    with pytest.raises(Seen) as seen:
        E.queries()[name](spark, SMALL)
    return str(seen.value)


def test_model_matrix_of_the_sequences_holds_no_table_of_vehicle_days(spark, monkeypatch):
    p = _plan_of_first_written(spark, monkeypatch, "fct_05")
    assert "Aggregate" in p and not _holds_vehicle_days(p)


def test_feature_store_holds_no_table_of_vehicle_days(spark):
    assert not _holds_vehicle_days(_plan(spark, "fst_01"))


def test_model_matrix_holds_no_table_of_vehicle_days(spark, monkeypatch):
    p = _plan_of_first_written(spark, monkeypatch, "fst_07")
    assert "Aggregate" in p and not _holds_vehicle_days(p)


def test_training_rows_are_built_without_a_table_of_vehicle_days(spark, monkeypatch):
    p = _plan_of_first_written(spark, monkeypatch, "fct_03")
    assert "Aggregate" in p and not _holds_vehicle_days(p)
