"""Backfills in any chunks, repeated chunks, daily updates; defaults of empty configuration; holiday payloads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratewise.operators import backfill as bf
from ratewise.operators import calendar as cal
from ratewise.operators import utilization as ut
from ratewise.sources.fixed import FEED_CATEGORIES, STATUS_CONFIG
from ratewise.sources.tenants import default_where_empty, feed_categories

D = dt.date


def test_chunks_cover_the_range_once():
    for days in (1, 7, 365, 10_000):
        got = list(bf.chunks(D(1999, 11, 3), D(2001, 2, 28), days))
        assert got[0][0] == D(1999, 11, 3) and got[-1][1] == D(2001, 2, 28)
        assert all(b + dt.timedelta(days=1) == c for (_, b), (c, _) in zip(got, got[1:])) and all(a <= b for a, b in got)
    assert list(bf.chunks(D(2000, 1, 2), D(2000, 1, 1), 5)) == []


def _tables(spark, folder, volume=3):
    shape = "tenant_id int, event_date date, city_name string, event_volume long"
    events = spark.createDataFrame([(1, D(2000, 1, 20) + dt.timedelta(days=i), c, volume + i) for i in range(50) for c in ("A", "B")], shape)
    holidays = spark.createDataFrame([(1, D(y, 9, 23), "day", "National") for y in range(1998, 2004)], "tenant_id int, holiday_date date, holiday_name string, holiday_type string")
    some = lambda df, c: lambda a, b: df.where(F.col(c).between(F.lit(a), F.lit(b)))
    return bf.CalendarTables(spark, str(folder), some(holidays, "holiday_date"), some(events, "event_date")), events


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_any_split_and_repeats_give_the_same_table(spark, tmp_path):
    want = None
    for days in (11, 400):
        tables, events = _tables(spark, tmp_path / str(days))
        counts = tables.backfill(1999, 2000, D(2000, 3, 1), days)
        assert counts == {"holidays": 3, "events": 2 * 42}
        rows = _rows(tables.read("events"))
        assert rows == _rows(events.where("event_date <= '2000-03-01'")) and rows == (want or rows)
        want = rows
    tables.fill("events", D(2000, 2, 10), D(2000, 2, 20), 4)  # after a failure
    assert _rows(tables.read("events")) == want and tables.read("holidays").count() == 3


def test_daily_update_changes_its_day_alone(spark, tmp_path):
    tables, _ = _tables(spark, tmp_path)
    tables.backfill(1999, 1999, D(2000, 2, 1))
    later, _ = _tables(spark, tmp_path, volume=100)
    assert later.daily_update(D(2000, 2, 1)) == {"holidays": 1, "events": 2}
    got = {(r.event_date, r.city_name): r.event_volume for r in later.read("events").collect()}
    assert got[D(2000, 2, 1), "A"] == 112 and got[D(2000, 1, 31), "A"] == 14 and len(got) == 26
    assert _rows(tables.read("holidays").select("holiday_date")) == [(D(1999, 9, 23),), (D(2000, 9, 23),)]


def test_empty_range(spark, tmp_path):
    tables, _ = _tables(spark, tmp_path)
    assert tables.daily_update(D(2050, 1, 1)) == {"holidays": 0, "events": 0}
    assert tables.read("events").collect() == []


def test_defaults_step_in_where_nothing_is_configured(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "tenant_id int")
    defaults = spark.createDataFrame([(s, t) for s, _, t in STATUS_CONFIG], "status_id int, status_type string")
    config = spark.createDataFrame([(1, 140, "RENTED", True), (1, 150, "RENTED", True), (2, 140, "RENTED", False)], "tenant_id int, status_id int, status_type string, is_active boolean")
    got = ut.status_groups(default_where_empty(config.where("is_active"), defaults, owners), ["tenant_id"]).collect()
    lists = {(r.tenant_id, r.status_type): r.status_ids for r in got}
    assert lists[1, "RENTED"] == [140, 150] and (1, "AVAILABLE") not in lists  # partial: as configured
    for tenant in (2, 3):  # only inactive rows, no rows
        assert (lists[tenant, "AVAILABLE"], lists[tenant, "RENTED"], len(lists[tenant, "EXCLUDED"])) == ([140], [141, 156], 13)


def test_vehicle_types_in_two_steps(spark):
    cells = spark.createDataFrame([(1, c) for c in range(1, 6)], "tenant_id int, category_id int")
    types = spark.createDataFrame([(1, 1, "FullSize", True), (1, 2, "suv", False), (1, 3, "boat", True), (2, 4, "luxury", True), (1, 5, "luxury", True)],
                                  "tenant_id int, category_id int, vehicle_type string, is_active boolean")
    words = spark.createDataFrame(FEED_CATEGORIES, "vehicle_type string, feed_category string")
    got = {r.category_id: (r.vehicle_type, r.feed_category) for r in feed_categories(cells, types, words, "economy", "Economy").collect()}
    assert got == {1: ("FullSize", "Standard"), 2: ("economy", "Economy"), 3: ("boat", "Economy"), 4: ("economy", "Economy"), 5: ("luxury", "Luxury Sedan")}


@pytest.mark.parametrize("name", ['"name": "Eid", ', "", '"name": null, '])
def test_holiday_without_a_name_is_unknown(spark, name):
    payload = '{"response": {"holidays": [{' + name + '"date": {"iso": "2020-05-24T00:00:00"}, "type": ["Religious"]}, {"name": "x", "date": {"iso": ""}}]}}'
    rows = cal.normalise_holiday_payload(spark.createDataFrame([(1, payload)], "tenant_id int, payload string"), ["National holiday", "Religious"]).collect()
    assert [(r.holiday_date, r.holiday_name, r.holiday_type, r.is_public_holiday) for r in rows] == [(D(2020, 5, 24), "Eid" if "Eid" in name else "Unknown", "Religious", False)]
