"""Effective periods, band pivot, utilization, vehicles on rent and the competitor index."""

import datetime as dt
import random

from ratewise.operators import competitor as cp
from ratewise.operators import rates as rt
from ratewise.operators import utilization as ut
from ratewise.sources.fixed import fixed_table

D = dt.date(2024, 6, 1)


def test_effective_on(spark):
    rows = [(1, D - dt.timedelta(days=10), D, True), (2, D - dt.timedelta(days=10), D - dt.timedelta(days=1), True),
            (3, D - dt.timedelta(days=10), None, True), (4, D + dt.timedelta(days=1), None, True)]
    r = spark.createDataFrame(rows, "rate_id int, start_date date, end_date date, is_active boolean")
    assert sorted(x.rate_id for x in rt.effective_on(r, D).collect()) == [1, 3]


def test_band_pivot(spark):
    rows = [(1, 1, 6, 10.0), (1, 1, None, 20.0), (1, 7, 27, 50.0), (1, 28, None, 90.0), (1, 7, 30, 999.0)]
    lines = spark.createDataFrame(rows, "rate_id int, from_days int, to_days int, rate double")
    r = rt.period_pivot(lines, ["rate_id"]).first()
    assert (r.daily_rate, r.weekly_rate, r.monthly_rate) == (15.0, 50.0, 90.0)


def test_utilization_cell(spark):
    v = spark.createDataFrame([(1, 1, 1, i, s, False) for i, s in enumerate([141, 156, 140, 143])],
                              "tenant_id int, branch_id int, category_id int, vehicle_id int, status_id int, "
                              "is_deleted boolean")
    r = ut.utilization(v, fixed_table(spark, "status_config")).first()
    assert (r.rented_count, r.available_count, r.utilization) == (2, 1, 0.6667)


def test_utilization_only_excluded(spark):
    v = spark.createDataFrame([(1, 1, 1, 1, 143, False)], "tenant_id int, branch_id int, category_id int, "
                                                          "vehicle_id int, status_id int, is_deleted boolean")
    assert ut.utilization(v, fixed_table(spark, "status_config")).count() == 0


def test_on_rent_daily_equals_a_count_by_hand(spark):
    rng, day0 = random.Random(5), dt.date(2023, 11, 20)
    rows = []
    for _ in range(300):
        start = day0 + dt.timedelta(days=rng.randrange(120))
        length = rng.choice([-1, 0, 1, 20, 31, 75])  # ends before it starts; one day; over several months, leap day included
        rows.append((1, rng.randrange(2), 7, rng.randrange(12), start, start + dt.timedelta(days=length)))
    rows.append((1, 0, 7, 3, day0, None))
    df = spark.createDataFrame(rows, "tenant_id int, branch_id int, category_id int, vehicle_id int, start_date date, end_date date")
    want = {}
    for t, b, c, v, s, e in rows:
        for i in range((e - s).days + 1 if e else 0):
            want.setdefault((t, b, c, s + dt.timedelta(days=i)), set()).add(v)
    got = {tuple(r)[:4]: r.vehicles_on_rent for r in ut.on_rent_daily(df).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    lo, hi = dt.date(2023, 12, 31), dt.date(2024, 3, 1)
    for i in range((hi - day0).days + 1):  # within a window, a contract without an end lasts until the window's
        want.setdefault((1, 0, 7, day0 + dt.timedelta(days=i)), set()).add(3)
    part = {tuple(r)[:4]: r.vehicles_on_rent for r in ut.on_rent_daily(df, lo, hi).collect()}
    assert part == {k: len(v) for k, v in want.items() if lo <= k[3] <= hi}


def test_on_rent_daily_counts_overlaps_once_and_keeps_days_without_a_known_vehicle(spark):
    day = lambda i: dt.date(2024, 2, 1) + dt.timedelta(days=i)
    rows = [(1, None, 7, 5, day(0), day(9)), (1, None, 7, 5, day(2), day(3)), (1, None, 7, 5, day(9), day(11)), (1, None, 7, 5, day(14), day(14)),
            (1, None, 7, 6, day(11), day(11)), (1, None, 7, None, day(14), day(15)), (1, None, 7, 6, None, day(3))]
    df = spark.createDataFrame(rows, "tenant_id int, branch_id int, category_id int, vehicle_id int, start_date date, end_date date")
    got = {r.day: r.vehicles_on_rent for r in ut.on_rent_daily(df).collect()}
    assert got == {**{day(i): 1 for i in range(11)}, day(11): 2, day(14): 1, day(15): 0}


def test_competitor_index_takes_three_cheapest_with_ties(spark):
    day = dt.date(2024, 1, 1)
    prices = [10.0, 10.0, 20.0, 20.0, 30.0, 0.0]
    quotes = spark.createDataFrame([(1, 1, day, p, "Economy") for p in prices] + [(1, 2, day, 7.0, "Economy")],
                                   "tenant_id int, branch_id int, price_date date, daily_price double, category string")
    mapping = spark.createDataFrame([(9, "Economy")], "category_id int, competitor_vehicle_type string")
    base = spark.createDataFrame([(1, 1, 9, 20.0), (1, 2, 5, 7.0)],
                                 "tenant_id int, branch_id int, category_id int, base_daily double")
    got = {r.branch_id: r for r in cp.competitor_index(quotes, mapping, base, "Economy").collect()}
    assert (got[1].competitor_avg_price, got[1].competitor_min_price, got[1].competitor_max_price,
            got[1].competitors_count, got[1].price_position) == (13.33, 10.0, 30.0, 5, 1.5004)
    assert (got[2].competitor_avg_price, got[2].competitors_count) == (7.0, 1)
