"""Holiday proximity windows, event windows and type priority."""

import datetime as dt

from ratewise.operators import calendar as cal

D0 = dt.date(2024, 3, 1)


def _spine(spark, n=30):
    return spark.createDataFrame([(1, D0 + dt.timedelta(days=i)) for i in range(n)], "tenant_id int, cal_date date")


def _hol(spark, rows):
    return spark.createDataFrame([(1, D0 + dt.timedelta(days=o), n, "National", True) for o, n in rows],
                                 "tenant_id int, holiday_date date, holiday_name string, holiday_type string, "
                                 "is_public_holiday boolean")


def test_holiday_window(spark):
    out = {r.cal_date: r for r in cal.holiday_window(_spine(spark), _hol(spark, [(10, "A"), (10, "B")]), 7).collect()}
    on = out[D0 + dt.timedelta(days=10)]
    assert (on.days_to_next_holiday, on.days_since_last_holiday, on.holidays_in_window) == (0, 0, 1)
    ahead = out[D0 + dt.timedelta(days=3)]
    assert (ahead.days_to_next_holiday, ahead.next_holiday_name, ahead.holidays_in_window) == (7, "A", 1)
    far = out[D0 + dt.timedelta(days=25)]
    assert (far.days_to_next_holiday, far.days_since_last_holiday, far.holidays_in_window) == (-1, -1, 0)


def test_event_windows(spark):
    spine = _spine(spark, 5).withColumn("city_name", cal.F.lit("X"))
    ev = spark.createDataFrame([(1, D0 + dt.timedelta(days=2), "X", 10, 2.0), (1, D0 + dt.timedelta(days=4), "X", 50, 4.0)],
                               "tenant_id int, event_date date, city_name string, event_volume int, event_score double")
    hol = _hol(spark, [])
    out = {r.cal_date: r for r in cal.calendar_features(spine, hol, ev).collect()}
    d = out[D0 + dt.timedelta(days=4)]
    assert d.event_score_3d_avg == 3.0 and d.event_score_7d_avg == 3.0 and d.event_score_today == 4.0
    assert out[D0].event_score_3d_avg == 0.0


def test_type_priority(spark):
    df = spark.createDataFrame([(["Muslim", "National holiday"],), (["Season"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(cal.holiday_type_priority("t", cal_priority())).collect()]
    assert got == ["National holiday", "Season", "Unknown"]


def cal_priority():
    from ratewise.sources.fixed import HOLIDAY_TYPE_PRIORITY
    return HOLIDAY_TYPE_PRIORITY
