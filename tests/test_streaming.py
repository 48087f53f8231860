"""Streaming re-aims equal their batch counterparts: for one file and for many
in any order, in any session time zone, resumed and replayed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ratewise.streaming import incremental as st

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def several_files(spark, tmp_path_factory):
    """The small tables with lineitem and events as folders of five files, dealt
    by a hash, so that no file is in time order."""
    d = tmp_path_factory.mktemp("sf")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t in ("lineitem", "events"):
            df = df.repartition(5, F.xxhash64(*df.columns) % 97)
        df.write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("tz", ["UTC", "America/Los_Angeles"])
def test_event_stream_equals_batch(spark, tz):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        stream = E.queries()["stm_05"](spark, SMALL)
        batch = E.queries()["sig_e"](spark, SMALL)
        assert _rows(stream) == _rows(batch)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_demand_stream_equals_batch(spark):
    stream = E.queries()["stm_01"](spark, SMALL)
    batch = E.queries()["agg_01"](spark, SMALL)
    assert _rows(stream) == _rows(batch)


@pytest.mark.parametrize("name", ["stm_01", "stm_02", "stm_03", "stm_04", "stm_05"])
def test_many_files_in_any_order(spark, several_files, monkeypatch, name):
    """One file per micro-batch gives what a single file gives, and a second
    run over the same files changes nothing."""
    monkeypatch.setattr(st.stream_table, "__defaults__", (1,))
    want = _rows(E.queries()[name](spark, SMALL))
    assert _rows(E.queries()[name](spark, several_files)) == want
    assert _rows(E.queries()[name](spark, several_files)) == want


def _feed(spark, path):
    table = st.FeedTable(spark, "test", path)
    stream = st.stream_table(spark, path, 1)
    return table, st.run_available(stream, table, lambda b: b.groupBy("k").agg(F.count("*").alias("n")))


def _total(partials):
    return {r.k: r.n for r in partials.groupBy("k").agg(F.sum("n").alias("n")).collect()}


def test_later_files_and_replayed_batches(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).select((F.col("id") % 2).alias("k")).coalesce(1).write.parquet(path)
    _, first = _feed(spark, path)
    assert _total(first) == {0: 5, 1: 5}
    spark.range(4).select((F.col("id") % 2).alias("k")).coalesce(1).write.mode("append").parquet(path)
    table, both = _feed(spark, path)
    assert _total(both) == {0: 7, 1: 7}
    epoch = both.agg(F.max("epoch")).first()[0]
    again = both.where(F.col("epoch") == epoch).drop("epoch").collect()
    table.write(spark.createDataFrame(again, both.drop("epoch").schema), epoch)  # the batch comes once more
    assert _total(table.read()) == {0: 7, 1: 7}


def _at(*hours):
    return [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)) for h in hours]


def _deduplicated(spark, path, files, period="day"):
    """Files of (key, hour), one after another, each in a run of its own."""
    for rows in files:
        spark.createDataFrame([(k, *_at(h)) for k, h in rows], "k int, t timestamp").coalesce(1).write.mode("append").parquet(path)
        table = st.PeriodTable(spark, "dedup-test", path, period)
        out = st.run_deduplicated(st.stream_table(spark, path, 1), table, ["k"], "t", lambda b: b)
    return sorted((99 if r.k is None else r.k, (r.t - dt.datetime(2020, 1, 1)).total_seconds() / 3600) for r in out.collect()), table


def test_quotes_count_again_after_a_day(spark, tmp_path):
    rows = [(1, 0), (1, 5), (1, 23.9), (1, 24), (1, 30), (1, 47.9), (1, 49), (2, 3), (None, 1), (None, 2), (1, 0)]
    got, _ = _deduplicated(spark, f"{tmp_path}/t", [rows])
    assert got == [(1, 0), (1, 24), (1, 49), (2, 3), (99, 1)]


def test_deduplication_over_files_in_any_order(spark, tmp_path):
    """Kept rows of a key are a day apart, each dropped row is within a day of
    one, and a late file of earlier days keeps its rows."""
    r = random.Random(3)
    rows = [(r.randrange(4), r.randrange(0, 24 * 9 * 4) / 4) for _ in range(250)]
    for n in range(2):
        r.shuffle(rows)
        files = [rows[i::4] for i in range(4)] + [[(9, -500), (0, -501)]]
        got, _ = _deduplicated(spark, f"{tmp_path}/{n}", files)
        for k in range(4):
            kept = [t for q, t in got if q == k]
            assert all(b - a >= 24 for a, b in zip(kept, kept[1:]))
            assert all(min(abs(t - x) for x in kept) < 24 for q, t in rows if q == k)
        assert (9, -500) in got and (0, -501) in got


def test_deduplication_reads_the_days_within_a_day_alone(spark, tmp_path):
    _, table = _deduplicated(spark, f"{tmp_path}/t", [[(1, 24 * d + 1) for d in range(40)], [(2, 24 * 20)]])
    new = spark.createDataFrame([(2, *_at(24 * 20 + 3))], "k int, t timestamp")
    at, ttl = F.col("t"), dt.timedelta(hours=24)
    some = table.read_periods(table.periods(new, at - ttl, at, at + ttl))
    assert {str(r.period) for r in some.select("period").distinct().collect()} == {"2020-01-20", "2020-01-21", "2020-01-22"}
    assert len(some.inputFiles()) < len(table.read().inputFiles()) / 5


def test_replayed_deduplication_changes_nothing(spark, tmp_path):
    got, table = _deduplicated(spark, f"{tmp_path}/t", [[(1, 0), (1, 30)], [(1, 40), (1, 60), (2, 1)]])
    assert got == [(1, 0), (1, 30), (1, 60), (2, 1)]
    ttl = dt.timedelta(hours=24)
    new = spark.createDataFrame([(k, *_at(h)) for k, h in [(1, 40), (1, 60), (2, 1)]], "k int, t timestamp")
    kept = table.read_periods(table.periods(new, F.col("t") - ttl, F.col("t"), F.col("t") + ttl)).where("epoch < 1")
    table.write_periods(st.not_seen(new, kept, ["k"], "t", ttl), "t", 1)  # the batch comes once more
    assert sorted((r.k, r.t) for r in table.read().collect()) == sorted((k, *_at(h)) for k, h in got)


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    path = f"{tmp_path}/t"
    shape = "k int, day date, v string, seq int"
    jan, feb = dt.date(2020, 1, 5), dt.date(2020, 2, 6)

    def feed(*rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
        table = st.UpsertTable(spark, "upsert-test", path)
        out = st.run_upserts(st.stream_table(spark, path, 1), table, ["k", "day"], "day", ["seq"], lambda b: b)
        return sorted((r.k, r.day, r.v) for r in out.collect()), table

    got, table = feed((1, jan, "a", 1), (1, jan, "b", 2), (2, jan, "c", 1), (1, feb, "d", 1))
    assert got == [(1, jan, "b"), (1, feb, "d"), (2, jan, "c")]
    got, table = feed((2, jan, "changed", 5), (3, jan, None, 1))
    assert got == [(1, jan, "b"), (1, feb, "d"), (2, jan, "changed"), (3, jan, None)]
    assert table.versions() == {"2020-01": 1, "2020-02": 0}  # February was left alone
    got, table = feed((2, jan, "older", 3), (1, feb, "newer", 9))  # what is older does not win
    assert got == [(1, jan, "b"), (1, feb, "newer"), (2, jan, "changed"), (3, jan, None)]
    rows = spark.createDataFrame([(2, jan, "older", 3), (1, feb, "newer", 9)], shape)
    table.merge(rows, ["k", "day"], "day", ["seq"], 2)  # the batch comes once more
    assert sorted((r.k, r.day, r.v) for r in table.current().collect()) == got


def test_rewritten_file_starts_a_new_feed(spark, tmp_path):
    """A single-file table replaced in place is read again, and only then."""
    import duckdb

    path = f"{tmp_path}/t.parquet"

    def run(n):
        if n is not None:
            with duckdb.connect() as con:
                con.execute(f"COPY (SELECT range AS v FROM range({n})) TO '{path}' (FORMAT parquet)").fetchall()
        out = st.run_available(st.stream_table(spark, path), st.FeedTable(spark, "rewritten", path), lambda b: b.agg(F.count("*").alias("n")))
        return sum(r.n for r in out.collect())

    assert [run(3), run(None), run(50), run(None)] == [3, 3, 50, 50]
