"""Upsert and workflow write paths."""

import datetime as dt

from ratewise.operators import recommend as rc
from ratewise.sinks.io import append, materialize, merge_by_key, new_table, write_partitioned


def test_merge_by_key(spark):
    t = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (2, "b", dt.date(2020, 1, 1))],
                              "k int, v string, created_at date")
    s = spark.createDataFrame([(1, "A", dt.date(2021, 1, 1)), (3, "c", dt.date(2021, 1, 1))],
                              "k int, v string, created_at date")
    got = {r.k: (r.v, r.created_at) for r in merge_by_key(t, s, ["k"], updated_col=None).collect()}
    assert got == {1: ("A", dt.date(2020, 1, 1)), 2: ("b", dt.date(2020, 1, 1)), 3: ("c", dt.date(2021, 1, 1))}


def test_bulk_approve_only_pending(spark):
    d = dt.date(2024, 1, 1)
    recs = spark.createDataFrame([(1, 1, 1, d, "approved"), (1, 1, 1, d + dt.timedelta(days=1), "pending"),
                                  (1, 1, 1, d + dt.timedelta(days=2), "skipped")],
                                 "tenant_id int, branch_id int, category_id int, forecast_date date, status string")
    out = rc.bulk_approve(recs, branch_id=1, start=d, end=d + dt.timedelta(days=5)).collect()
    assert sum(r.changed for r in out) == 1
    assert sorted(r.status for r in out) == ["approved", "approved", "skipped"]
    none = rc.bulk_approve(recs, branch_id=99).collect()
    assert sum(r.changed for r in none) == 0


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    m = materialize(df, "t")
    assert m.count() == 100
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString()


def test_partition_overwrite_replaces_only_its_partitions(spark):
    path = new_table(spark, "t")
    write_partitioned(spark.sql("SELECT id AS k, id % 3 AS p, 'old' AS v FROM range(30)"), path, ["p"])
    write_partitioned(spark.sql("SELECT 100 AS k, 1 AS p, 'new' AS v"), path, ["p"])
    got = sorted((r.p, r.v, r.n) for r in spark.read.parquet(path).groupBy("p", "v").count()
                 .withColumnRenamed("count", "n").collect())
    assert got == [(0, "old", 10), (1, "new", 1), (2, "old", 10)]


def test_append_keeps_what_is_there(spark):
    path = new_table(spark, "t")
    for v in ("a", "b", "b"):
        append(spark.createDataFrame([(v,)], "v string"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["a", "b", "b"]
