"""Several tenants: pruning, no leaks, configuration as it is read."""

import datetime as dt

from pyspark.sql import functions as F

from ratewise.operators import recommend as rc
from ratewise.plans.registry import domain
from ratewise.sources.fixed import GENERIC_GUARDRAIL
from ratewise.sources.tenants import Tenants, typed_settings

SMALL = "/root/testdata/sf0.001"


def _tenants(spark):
    return Tenants(domain(spark, SMALL))


def _files_read(df):
    """Partitions and files that the scans of an executed plan have read."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec" and p.relation().partitionSchema().length():
            found.append(p.metrics().apply("numPartitions").value())
        for i in range(p.children().length()):
            walk(p.children().apply(i))

    walk(plan)
    return found


def test_one_tenant_reads_one_folder(spark):
    t = _tenants(spark)
    assert _files_read(t.scan("contracts")) == [5]
    assert _files_read(t.scan("contracts", 3)) == [1]


def test_chosen_tenants_prune_at_run_time(spark):
    t = _tenants(spark)
    active = t.tenants.where("is_active").select("tenant_id")
    joined = t.scan("contracts").join(F.broadcast(active), "tenant_id", "left_semi")
    assert "dynamicpruning" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert _files_read(joined) == [4]


def test_no_tenant_sees_another(spark):
    t = _tenants(spark)
    nations = {r.n_nationkey: r.n_regionkey + 1 for r in t.d.t.nation.collect()}
    assert t.scan("contracts").count() == t.d.contracts.count()
    for one in (1, 5):
        rows = t.scan("contracts", one, ["tenant_id", "branch_id"]).distinct().collect()
        assert rows and all(r.tenant_id == one == nations[r.branch_id] for r in rows)
    # a vehicle's category depends on the tenant that rents it
    import __spark_entry__ as E
    facts = E.queries()["agg_01_tenants"](spark, SMALL)
    categories = {(r.tenant_id, r.vehicle_id): r.category_id for r in t.vehicles.collect()}
    rented = t.contracts.where("status_id = 211").select("tenant_id", "branch_id", "vehicle_id", "start_date").collect()
    want = {(r.tenant_id, r.branch_id, categories[r.tenant_id, r.vehicle_id], r.start_date) for r in rented}
    assert {(r.tenant_id, r.branch_id, r.category_id, r.demand_date) for r in facts.collect()} == want


def test_configuration_in_force_is_the_latest_by_then(spark):
    t = _tenants(spark)
    early, late = t.weights(dt.date(1996, 1, 1)).collect(), t.weights(dt.date(2002, 1, 1)).collect()
    changes = t._changes.collect()
    for day, rows in ((dt.date(1996, 1, 1), early), (dt.date(2002, 1, 1), late)):
        for r in rows:
            names = ("utilization", "forecast", "competitor", "weather", "holiday", "demand_forecast")
            last = max((c for c in changes if c.tenant_id == r.tenant_id and names[c.change_id % 6] == r.signal_name and c.changed_on <= day),
                       key=lambda c: (c.changed_on, c.change_id))
            assert (r.weight, r.is_enabled) == (last.n % 50 / 100, last.status != "P")
    assert {tuple(r) for r in early} != {tuple(r) for r in late}


def test_guardrails_zero_and_null_count_as_missing(spark):
    cells = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 2, 4), (2, 1, 3), (3, 1, 3), (3, 1, 9)], "tenant_id int, branch_id int, category_id int")
    rows = [(1, 1, 3, 0.0, None, 30.0, None, True), (1, 2, None, 80.0, 0.0, 0.0, 99.0, True), (1, None, 4, 70.0, 1.0, 2.0, None, True),
            (1, None, None, 10.0, 5.0, 6.0, None, True), (2, None, 3, 0.0, 0.0, None, None, True), (3, 1, 3, 1.0, 1.0, 1.0, None, False)]
    config = spark.createDataFrame(rows, "tenant_id int, branch_id int, category_id int, min_price double, max_discount_pct double, max_premium_pct double, "
                                         "max_price double, is_active boolean")
    got = {(r.tenant_id, r.branch_id, r.category_id): tuple(r)[3:] for r in rc.resolve_guardrails(
        cells, config, domain(spark, SMALL).categories, GENERIC_GUARDRAIL).collect()}
    assert got == {(1, 1, 3): (50.0, 25.0, 30.0, None), (1, 2, 3): (80.0, 25.0, 50.0, 99.0), (1, 2, 4): (80.0, 25.0, 50.0, 99.0),
                   (2, 1, 3): (50.0, 25.0, 50.0, None), (3, 1, 3): (100.0, 25.0, 50.0, None), (3, 1, 9): (50.0, 25.0, 50.0, None)}


def test_settings_of_every_type(spark):
    rows = [(1, "a", "5", "int"), (1, "b", "x", "int"), (1, "c", "1.5", "float"), (1, "d", "TRUE", "bool"), (1, "e", "yes", "bool"),
            (1, "f", "", "string"), (1, "g", "[1,2]", "json"), (1, "h", "{", "json"), (1, "i", None, "int"), (1, "j", "5", "other")]
    got = {r.setting_key: tuple(r)[2:] for r in typed_settings(spark.createDataFrame(rows, "tenant_id int, setting_key string, value string, type string")).collect()}
    none = (None,) * 5
    at = lambda i, v: (*none[:i], v, *none[i + 1:])
    assert got == {"a": at(0, 5), "b": none, "c": at(1, 1.5), "d": at(2, True), "e": none, "f": at(3, ""), "g": at(4, 2), "h": none, "i": none, "j": none}
