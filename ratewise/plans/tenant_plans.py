"""Queries over several tenants: scans of partitioned tables and configuration
in force (SRC-01, SIG-P, SIG-V, CFG-07, AGG-19, PRC-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions import signals as sg
from ratewise.functions.mathx import rnd_sql as R
from ratewise.operators import demand as dm
from ratewise.operators import recommend as rc
from ratewise.operators import utilization as ut
from ratewise.plans import params as P
from ratewise.plans import recommend_plans  # noqa: F401  (registers shared views)
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sources.fixed import CATEGORIES, DEFAULT_COMPETITOR_TYPE, DEFAULT_VEHICLE_TYPE, GENERIC_GUARDRAIL, SIGNAL_WEIGHTS, fixed_table_sql
from ratewise.sources.tenants import (CONFIGURED_TYPES, SETTING_TYPES, STATUS_TYPES, WEIGHT_NAMES, Tenants, default_where_empty,
                                      feed_categories, typed_settings)

W = dict(SIGNAL_WEIGHTS)
AS_OF = f"DATE '{P.RUN_DATE}'"
ONE_TENANT = 3
COLUMNS = ["tenant_id", "contract_id", "branch_id", "vehicle_id", "start_date", "daily_rate", "status_id"]

register_view("tenants", "SELECT r_regionkey + 1 AS tenant_id, r_name AS tenant_name, r_regionkey % 4 <> 1 AS is_active FROM region")
register_view("t_branches", "SELECT n_regionkey + 1 AS tenant_id, n_nationkey AS branch_id, n_name AS branch_name FROM nation")
register_view("t_contracts", "SELECT c.* REPLACE (b.tenant_id AS tenant_id) FROM contracts c JOIN t_branches b USING (branch_id)", ("contracts", "t_branches"))
register_view("t_vehicles", f"""
    SELECT t.tenant_id, vehicle_id, model_id, CAST((category_id + t.tenant_id - 2) % {len(CATEGORIES)} + 1 AS INTEGER) AS category_id
    FROM vehicles, tenants t""", ("vehicles", "tenants"))
register_view("changes", """
    SELECT b.tenant_id, b.branch_id, o_orderkey AS change_id, CAST(o_orderdate AS DATE) AS changed_on, o_custkey AS n, o_orderstatus AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN t_branches b ON c_nationkey = branch_id""", ("t_branches",))
_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY changed_on DESC, change_id DESC) = 1"
register_view("weight_rows", f"""
    SELECT tenant_id, list_extract([{", ".join(f"'{n}'" for n in WEIGHT_NAMES)}], CAST(change_id % {len(WEIGHT_NAMES)} + 1 AS INTEGER)) AS signal_name,
           (n % 50) / 100.0 AS weight, status <> 'P' AS is_enabled
    FROM changes WHERE changed_on <= {AS_OF} {_LAST.format(f"tenant_id, change_id % {len(WEIGHT_NAMES)}")}""", ("changes",))
register_view("guardrail_rows", f"""
    SELECT tenant_id, of_branch, of_category, min_price, max_discount_pct, max_premium_pct, is_active FROM (
    SELECT *, CASE WHEN change_id % 3 = 0 THEN branch_id END AS of_branch, CASE WHEN change_id % 7 <> 0 THEN CAST(change_id % 7 AS INTEGER) END AS of_category,
           CASE WHEN n % 5 <> 0 THEN CAST(n % 4 * 60 AS DOUBLE) END AS min_price, CAST(n % 41 AS DOUBLE) AS max_discount_pct,
           CASE WHEN change_id % 13 <> 0 THEN CAST(change_id % 61 AS DOUBLE) END AS max_premium_pct, status = 'F' AS is_active
    FROM changes WHERE changed_on <= {AS_OF}) {_LAST.format("tenant_id, of_branch, of_category")}""", ("changes",))
register_view("setting_rows", f"""
    SELECT tenant_id, 's' || (c_custkey % 40) AS setting_key, type, CASE WHEN c_custkey % 11 = 0 THEN 'n/a'
           WHEN type = 'int' THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) WHEN type = 'float' THEN CAST(c_acctbal / 4 AS VARCHAR)
           WHEN type = 'bool' THEN CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'false' END WHEN type = 'string' THEN c_name
           ELSE '["' || c_mktsegment || '",' || c_custkey || ']' END AS value
    FROM (SELECT *, list_extract([{", ".join(f"'{t}'" for t in SETTING_TYPES)}], CAST(c_custkey % {len(SETTING_TYPES)} + 1 AS INTEGER)) AS type FROM customer)
    JOIN t_branches ON c_nationkey = branch_id
    QUALIFY row_number() OVER (PARTITION BY tenant_id, c_custkey % 40 ORDER BY c_custkey DESC) = 1""", ("t_branches",))
_NAME = "CASE WHEN signal_name = 'demand_forecast' THEN 'forecast' ELSE signal_name END"
_OWN = "CAST(signal_name <> 'demand_forecast' AS INTEGER)"
register_view("t_weights", f"""
    SELECT tenant_id, {", ".join(f"coalesce(max(CASE WHEN nm = '{n}' THEN w END), {W[n]!r}::DOUBLE) AS w_{n}" for n in rc.SIGNALS)}
    FROM (SELECT tenant_id, {_NAME} AS nm, CASE WHEN is_enabled THEN weight ELSE 0.0 END AS w FROM weight_rows
          QUALIFY row_number() OVER (PARTITION BY tenant_id, {_NAME} ORDER BY {_OWN} DESC) = 1) GROUP BY tenant_id""", ("weight_rows",))


@query("src_01", with_views(f"SELECT {', '.join(COLUMNS)} FROM t_contracts WHERE tenant_id = {ONE_TENANT}", "t_contracts"))
def src_01(d):
    """SRC-01: one tenant's contracts, from its folder of the partitioned table."""
    return Tenants(d).scan("contracts", ONE_TENANT, COLUMNS)


@query("src_01_active", with_views(f"SELECT {', '.join(COLUMNS)} FROM t_contracts WHERE tenant_id IN (SELECT tenant_id FROM tenants WHERE is_active)",
                                   "t_contracts", "tenants"))
def src_01_active(d):
    """SRC-01: contracts of the active tenants; the join prunes the others' folders at run time."""
    t = Tenants(d)
    active = t.tenants.where("is_active").select("tenant_id")
    return t.scan("contracts", columns=COLUMNS).join(F.broadcast(active), "tenant_id", "left_semi")  # a row per region


@query("agg_01_tenants", with_views(f"""
    SELECT c.tenant_id, c.branch_id, v.category_id, c.start_date AS demand_date, count(*) AS executed_rentals_count,
           {R('avg(daily_rate)', 4)} AS avg_base_price_paid, {R('min(daily_rate)', 4)} AS min_base_price_paid, {R('max(daily_rate)', 4)} AS max_base_price_paid
    FROM t_contracts c JOIN t_vehicles v ON c.tenant_id = v.tenant_id AND c.vehicle_id = v.vehicle_id WHERE c.status_id = 211
    GROUP BY 1, 2, 3, 4""", "t_contracts", "t_vehicles"))
def agg_01_tenants(d):
    """AGG-01 for all tenants at once, each with its own catalogue."""
    t = Tenants(d)
    rented = dm.with_category(dm.executed_rentals(t.scan("contracts", columns=COLUMNS)), t.vehicles)
    return dm.daily_demand(rented).select(*dm.FACT_KEYS, "executed_rentals_count", "avg_base_price_paid", "min_base_price_paid", "max_base_price_paid")


def _weights(d):
    return rc.signal_weights(Tenants(d).weights(P.RUN_DATE), W)


@query("sig_p", with_views("SELECT * FROM t_weights", "t_weights"))
def sig_p(d):
    """SIG-P: each tenant's weight rows in force, pivoted to one row."""
    return _weights(d)


@query("sig_v", with_views(f"""
    SELECT tenant_id, {R(' + '.join('w_' + n for n in rc.SIGNALS), 4)} AS weight_sum,
           abs({' + '.join('w_' + n for n in rc.SIGNALS)} - 1.0) < 0.01 AS is_valid FROM t_weights""", "t_weights"))
def sig_v(d):
    """SIG-V: whether each tenant's weights sum to 1 within .01."""
    return rc.weights_check(_weights(d))


@query("cfg_07", with_views("""
    SELECT tenant_id, setting_key, TRY_CAST(CASE WHEN type = 'int' THEN value END AS BIGINT) AS int_value,
           TRY_CAST(CASE WHEN type = 'float' THEN value END AS DOUBLE) AS float_value,
           CASE WHEN type = 'bool' AND lower(value) IN ('true', 'false') THEN lower(value) = 'true' END AS bool_value,
           CASE WHEN type = 'string' THEN value END AS string_value,
           CAST(CASE WHEN type = 'json' AND json_valid(value) THEN json_array_length(value) END AS INTEGER) AS json_items
    FROM setting_rows""", "setting_rows"))
def cfg_07(d):
    """CFG-07: every tenant's latest settings, decoded by declared type."""
    return typed_settings(Tenants(d).settings)


@query("agg_19", with_views("""
    SELECT t.tenant_id, tenant_name, is_active,
      (SELECT count(*) FROM guardrail_rows g WHERE g.tenant_id = t.tenant_id AND g.is_active) AS active_guardrails,
      (SELECT list_sort(list({'category_id': coalesce(of_category, 0), 'min_price': min_price, 'max_discount_pct': max_discount_pct,
         'max_premium_pct': max_premium_pct})) FROM guardrail_rows g WHERE g.tenant_id = t.tenant_id AND g.is_active AND of_branch IS NULL) AS guardrails,
      (SELECT list_sort(list({'signal_name': signal_name, 'weight': weight})) FROM weight_rows w WHERE w.tenant_id = t.tenant_id AND w.is_enabled) AS weights,
      (SELECT list_sort(list(branch_id)) FROM t_branches b WHERE b.tenant_id = t.tenant_id AND EXISTS (
         SELECT 1 FROM t_contracts c WHERE c.branch_id = b.branch_id)) AS selected_branches,
      (SELECT list_sort(list({'branch_id': branch_id, 'branch_name': branch_name, 'city': tenant_name})) FROM t_branches b WHERE b.tenant_id = t.tenant_id) AS branch_cities
    FROM tenants t""", "tenants", "guardrail_rows", "weight_rows", "t_branches", "t_contracts"))
def agg_19(d):
    """AGG-19: each tenant's configuration as one nested row: guardrails in
    force (those for all branches in full, category 0 for all), weights, branches with contracts
    and the city of every branch.  Lists are bounded by the configuration."""
    t = Tenants(d)
    listed = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    fields = (F.coalesce("category_id", F.lit(0)).alias("category_id"), "min_price", "max_discount_pct", "max_premium_pct")
    everywhere = F.when(F.col("branch_id").isNull(), F.struct(*fields))
    guard = t.guardrails(P.RUN_DATE).where("is_active").groupBy("tenant_id").agg(
        F.count("*").alias("active_guardrails"), F.array_sort(F.collect_list(everywhere)).alias("guardrails"))
    weights = t.weights(P.RUN_DATE).where("is_enabled").groupBy("tenant_id").agg(listed("signal_name", "weight").alias("weights"))
    selected = t.contracts.select("tenant_id", "branch_id").distinct().groupBy("tenant_id").agg(F.array_sort(F.collect_list("branch_id")).alias("selected_branches"))
    cities = t.branches.join(t.tenants, "tenant_id").groupBy("tenant_id").agg(
        listed("branch_id", "branch_name", F.col("tenant_name").alias("city")).alias("branch_cities"))
    out = t.tenants
    for part in (guard, weights, selected, cities):
        out = out.join(part, "tenant_id", "left")
    return out.withColumn("active_guardrails", F.coalesce("active_guardrails", F.lit(0)))


register_view("feed_categories", fixed_table_sql("feed_categories"))
_CHANGED = f"FROM changes WHERE changed_on <= {AS_OF}"
register_view("vehicle_type_rows", f"""
    SELECT tenant_id, CAST(n % 7 AS INTEGER) AS category_id,
           list_extract([{", ".join(f"'{n}'" for n in CONFIGURED_TYPES)}], CAST(change_id % {len(CONFIGURED_TYPES)} + 1 AS INTEGER)) AS vehicle_type, status <> 'P' AS is_active
    {_CHANGED} {_LAST.format("tenant_id, n % 7")}""", ("changes",))
register_view("status_rows", f"""
    SELECT tenant_id, CAST(n % 17 + 140 AS INTEGER) AS status_id,
           list_extract([{", ".join(f"'{n}'" for n in STATUS_TYPES)}], CAST(change_id % {len(STATUS_TYPES)} + 1 AS INTEGER)) AS status_type, status <> 'P' AS is_active
    {_CHANGED} AND tenant_id % 2 = 1 {_LAST.format("tenant_id, n % 17")}""", ("changes",))


@query("cfg_05_tenants", with_views("""
    WITH used AS (SELECT tenant_id, status_id, status_type FROM status_rows WHERE is_active
      UNION ALL SELECT tenant_id, status_id, status_type FROM tenants, status_config WHERE tenant_id NOT IN (SELECT tenant_id FROM status_rows WHERE is_active))
    SELECT tenant_id, status_type, list_sort(list(status_id)) AS status_ids, count(*) AS n_statuses FROM used GROUP BY 1, 2""",
                                    "tenants", "status_rows", "status_config"))
def cfg_05_tenants(d):
    """CFG-05: each tenant's status lists by class; the default lists of a
    tenant that has configured none."""
    t = Tenants(d)
    config = t.statuses(P.RUN_DATE).where("is_active")
    return ut.status_groups(default_where_empty(config, d.fixed("status_config").select("status_id", "status_type"), t.tenants), ["tenant_id"])


@query("cmp_06_tenants", with_views(f"""
    SELECT c.tenant_id, c.category_id, coalesce(m.vehicle_type, '{DEFAULT_VEHICLE_TYPE}') AS vehicle_type, coalesce(f.feed_category, '{DEFAULT_COMPETITOR_TYPE}') AS feed_category
    FROM (SELECT DISTINCT tenant_id, category_id FROM t_vehicles) c
    LEFT JOIN vehicle_type_rows m ON m.is_active AND m.tenant_id = c.tenant_id AND m.category_id = c.category_id
    LEFT JOIN feed_categories f ON f.vehicle_type = lower(coalesce(m.vehicle_type, '{DEFAULT_VEHICLE_TYPE}'))""", "t_vehicles", "vehicle_type_rows", "feed_categories"))
def cmp_06_tenants(d):
    """CMP-06: each tenant's category, its configured vehicle type and the feed's category of that type."""
    t = Tenants(d)
    cells = t.vehicles.select("tenant_id", "category_id").distinct()
    return feed_categories(cells, t.vehicle_types(P.RUN_DATE), d.fixed("feed_categories"), DEFAULT_VEHICLE_TYPE, DEFAULT_COMPETITOR_TYPE)


def _level(cols: str) -> str:
    on = " AND ".join(["g.tenant_id = c.tenant_id"] + [f"g.{x} = c.{y}" for x, y in (("of_branch", "branch_id"), ("of_category", "category_id")) if y in cols]
                      + [f"g.{x} IS NULL" for x, y in (("of_branch", "branch_id"), ("of_category", "category_id")) if y not in cols])
    return f"LEFT JOIN guardrail_rows g ON g.is_active AND {on}"


def _field(name: str, default: str, generic: float) -> str:
    found = " ".join(f"WHEN l{i}.tenant_id IS NOT NULL THEN coalesce(nullif(l{i}.{name}, 0), {generic})" for i in range(4))
    return f"CASE {found} ELSE coalesce(k.{default}, {generic}) END AS guardrail_{name}"


register_view("t_guardrails", f"""
    SELECT c.tenant_id, c.branch_id, c.category_id, {_field('min_price', 'default_min_price', GENERIC_GUARDRAIL[0])},
           {_field('max_discount_pct', 'default_max_discount_pct', GENERIC_GUARDRAIL[1])}, {_field('max_premium_pct', 'default_max_premium_pct', GENERIC_GUARDRAIL[2])}
    FROM (SELECT tenant_id, branch_id, category_id FROM t_branches, categories) c
    {" ".join(_level(cols).replace(" g ", f" l{i} ").replace("g.", f"l{i}.") for i, cols in enumerate(("branch_id category_id", "branch_id", "category_id", "")))}
    LEFT JOIN categories k USING (category_id)""", ("t_branches", "categories", "guardrail_rows"))

@query("prc_02_tenants", with_views("SELECT * FROM t_guardrails", "t_guardrails"))
def prc_02_tenants(d):
    """PRC-02: every tenant's guardrails in force per branch and category; zero
    and NULL fields of a row count as missing."""
    t = Tenants(d)
    cells = rc.cell_grid(t.branches, [c[0] for c in CATEGORIES])
    return rc.resolve_guardrails(cells, t.guardrails(P.RUN_DATE), d.categories, GENERIC_GUARDRAIL).drop("guardrail_max_price")


_HALF_UP = "CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) AS DECIMAL(18,0))"


@query("prc_01_decimal", with_views(f"""
    WITH x AS (SELECT h.source_id, CAST(h.rec_daily AS DECIMAL(18,4)) AS base, CAST(h.premium_discount_pct AS DECIMAL(8,4)) AS raw,
        CAST(guardrail_min_price AS DECIMAL(10,2)) AS low, CAST(guardrail_max_discount_pct AS DECIMAL(8,4)) AS down, CAST(guardrail_max_premium_pct AS DECIMAL(8,4)) AS up
      FROM (SELECT source_id, branch_id, category_id, rec_daily, premium_discount_pct FROM rec_history) h JOIN t_guardrails g USING (branch_id, category_id)),
    c AS (SELECT *, CASE WHEN raw > up THEN up WHEN raw < -down THEN CAST(-down AS DECIMAL(8,4)) ELSE raw END AS capped FROM x),
    p AS (SELECT *, base * CAST(100 + capped AS DECIMAL(9,4)) AS free,
        CAST(low * 10000 AS HUGEINT) AS li, CAST(base * 10000 AS HUGEINT) AS bi FROM c)
    SELECT source_id, base AS base_daily, raw AS raw_adjustment_pct,
      CAST(CASE WHEN free < low * 100 THEN low ELSE round(free * CAST(0.01 AS DECIMAL(3,2)), 2) END AS DECIMAL(10,2)) AS rec_daily,
      TRY_CAST(CASE WHEN free < low * 100 THEN CASE WHEN bi > 0 THEN {_HALF_UP.format(n="((li - bi) * 1000000)", d="bi")} * CAST(0.0001 AS DECIMAL(5,4)) END ELSE capped END AS DECIMAL(8,4))
        AS premium_discount_pct,
      raw > up OR raw < -down OR free < low * 100 AS guardrail_applied
    FROM p""", "rec_history", "t_guardrails"))
def prc_01_decimal(d):
    """PRC-01 in decimals: recorded rates and adjustments, clamped by the tenants'
    guardrails in force; money decimal(18,4) and (10,2), percentages (8,4)."""
    t = Tenants(d)
    cells = rc.cell_grid(t.branches, [c[0] for c in CATEGORIES])
    guard = rc.resolve_guardrails(cells, t.guardrails(P.RUN_DATE), d.categories, GENERIC_GUARDRAIL).drop("tenant_id")
    recs = d.rec_history.select("source_id", "branch_id", "category_id", "rec_daily", "premium_discount_pct").join(guard, ["branch_id", "category_id"])
    c = sg.clamp_price_decimal("rec_daily", "premium_discount_pct", "guardrail_min_price", "guardrail_max_discount_pct", "guardrail_max_premium_pct")
    return recs.select("source_id", F.col("rec_daily").cast(sg.BASE).alias("base_daily"), F.col("premium_discount_pct").cast(sg.PERCENT).alias("raw_adjustment_pct"),
                       c["price"].alias("rec_daily"), c["pct"].alias("premium_discount_pct"), c["applied"].alias("guardrail_applied"))
