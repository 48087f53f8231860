"""Queries for profiles, summaries, top-k lists, set operations, scope
filters and lookup joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd, rnd_sql as R
from ratewise.functions.text import localized_name
from ratewise.operators import demand as dm
from ratewise.operators import features as fe
from ratewise.operators import forecast as fc
from ratewise.operators import rates as rt
from ratewise.operators import recommend as rc
from ratewise.plans import params as P
from ratewise.plans import workflow_plans  # noqa: F401
from ratewise.plans.competitor_plans import _quotes, comp_index
from ratewise.plans.feature_plans import _fact_split, _fs
from ratewise.plans.forecast_plans import forecast_runs
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.recommend_plans import guardrail_config
from ratewise.plans.registry import query
from ratewise.sinks import io
from ratewise.sources.fixed import CATEGORIES

RENT = "(SELECT * FROM contracts WHERE status_id = 211)"
NOW = dt.datetime(2001, 6, 30, 12, 0, 0)


def _rentals(d):
    return dm.with_category(dm.executed_rentals(d.contracts, tenant_id=d.tenant_id), d.vehicles)


# ---- forecast / competitor / config summaries ----------------------------------

@query("agg_15", with_views(f"""
    SELECT tenant_id, max(run_date) AS latest_run, count(DISTINCT branch_id) AS branches,
           count(DISTINCT category_id) AS categories, count(*) AS forecast_rows,
           min(forecast_date) AS min_date, max(forecast_date) AS max_date,
           {R('avg(forecast_demand)', 4)} AS avg_forecast, max(model_name) AS model_name
    FROM forecast_runs WHERE run_date = (SELECT max(run_date) FROM forecast_runs) GROUP BY tenant_id""",
                            "forecast_runs"))
def agg_15(d):
    """AGG-15: forecast summary of the latest run."""
    f = rc.latest_run(forecast_runs(d), ["tenant_id"])
    return f.groupBy("tenant_id").agg(
        F.max("run_date").alias("latest_run"), F.countDistinct("branch_id").alias("branches"),
        F.countDistinct("category_id").alias("categories"), F.count(F.lit(1)).alias("forecast_rows"),
        F.min("forecast_date").alias("min_date"), F.max("forecast_date").alias("max_date"),
        rnd(F.avg("forecast_demand"), 4).alias("avg_forecast"), F.max("model_name").alias("model_name"))


@query("agg_16", with_views(f"""
    SELECT tenant_id, min(forecast_demand) AS min_forecast, max(forecast_demand) AS max_forecast,
           {R('avg(forecast_demand)', 4)} AS avg_forecast, {R('stddev_samp(forecast_demand)', 4)} AS std_forecast,
           count(DISTINCT horizon_day) AS horizons
    FROM forecast_runs WHERE run_date = (SELECT max(run_date) FROM forecast_runs) GROUP BY tenant_id""",
                            "forecast_runs"))
def agg_16(d):
    """AGG-16: forecast distribution check (sample stddev, horizons)."""
    f = rc.latest_run(forecast_runs(d), ["tenant_id"])
    return f.groupBy("tenant_id").agg(
        F.min("forecast_demand").alias("min_forecast"), F.max("forecast_demand").alias("max_forecast"),
        rnd(F.avg("forecast_demand"), 4).alias("avg_forecast"),
        rnd(F.stddev_samp("forecast_demand"), 4).alias("std_forecast"),
        F.countDistinct("horizon_day").alias("horizons"))


@query("agg_17", with_views(f"""
    SELECT i.category_id, count(*) AS index_rows, min(i.index_date) AS min_date, max(i.index_date) AS max_date,
           {R('avg(i.competitor_avg_price)', 4)} AS avg_competitor_price,
           (SELECT count(*) FROM competitor_mapping) AS active_mappings, coalesce(max(l.n), 0) AS live_quotes
    FROM comp_index i LEFT JOIN (
        SELECT m.category_id, count(*) AS n FROM quotes q JOIN competitor_mapping m ON m.competitor_vehicle_type = q.category
        WHERE CAST(q.price_date AS TIMESTAMP) + INTERVAL 24 HOUR > TIMESTAMP '{NOW}' GROUP BY 1) l
      ON l.category_id = i.category_id
    GROUP BY i.category_id""", "comp_index", "competitor_mapping", "quotes"))
def agg_17(d):
    """AGG-17: competitor summary: index rows, range and mean price per
    category, with the number of active mappings and of quotes still live."""
    from ratewise.operators.competitor import live_quotes
    from ratewise.plans.competitor_plans import window_quotes
    q = window_quotes(d, NOW.date() - dt.timedelta(days=1), None).withColumn("fetched_at", F.col("price_date").cast("timestamp"))
    m = d.fixed("competitor_mapping").select("category_id", F.col("competitor_vehicle_type").alias("category"))
    live = live_quotes(q, NOW).groupBy("category").agg(F.count(F.lit(1)).alias("live_quotes")).join(F.broadcast(m), "category")
    n_map = d.fixed("competitor_mapping").agg(F.count(F.lit(1)).alias("active_mappings")).select(
        F.lit(d.tenant_id).alias("tenant_id"), "active_mappings")
    g = comp_index(d).groupBy("tenant_id", "category_id").agg(
        F.count(F.lit(1)).alias("index_rows"), F.min("index_date").alias("min_date"),
        F.max("index_date").alias("max_date"),
        rnd(F.avg("competitor_avg_price"), 4).alias("avg_competitor_price"))
    g = g.join(live.select("category_id", "live_quotes"), "category_id", "left")
    return g.join(F.broadcast(n_map), "tenant_id").drop("tenant_id").withColumn(
        "live_quotes", F.coalesce("live_quotes", F.lit(0)))


# ---- contract profiles ---------------------------------------------------------

@query("agg_20", with_views("""
    SELECT tenant_id, contract_type, status_id, CAST(year(start_date) AS INTEGER) AS yr,
           CAST(month(start_date) AS INTEGER) AS mon, count(*) AS contracts
    FROM contracts GROUP BY 1, 2, 3, 4, 5""", "contracts"))
def agg_20(d):
    """AGG-20: volume profile by contract type, status and month."""
    c = d.contracts
    return c.groupBy("tenant_id", "contract_type", "status_id", F.year("start_date").alias("yr"),
                     F.month("start_date").alias("mon")).agg(F.count(F.lit(1)).alias("contracts"))


@query("agg_21", with_views(f"""
    SELECT tenant_id, count(*) AS contracts, min(start_date) AS first_start, max(start_date) AS last_start,
           {R('min(daily_rate)', 4)} AS min_rate, {R('max(daily_rate)', 4)} AS max_rate,
           {R('avg(daily_rate)', 2)} AS avg_rate
    FROM {RENT} GROUP BY tenant_id""", "contracts"))
def agg_21(d):
    """AGG-21: date range and rate profile of executed contracts."""
    c = dm.executed_rentals(d.contracts)
    return c.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("contracts"), F.min("start_date").alias("first_start"),
        F.max("start_date").alias("last_start"), rnd(F.min("daily_rate"), 4).alias("min_rate"),
        rnd(F.max("daily_rate"), 4).alias("max_rate"), rnd(F.avg("daily_rate"), 2).alias("avg_rate"))


@query("agg_22", with_views("""
    SELECT tenant_id, count(*) AS grain_cells FROM (SELECT DISTINCT tenant_id, start_date, branch_id, category_id
                                                    FROM rentals) GROUP BY tenant_id""", "rentals"))
def agg_22(d):
    """AGG-22: number of distinct date x branch x category combinations."""
    g = _rentals(d).select("tenant_id", "start_date", "branch_id", "category_id").distinct()
    return g.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("grain_cells"))


# ---- top-k -----------------------------------------------------------------------

@query("top_01", with_views("""
    SELECT branch_id, count(*) AS rentals FROM rentals GROUP BY branch_id
    ORDER BY rentals DESC, branch_id LIMIT 15""", "rentals"))
def top_01(d):
    """TOP-01: the 15 branches with the most executed rentals."""
    n = _rentals(d).groupBy("branch_id").agg(F.count(F.lit(1)).alias("rentals"))
    return n.orderBy(F.col("rentals").desc(), "branch_id").limit(15)


@query("top_01_models", with_views("""
    SELECT model_id, count(*) AS rentals FROM rentals GROUP BY model_id
    ORDER BY rentals DESC, model_id LIMIT 15""", "rentals"))
def top_01_models(d):
    """TOP-01: the 15 vehicle models with the most executed rentals."""
    n = _rentals(d).groupBy("model_id").agg(F.count(F.lit(1)).alias("rentals"))
    return n.orderBy(F.col("rentals").desc(), "model_id").limit(15)


@query("top_01_categories", with_views("""
    SELECT category_id, count(*) AS rentals FROM rentals GROUP BY category_id
    ORDER BY rentals DESC, category_id LIMIT 15""", "rentals"))
def top_01_categories(d):
    """TOP-01: the 15 categories with the most executed rentals."""
    n = _rentals(d).groupBy("category_id").agg(F.count(F.lit(1)).alias("rentals"))
    return n.orderBy(F.col("rentals").desc(), "category_id").limit(15)


@query("win_16", with_views("""
    SELECT branch_id, is_airport, rentals, rk FROM (
      SELECT r.branch_id, b.is_airport, count(*) AS rentals,
             CAST(rank() OVER (PARTITION BY b.is_airport ORDER BY count(*) DESC, r.branch_id) AS INTEGER) AS rk
      FROM rentals r JOIN branches b ON b.branch_id = r.branch_id GROUP BY r.branch_id, b.is_airport)
    WHERE rk <= 3""", "rentals", "branches"))
def win_16(d):
    """WIN-16: top 3 airport and top 3 city branches by executed volume."""
    return _top_branches(d)


def _top_branches(d, k=3):
    n = _rentals(d).groupBy("branch_id").agg(F.count(F.lit(1)).alias("rentals"))
    n = n.join(F.broadcast(d.branches.select("branch_id", "is_airport")), "branch_id")
    w = Window.partitionBy("is_airport").orderBy(F.col("rentals").desc(), "branch_id")
    return n.withColumn("rk", F.rank().over(w)).where(F.col("rk") <= k).select(
        "branch_id", "is_airport", "rentals", "rk")


TOPCAT = """(SELECT category_id FROM (SELECT category_id, rank() OVER (ORDER BY count(*) DESC, category_id) AS rk
             FROM rentals GROUP BY category_id) WHERE rk <= 3)"""
TOPBR = """(SELECT branch_id FROM (SELECT r.branch_id, rank() OVER (PARTITION BY b.is_airport
             ORDER BY count(*) DESC, r.branch_id) AS rk FROM rentals r JOIN branches b ON b.branch_id = r.branch_id
             GROUP BY r.branch_id, b.is_airport) WHERE rk <= 3)"""


@query("flt_04", with_views(f"""
    SELECT * FROM fact WHERE branch_id IN {TOPBR} AND category_id IN {TOPCAT}""", "fact", "rentals", "branches"))
def flt_04(d):
    """FLT-04: the demand fact restricted to the scope (top branches per
    class x top categories) with semi joins."""
    from ratewise.plans.rate_plans import _top_categories
    return dm.build_daily_demand(d, scope_branches=_top_branches(d), scope_categories=_top_categories(d))


@query("win_01", with_views(f"""
    SELECT 1 AS tenant_id, 'branch' AS selection_type, branch_id AS item_id,
           CAST(row_number() OVER (ORDER BY branch_id) AS INTEGER) AS rank_order FROM {TOPBR}""",
                            "rentals", "branches"))
def win_01(d):
    """WIN-01 / CFG-04: seed the branch selection with a rank by id."""
    t = _top_branches(d).select(F.lit(d.tenant_id).alias("tenant_id"), F.lit("branch").alias("selection_type"),
                                F.col("branch_id").alias("item_id"))
    w = Window.partitionBy("tenant_id").orderBy("item_id")
    return t.withColumn("rank_order", F.row_number().over(w))


@query("top_05", with_views(f"""
    SELECT tenant_id, branch_id, category_id, demand_date, executed_rentals_count, split_flag
    FROM feature_store WHERE split_flag = 'TRAIN' ORDER BY demand_date, branch_id, category_id LIMIT 100""",
                            "feature_store"))
def top_05(d):
    """TOP-05: first page (100 rows) of the training data, by date, branch, category."""
    f = _fact_split(d).where(F.col("split_flag") == "TRAIN")
    return f.select("tenant_id", "branch_id", "category_id", "demand_date", "executed_rentals_count",
                    "split_flag").orderBy("demand_date", "branch_id", "category_id").limit(100)


def _evaluations(d):
    """Evaluations of the models at two cutoffs, a horizon apart."""
    total = io.materialize(fc.total_demand(_fact_split(d)), "total")
    earlier, latest = (fc.backtest(total, day, P.HORIZON).withColumn("evaluation_date", F.lit(day))
                       for day in (P.SPLIT_CUTOFF - dt.timedelta(days=P.HORIZON), P.SPLIT_CUTOFF))
    return earlier.unionByName(latest)


@query("top_06", with_views(f"""
    SELECT *, DATE '{P.SPLIT_CUTOFF}' AS selection_date FROM best_model""", "best_model"))
def top_06(d):
    """TOP-06: best model = minimum MAE of each evaluation; the latest
    selection."""
    best = fc.select_best(_evaluations(d), ["tenant_id", "evaluation_date"])
    return best.groupBy("tenant_id").agg(
        F.max_by(F.struct("selected_model", "metric_value"), "evaluation_date").alias("x"),
        F.max("evaluation_date").alias("selection_date")).select("tenant_id", "x.*", "selection_date")


@query("top_07", with_views(f"""
    SELECT *, DATE '{P.SPLIT_CUTOFF}' AS evaluation_date FROM backtest""", "backtest"))
def top_07(d):
    """TOP-07: metrics of the latest evaluation ordered by MAE."""
    return rc.latest_run(_evaluations(d), ["tenant_id"], "evaluation_date").orderBy("mae", "model_name")


# ---- set operations -----------------------------------------------------------

@query("set_01", with_views("""
    SELECT 'contracts' AS label, count(*) AS n FROM contracts
    UNION ALL SELECT 'executed', count(*) FROM contracts WHERE status_id = 211
    UNION ALL SELECT 'with_rate', count(*) FROM contracts WHERE daily_rate > 0""", "contracts"))
def set_01(d):
    """SET-01: UNION ALL of labelled counts."""
    c = d.contracts
    a = c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("contracts").alias("label"), "n")
    b = c.where(F.col("status_id") == 211).agg(F.count(F.lit(1)).alias("n")).select(F.lit("executed").alias("label"), "n")
    e = c.where(F.col("daily_rate") > 0).agg(F.count(F.lit(1)).alias("n")).select(F.lit("with_rate").alias("label"), "n")
    return a.unionByName(b).unionByName(e)


@query("set_02", with_views("""
    SELECT split_flag, count(*) AS n, CAST(sum(executed_rentals_count) AS BIGINT) AS rentals FROM (
      SELECT * FROM feature_store WHERE split_flag = 'TRAIN'
      UNION ALL SELECT * FROM feature_store WHERE split_flag = 'VALIDATION') GROUP BY split_flag""",
                            "feature_store"))
def set_02(d):
    """SET-02: TRAIN + VALIDATION concatenated as forecasting context."""
    f = _fact_split(d)
    ctx = f.where(F.col("split_flag") == "TRAIN").unionByName(f.where(F.col("split_flag") == "VALIDATION"))
    return ctx.groupBy("split_flag").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum("executed_rentals_count").alias("rentals"))


@query("set_03", with_views("SELECT DISTINCT tenant_id, branch_id, category_id FROM fact", "fact"))
def set_03(d):
    """SET-03: distinct series keys."""
    return dm.build_daily_demand(d).select("tenant_id", "branch_id", "category_id").distinct()


@query("set_03_kinds", with_views("""
    SELECT DISTINCT 'contract_type' AS kind, contract_type AS value FROM contracts
    UNION ALL SELECT DISTINCT 'contract_status', CAST(status_id AS VARCHAR) FROM contracts
    UNION ALL SELECT DISTINCT 'vehicle_status', CAST(status_id AS VARCHAR) FROM vehicles""", "contracts", "vehicles"))
def set_03_kinds(d):
    """SET-03: distinct contract types, contract statuses and vehicle statuses."""
    kinds = d.contracts.select(F.explode(F.array(
        F.struct(F.lit("contract_type").alias("kind"), F.col("contract_type").alias("value")),
        F.struct(F.lit("contract_status").alias("kind"), F.col("status_id").cast("string").alias("value")))).alias("k"))
    vehicles = d.vehicles.select(F.lit("vehicle_status").alias("kind"), F.col("status_id").cast("string").alias("value"))
    return kinds.select("k.*").distinct().unionByName(vehicles.distinct())


@query("set_04", with_views("""
    SELECT c.tenant_id, c.branch_id, c.category_id FROM cells c
    WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.tenant_id = c.tenant_id AND f.branch_id = c.branch_id
                      AND f.category_id = c.category_id)""", "cells", "fact"))
def set_04(d):
    """SET-04: expected series (branch x category) minus the ones with demand."""
    grid = rc.cell_grid(d.branches, [c[0] for c in CATEGORIES])
    have = dm.build_daily_demand(d).select("tenant_id", "branch_id", "category_id")
    return grid.join(have, ["tenant_id", "branch_id", "category_id"], "left_anti")


@query("prj_04", with_views("""
    SELECT CASE WHEN r.model_id IS NOT NULL THEN 'Has Rate' ELSE 'No Rate' END AS bucket, count(*) AS models
    FROM (SELECT DISTINCT model_id FROM vehicles) m
    LEFT JOIN (SELECT DISTINCT model_id FROM eff_rates WHERE branch_id IS NULL) r ON r.model_id = m.model_id
    GROUP BY 1""", "vehicles", "eff_rates"))
def prj_04(d):
    """PRJ-04: completeness buckets -- models with / without a default rate."""
    m = d.vehicles.select("model_id").distinct()
    r = rt.effective_on(d.rates, P.RATE_DATE).where(F.col("branch_id").isNull()).select(
        F.col("model_id").alias("r_model")).distinct()
    j = m.join(r, m.model_id == r.r_model, "left")
    b = F.when(F.col("r_model").isNotNull(), F.lit("Has Rate")).otherwise(F.lit("No Rate"))
    return j.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("models"))


# ---- filters and lookup joins ----------------------------------------------------

@query("flt_06", with_views(f"""
    SELECT holiday_date, holiday_name, CAST(year(holiday_date) AS INTEGER) AS yr FROM holidays
    WHERE holiday_date BETWEEN DATE '{P.SPLIT_CUTOFF}' AND DATE '{P.SPLIT_CUTOFF}' + 365""", "holidays"))
def flt_06(d):
    """FLT-06: holidays within today .. today + 365 days."""
    h = d.holidays.where(F.col("holiday_date").between(F.lit(P.SPLIT_CUTOFF),
                                                       F.date_add(F.lit(P.SPLIT_CUTOFF), 365)))
    return h.select("holiday_date", "holiday_name", F.year("holiday_date").alias("yr"))


@query("flt_07", with_views(f"""
    SELECT quote_id, price_date, CAST(price_date AS TIMESTAMP) + INTERVAL 24 HOUR AS expires_at FROM quotes
    WHERE CAST(price_date AS TIMESTAMP) + INTERVAL 24 HOUR > TIMESTAMP '{NOW}'""", "quotes"))
def flt_07(d):
    """FLT-07 / CMP-10: quotes still live (fetched + 24 h > now)."""
    from ratewise.operators.competitor import live_quotes
    q = _quotes(d).withColumn("fetched_at", F.col("price_date").cast("timestamp"))
    return live_quotes(q, NOW).select("quote_id", "price_date", "expires_at")


@query("flt_08", with_views("""
    SELECT c.branch_id, c.category_id, g.guardrail_id FROM fleet_size c JOIN guardrail_config g
      ON (g.category_id = c.category_id OR g.category_id IS NULL)
     AND (g.branch_id = c.branch_id OR g.branch_id IS NULL)""", "fleet_size", "guardrail_config"))
def flt_08(d):
    """FLT-08: configuration rows visible to each fleet cell (NULL = all)."""
    from ratewise.operators import utilization as ut
    cells = ut.fleet_size(d.vehicles).select("branch_id", "category_id")
    g = F.broadcast(d.fixed("guardrail_config").select("guardrail_id", F.col("category_id").alias("g_cat"),
                                                        F.col("branch_id").alias("g_br")))
    cond = ((F.col("g_cat") == F.col("category_id")) | F.col("g_cat").isNull()) & \
           ((F.col("g_br") == F.col("branch_id")) | F.col("g_br").isNull())
    return cells.join(g, cond).select("branch_id", "category_id", "guardrail_id")


@query("cfg_01", with_views("""
    SELECT c.branch_id, c.category_id, g.guardrail_id, g.min_price,
           CAST(row_number() OVER (PARTITION BY c.branch_id, c.category_id
                              ORDER BY g.category_id DESC NULLS LAST, g.branch_id DESC NULLS LAST) AS INTEGER)
             AS precedence
    FROM fleet_size c JOIN guardrail_config g
      ON (g.category_id = c.category_id OR g.category_id IS NULL)
     AND (g.branch_id = c.branch_id OR g.branch_id IS NULL)""", "fleet_size", "guardrail_config"))
def cfg_01(d):
    """CFG-01: guardrails visible for each cell, most specific first."""
    from ratewise.operators import utilization as ut
    cells = ut.fleet_size(d.vehicles).select("branch_id", "category_id")
    g = F.broadcast(d.fixed("guardrail_config").select("guardrail_id", "min_price", F.col("category_id").alias("g_cat"),
                                                        F.col("branch_id").alias("g_br")))
    cond = ((F.col("g_cat") == F.col("category_id")) | F.col("g_cat").isNull()) & \
           ((F.col("g_br") == F.col("branch_id")) | F.col("g_br").isNull())
    j = cells.join(g, cond)
    w = Window.partitionBy("branch_id", "category_id").orderBy(F.col("g_cat").desc_nulls_last(),
                                                               F.col("g_br").desc_nulls_last())
    return j.select("branch_id", "category_id", "guardrail_id", "min_price",
                    F.row_number().over(w).alias("precedence"))


@query("prc_02_config", with_views("""
    SELECT c.tenant_id, c.branch_id, c.category_id, g.max_price AS guardrail_max_price,
           coalesce(g.min_price, k.default_min_price, 50.0) AS guardrail_min_price,
           coalesce(g.max_discount_pct, k.default_max_discount_pct, 25.0) AS guardrail_max_discount_pct,
           coalesce(g.max_premium_pct, k.default_max_premium_pct, 50.0) AS guardrail_max_premium_pct
    FROM fleet_size c
    LEFT JOIN (SELECT * FROM (
        SELECT f.tenant_id, f.branch_id, f.category_id, g.min_price, g.max_discount_pct, g.max_premium_pct, g.max_price,
               row_number() OVER (PARTITION BY f.tenant_id, f.branch_id, f.category_id ORDER BY
                 (CASE WHEN g.branch_id IS NOT NULL THEN 2 ELSE 0 END
                  + CASE WHEN g.category_id IS NOT NULL THEN 1 ELSE 0 END) DESC) AS rn
        FROM fleet_size f JOIN guardrail_config g
          ON (g.category_id = f.category_id OR g.category_id IS NULL)
         AND (g.branch_id = f.branch_id OR g.branch_id IS NULL)) WHERE rn = 1) g
      ON g.tenant_id = c.tenant_id AND g.branch_id = c.branch_id AND g.category_id = c.category_id
    LEFT JOIN categories k ON k.category_id = c.category_id""", "fleet_size", "guardrail_config", "categories"))
def prc_02_config(d):
    """PRC-02 with a guardrail configuration: most specific row (branch +
    category > branch > category > global), then category default."""
    from ratewise.operators import utilization as ut
    cells = ut.fleet_size(d.vehicles).select(*rc.CELL)
    return rc.resolve_guardrails(cells, guardrail_config(d), d.categories)


@query("jn_03", with_views("""
    SELECT f.branch_id, f.category_id, f.demand_date, f.executed_rentals_count,
           coalesce(CASE WHEN json_valid(b.branch_name) THEN json_extract_string(b.branch_name, '$.en') END,
                    b.branch_name) AS branch_label, b.city_name
    FROM fact f LEFT JOIN branches b ON b.tenant_id = f.tenant_id AND b.branch_id = f.branch_id""",
                           "fact", "branches"))
def jn_03(d):
    """JN-03: left lookup join of the fact to branch names and cities."""
    b = d.branches.select("tenant_id", "branch_id", localized_name("branch_name", "en").alias("branch_label"),
                          "city_name")
    f = dm.build_daily_demand(d)
    return f.join(F.broadcast(b), ["tenant_id", "branch_id"], "left").select(
        "branch_id", "category_id", "demand_date", "executed_rentals_count", "branch_label", "city_name")


@query("jn_05", with_views("""
    SELECT tenant_id, branch_id, category_id, demand_date, temperature_max, precipitation_mm, event_score,
           is_public_holiday FROM feature_store""", "feature_store"))
def jn_05(d):
    """JN-05: update-from-join enrichment (weather, holidays, events) as
    left joins to de-duplicated side tables."""
    f = dm.build_daily_demand(d)
    f = fe.enrich_events(fe.enrich_holidays(fe.enrich_weather(f, d.weather), d.holidays), d.event_signal, d.branches)
    return f.select("tenant_id", "branch_id", "category_id", "demand_date", "temperature_max", "precipitation_mm",
                    "event_score", "is_public_holiday")


@query("jn_09", with_views("""
    SELECT c.branch_id, c.category_id, b.city_name, k.category_name FROM cells c
    JOIN branches b ON b.branch_id = c.branch_id JOIN categories k ON k.category_id = c.category_id
    WHERE c.branch_id IN (SELECT branch_id FROM contracts)""", "cells", "branches", "categories", "contracts"))
def jn_09(d):
    """JN-09: branch x category label grid for the branches with contracts."""
    act = d.contracts.select("branch_id").distinct()
    br = d.branches.join(act, "branch_id", "left_semi")
    g = rc.cell_grid(br, [c[0] for c in CATEGORIES])
    return g.join(F.broadcast(br.select("branch_id", "city_name")), "branch_id").join(
        F.broadcast(d.categories.select("category_id", "category_name")), "category_id").select(
        "branch_id", "category_id", "city_name", "category_name")


register_view("contract_items", f"""
    SELECT l_orderkey * 10 + l_linenumber AS contract_id, 1 AS item_type_id, 'Trip days' AS item_name,
           l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS total_price
    FROM lineitem
    UNION ALL
    SELECT l_orderkey * 10 + l_linenumber, 2, 'Tax', 1.0, l_extendedprice * l_tax, l_extendedprice * l_tax
    FROM lineitem""")


@query("jn_13", with_views(f"""
    SELECT c.contract_id, c.daily_rate, i.unit_price AS base_item_price, i.quantity,
           {R('i.unit_price - c.daily_rate', 4)} AS price_gap
    FROM {RENT} c JOIN contract_items i ON i.contract_id = c.contract_id WHERE i.item_type_id = 1""",
                           "contracts", "contract_items"))
def jn_13(d):
    """JN-13: contract -> payment item join on the base-price item."""
    items = _items(d).where(F.col("item_type_id") == 1)
    c = dm.executed_rentals(d.contracts)
    j = c.join(items, "contract_id")
    return j.select("contract_id", "daily_rate", F.col("unit_price").alias("base_item_price"), "quantity",
                    rnd(F.col("unit_price") - F.col("daily_rate"), 4).alias("price_gap"))


def _items(d):
    """Payment items of the contracts: trip days and tax of each."""
    items = d.t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contract_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("item_type_id"), F.lit("Trip days").alias("item_name"),
                 F.col("l_quantity").alias("quantity"),
                 (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")),
        F.struct(F.lit(2).alias("item_type_id"), F.lit("Tax").alias("item_name"), F.lit(1.0).alias("quantity"),
                 (F.col("l_extendedprice") * F.col("l_tax")).alias("unit_price")))).alias("i"))
    return items.select("contract_id", "i.*")


@query("agg_20_items", with_views("""
    SELECT item_type_id, item_name, c.contract_type, count(*) AS items, count(DISTINCT c.branch_id) AS branches
    FROM contract_items i JOIN contracts c ON c.contract_id = i.contract_id GROUP BY 1, 2, 3""",
                                  "contract_items", "contracts"))
def agg_20_items(d):
    """AGG-20: volume profile by item type and contract type."""
    c = d.contracts.select("contract_id", "contract_type", "branch_id")
    return _items(d).join(c, "contract_id").groupBy("item_type_id", "item_name", "contract_type").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("branch_id").alias("branches"))
