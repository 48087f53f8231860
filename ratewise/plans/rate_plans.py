"""Queries for base rates and fleet utilization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.mathx import cents_avg_sql, rnd_sql as R
from ratewise.operators import demand as dm
from ratewise.operators import intervals as iv
from ratewise.operators import rates as rt
from ratewise.operators import utilization as ut
from ratewise.plans import feature_plans  # noqa: F401  (registers shared views)
from ratewise.plans import params as P
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sources.fixed import CATEGORIES

DAY = f"DATE '{P.RATE_DATE}'"
DAILY = "(to_days = 6 OR (to_days IS NULL AND from_days = 1))"
WEEKLY = "(from_days = 7 AND to_days = 27)"
MONTHLY = "(from_days = 28 AND to_days IS NULL)"

register_view("eff_rates", f"""
    SELECT * FROM rates WHERE is_active AND start_date <= {DAY} AND (end_date IS NULL OR end_date >= {DAY})""",
              ("rates",))
register_view("rate_lines", """
    SELECT r.*, d.period_id, d.rate, b.from_days, b.to_days
    FROM eff_rates r JOIN rate_details d ON r.rate_id = d.rate_id
    JOIN rate_bands b ON d.period_id = b.period_id""", ("eff_rates", "rate_details", "rate_bands"))


def _pivot(fn: str = "avg", digits: int = 4) -> str:
    agg = (lambda e: cents_avg_sql(e)) if fn == "avg" else (lambda e: f"{fn}({e})")
    return (f"{R(agg(f'CASE WHEN {DAILY} THEN rate END'), digits)} AS daily_rate, "
            f"{R(agg(f'CASE WHEN {WEEKLY} THEN rate END'), digits)} AS weekly_rate, "
            f"{R(agg(f'CASE WHEN {MONTHLY} THEN rate END'), digits)} AS monthly_rate")


register_view("category_prices", f"""
    WITH spec AS (SELECT tenant_id, branch_id, category_id, {_pivot()}, count(DISTINCT model_id) AS model_count
                  FROM rate_lines WHERE branch_id IS NOT NULL GROUP BY 1, 2, 3),
         dflt AS (SELECT tenant_id, category_id, {_pivot()}, count(DISTINCT model_id) AS model_count
                  FROM rate_lines WHERE branch_id IS NULL GROUP BY 1, 2),
         grid AS (SELECT b.tenant_id, b.branch_id, c.category_id FROM branches b CROSS JOIN categories c)
    SELECT g.tenant_id, g.branch_id, g.category_id,
           CASE WHEN s.model_count IS NOT NULL THEN s.daily_rate ELSE d.daily_rate END AS daily_rate,
           CASE WHEN s.model_count IS NOT NULL THEN s.weekly_rate ELSE d.weekly_rate END AS weekly_rate,
           CASE WHEN s.model_count IS NOT NULL THEN s.monthly_rate ELSE d.monthly_rate END AS monthly_rate,
           CASE WHEN s.model_count IS NOT NULL THEN s.model_count ELSE d.model_count END AS model_count,
           CASE WHEN s.model_count IS NOT NULL THEN 'branch_specific'
                WHEN d.model_count IS NOT NULL THEN 'default' END AS source
    FROM grid g
    LEFT JOIN spec s ON s.tenant_id = g.tenant_id AND s.branch_id = g.branch_id AND s.category_id = g.category_id
    LEFT JOIN dflt d ON d.tenant_id = g.tenant_id AND d.category_id = g.category_id
    WHERE s.model_count IS NOT NULL OR d.model_count IS NOT NULL""",
              ("rate_lines", "branches", "categories"))


def _eff(d):
    return rt.effective_on(d.rates, P.RATE_DATE)


def _lines(d):
    return rt.rate_lines(_eff(d), d.rate_details, d.fixed("rate_bands"))


def _cat_prices(d):
    if "_cat_prices" not in d.__dict__:
        d.__dict__["_cat_prices"] = rt.category_prices_with_fallback(
            d.rates, d.rate_details, d.fixed("rate_bands"), d.branches, d.categories, P.RATE_DATE)
    return d.__dict__["_cat_prices"]


@query("flt_02", with_views("SELECT rate_id, model_id, category_id, branch_id, start_date, end_date FROM eff_rates",
                            "eff_rates"))
def flt_02(d):
    """FLT-02: rates effective on a date (open end counts as effective)."""
    return _eff(d).select("rate_id", "model_id", "category_id", "branch_id", "start_date", "end_date")


_DAYS = f"SELECT CAST(DATE '{P.PRICED_FROM}' + CAST(range AS INTEGER) AS DATE) AS price_date FROM range({(P.PRICED_TO - P.PRICED_FROM).days + 1})"


@query("flt_02_days", with_views(f"""
    SELECT rate_id, branch_id, category_id, price_date FROM ({_DAYS}) JOIN rates
      ON is_active AND start_date <= price_date AND (end_date IS NULL OR end_date >= price_date)""", "rates"))
def flt_02_days(d):
    """FLT-02 on many dates: the rates in force on every day of two months,
    by a range join."""
    low, high = P.PRICED_FROM, P.PRICED_TO
    days = d.branches.select("tenant_id").distinct().withColumn("price_date", F.explode(F.sequence(F.lit(low), F.lit(high))))
    active = d.rates.where("is_active").select("tenant_id", "rate_id", "branch_id", "category_id", "start_date", "end_date")
    held = iv.interval_join(days, active, "price_date", "start_date", "end_date", low, high, ("tenant_id",))
    return held.select("rate_id", "branch_id", "category_id", "price_date")


@query("flt_02_prices", with_views(f"""
    lines AS (SELECT r.tenant_id, r.branch_id, r.category_id, r.model_id, d.rate, b.from_days, b.to_days, price_date
      FROM ({_DAYS}) JOIN rates r ON r.is_active AND r.start_date <= price_date AND (r.end_date IS NULL OR r.end_date >= price_date)
      JOIN rate_details d ON r.rate_id = d.rate_id JOIN rate_bands b ON d.period_id = b.period_id),
    spec AS (SELECT tenant_id, branch_id, category_id, price_date, {_pivot()}, count(DISTINCT model_id) AS model_count
      FROM lines WHERE branch_id IS NOT NULL GROUP BY 1, 2, 3, 4),
    dflt AS (SELECT tenant_id, category_id, price_date, {_pivot()}, count(DISTINCT model_id) AS model_count
      FROM lines WHERE branch_id IS NULL GROUP BY 1, 2, 3),
    grid AS (SELECT b.tenant_id, b.branch_id, c.category_id, price_date FROM branches b, categories c, ({_DAYS}))
    SELECT g.*, CASE WHEN s.model_count IS NOT NULL THEN s.daily_rate ELSE d.daily_rate END AS daily_rate,
      CASE WHEN s.model_count IS NOT NULL THEN s.weekly_rate ELSE d.weekly_rate END AS weekly_rate,
      CASE WHEN s.model_count IS NOT NULL THEN s.monthly_rate ELSE d.monthly_rate END AS monthly_rate,
      coalesce(s.model_count, d.model_count) AS model_count,
      CASE WHEN s.model_count IS NOT NULL THEN 'branch_specific' ELSE 'default' END AS source
    FROM grid g LEFT JOIN spec s USING (tenant_id, branch_id, category_id, price_date)
    LEFT JOIN dflt d USING (tenant_id, category_id, price_date)
    WHERE s.model_count IS NOT NULL OR d.model_count IS NOT NULL""".replace("    lines AS", "WITH lines AS", 1),
    "rates", "rate_details", "rate_bands", "branches", "categories"))
def flt_02_prices(d):
    """FLT-02 on many dates: base prices of every branch and category on every
    day of two months, in one plan."""
    cells = d.branches.select("tenant_id", "branch_id", F.explode(F.array(*[F.lit(c[0]) for c in CATEGORIES])).alias("category_id"))
    return rt.prices_by_day(d.rates, d.rate_details, d.fixed("rate_bands"), cells, P.PRICED_FROM, P.PRICED_TO)


@query("flt_05", with_views("""
    SELECT rate_id, model_id, category_id, start_date, end_date FROM eff_rates WHERE branch_id IS NULL""",
                            "eff_rates"))
def flt_05(d):
    """FLT-05: default (branch IS NULL) rates as opposed to branch-specific."""
    return _eff(d).where(F.col("branch_id").isNull()).select(
        "rate_id", "model_id", "category_id", "start_date", "end_date")


@query("jn_02", with_views("""
    SELECT rate_id, period_id, model_id, category_id, branch_id, from_days, to_days, rate FROM rate_lines""",
                           "rate_lines"))
def jn_02(d):
    """JN-02: rate x period x detail composite-key join."""
    return _lines(d).select("rate_id", "period_id", "model_id", "category_id", "branch_id",
                            "from_days", "to_days", "rate")


@query("prj_01", with_views(f"SELECT rate_id, {_pivot('max', 2)} FROM rate_lines GROUP BY rate_id", "rate_lines"))
def prj_01(d):
    """PRJ-01: band -> daily / weekly / monthly column per rate."""
    return rt.period_pivot(_lines(d), ["rate_id"], F.max, 2)


@query("agg_06", with_views("SELECT * FROM category_prices", "category_prices"))
def agg_06(d):
    """AGG-06 + JN-07: category base prices per branch, branch-specific
    over default."""
    return _cat_prices(d)


@query("jn_07", with_views("""
    SELECT branch_id, category_id, source FROM category_prices""", "category_prices"))
def jn_07(d):
    """JN-07: which level (branch / default) each cell's price came from."""
    return _cat_prices(d).select("branch_id", "category_id", "source")


@query("prj_02", with_views(f"""
    SELECT branch_id, category_id, daily_rate,
           coalesce(weekly_rate, {R('daily_rate * 6', 4)}) AS weekly_rate,
           coalesce(monthly_rate, {R('daily_rate * 25', 4)}) AS monthly_rate
    FROM category_prices""", "category_prices"))
def prj_02(d):
    """PRJ-02: derived weekly (6x) / monthly (25x) rates where missing."""
    return rt.derived_rates(_cat_prices(d)).select("branch_id", "category_id", "daily_rate",
                                                   "weekly_rate", "monthly_rate")


@query("agg_07", with_views(f"""
    SELECT l.tenant_id, l.model_id, l.category_id, {_pivot('max', 2)}, s.effective_from, s.effective_until
    FROM rate_lines l JOIN (
        SELECT tenant_id, model_id, category_id, min(start_date) AS effective_from,
               CASE WHEN bool_or(end_date IS NULL) THEN NULL ELSE max(end_date) END AS effective_until
        FROM eff_rates GROUP BY 1, 2, 3) s
      ON s.tenant_id = l.tenant_id AND s.model_id = l.model_id AND s.category_id = l.category_id
    GROUP BY l.tenant_id, l.model_id, l.category_id, s.effective_from, s.effective_until""",
                            "rate_lines", "eff_rates"))
def agg_07(d):
    """AGG-07: model price pivot and effective span."""
    return rt.model_prices(d.rates, d.rate_details, d.fixed("rate_bands"), P.RATE_DATE)


TOP_CATEGORY_SQL = """
    SELECT category_id FROM (
        SELECT category_id, rank() OVER (ORDER BY count(*) DESC, category_id) AS rk
        FROM rentals GROUP BY category_id) WHERE rk <= 3"""


def _top_categories(d, k=3):
    from pyspark.sql import Window
    rentals = dm.with_category(dm.executed_rentals(d.contracts), d.vehicles)
    n = rentals.groupBy("tenant_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tenant_id").orderBy(F.col("n").desc(), "category_id")
    return n.withColumn("rk", F.rank().over(w)).where(F.col("rk") <= k).select("category_id")


@query("agg_08", with_views(f"""
    SELECT * FROM category_prices WHERE category_id IN ({TOP_CATEGORY_SQL})""", "category_prices", "rentals"))
def agg_08(d):
    """AGG-08: category prices restricted to the selected categories (the
    three with the most executed rentals)."""
    return dm.in_scope(_cat_prices(d), categories=_top_categories(d))


@query("agg_09", with_views(f"""
    SELECT tenant_id, branch_id, count(*) AS categories_found, CAST(sum(model_count) AS BIGINT) AS total_models,
           min(daily_rate) AS min_daily_rate, max(daily_rate) AS max_daily_rate,
           list_sort(list({{'category_id': category_id, 'daily_rate': daily_rate}})) AS per_category
    FROM category_prices GROUP BY tenant_id, branch_id""", "category_prices"))
def agg_09(d):
    """AGG-09: price summary of every branch's category prices."""
    return rt.price_summary(_cat_prices(d), ("tenant_id", "branch_id"))


@query("agg_10", with_views(f"""
    SELECT tenant_id, category_id, from_days, to_days, {R(cents_avg_sql('rate'), 4)} AS avg_rate,
           min(rate) AS min_rate, max(rate) AS max_rate, count(*) AS rate_count
    FROM rate_lines GROUP BY 1, 2, 3, 4""", "rate_lines"))
def agg_10(d):
    """AGG-10: rate statistics by category and duration band."""
    return rt.band_price_stats(_lines(d))


@query("jn_04", with_views("""
    SELECT b.branch_id, count(DISTINCT r.rate_id) AS rate_count
    FROM branches b LEFT JOIN rates r ON r.branch_id = b.branch_id AND r.tenant_id = b.tenant_id AND r.is_active
    GROUP BY b.branch_id""", "branches", "rates"))
def jn_04(d):
    """JN-04: branch-specific rates per branch, zero-rate branches kept
    (right-side predicate inside the ON clause)."""
    r = d.rates.where(F.col("is_active")).select("tenant_id", "branch_id", "rate_id")
    j = d.branches.select("tenant_id", "branch_id").join(r, ["tenant_id", "branch_id"], "left")
    return j.groupBy("branch_id").agg(F.countDistinct("rate_id").alias("rate_count"))


@query("jn_04_categories", with_views("""
    SELECT c.category_id, count(DISTINCT r.rate_id) AS rate_count
    FROM categories c LEFT JOIN rates r ON r.category_id = c.category_id AND r.is_active AND r.branch_id IS NULL
    GROUP BY c.category_id""", "categories", "rates"))
def jn_04_categories(d):
    """JN-04: rates of all branches per category, zero-rate categories kept."""
    r = d.rates.where(F.col("is_active") & F.col("branch_id").isNull()).select("category_id", "rate_id")
    return d.categories.select("category_id").join(r, "category_id", "left").groupBy("category_id").agg(
        F.countDistinct("rate_id").alias("rate_count"))


@query("jn_04_statuses", with_views("""
    SELECT s.status_id, s.status_name, count(DISTINCT v.vehicle_id) AS vehicle_count
    FROM status_config s LEFT JOIN vehicles v ON v.status_id = s.status_id AND v.is_deleted GROUP BY 1, 2""",
                                    "status_config", "vehicles"))
def jn_04_statuses(d):
    """JN-04: deleted vehicles per configured status, statuses without any kept."""
    v = d.vehicles.where("is_deleted").select("status_id", "vehicle_id")
    return d.fixed("status_config").join(v, "status_id", "left").groupBy("status_id", "status_name").agg(
        F.countDistinct("vehicle_id").alias("vehicle_count"))


@query("agg_23", with_views(f"""
    SELECT tenant_id, branch_id, category_id, {R('avg(avg_base_price_paid)', 4)} AS historical_mean_price
    FROM fact WHERE avg_base_price_paid > 0 GROUP BY 1, 2, 3""", "fact"))
def agg_23(d):
    """AGG-23: historical mean price per series (fallback base rate)."""
    return rt.historical_mean_price(dm.build_daily_demand(d))


# ---- utilization -----------------------------------------------------------

register_view("vstatus", """
    SELECT v.*, coalesce(s.status_type, 'UNKNOWN') AS status_class,
           coalesce(s.status_name, 'Status ' || CAST(v.status_id AS VARCHAR)) AS status_label
    FROM vehicles v LEFT JOIN status_config s ON v.status_id = s.status_id""", ("vehicles", "status_config"))
register_view("utilization", f"""
    SELECT tenant_id, branch_id, category_id, rented_count, available_count,
           rented_count + available_count AS total_active_fleet,
           coalesce({R('CAST(rented_count AS DOUBLE) / nullif(rented_count + available_count, 0)', 4)}, 0.0)
             AS utilization
    FROM (SELECT tenant_id, branch_id, category_id,
                 CAST(sum(CASE WHEN status_class = 'RENTED' THEN 1 ELSE 0 END) AS BIGINT) AS rented_count,
                 CAST(sum(CASE WHEN status_class = 'AVAILABLE' THEN 1 ELSE 0 END) AS BIGINT) AS available_count
          FROM vstatus WHERE NOT is_deleted AND status_class IN ('RENTED', 'AVAILABLE')
          GROUP BY 1, 2, 3)""", ("vstatus",))


def _util(d):
    if "_util" not in d.__dict__:
        d.__dict__["_util"] = ut.utilization(d.vehicles, d.fixed("status_config"))
    return d.__dict__["_util"]


@query("flt_03", with_views("""
    SELECT vehicle_id, branch_id, category_id, status_id FROM vstatus
    WHERE NOT is_deleted AND status_class IN ('RENTED', 'AVAILABLE')""", "vstatus"))
def flt_03(d):
    """FLT-03: non-deleted vehicles in an active status (semi join on config)."""
    return ut.active_fleet(d.vehicles, d.fixed("status_config")).select(
        "vehicle_id", "branch_id", "category_id", "status_id")


@query("prj_05", with_views("SELECT vehicle_id, status_id, status_class, status_label FROM vstatus", "vstatus"))
def prj_05(d):
    """PRJ-05: status -> class and label via the config map (UNKNOWN /
    'Status <id>' fallbacks)."""
    return ut.classify_status(d.vehicles, d.fixed("status_config")).select(
        "vehicle_id", "status_id", "status_class", "status_label")


@query("agg_02", with_views("SELECT * FROM utilization", "utilization"))
def agg_02(d):
    """AGG-02: utilization per branch x category."""
    return _util(d)


@query("agg_03", with_views("""
    SELECT tenant_id, branch_id, category_id, status_id, status_class, status_label, count(*) AS vehicle_count
    FROM vstatus WHERE NOT is_deleted GROUP BY 1, 2, 3, 4, 5, 6""", "vstatus"))
def agg_03(d):
    """AGG-03: fleet snapshot by branch, category and status."""
    return ut.fleet_snapshot(d.vehicles, d.fixed("status_config"))


@query("agg_04", with_views(f"""
    WITH pb AS (SELECT tenant_id, branch_id,
                       coalesce({R('CAST(sum(rented_count) AS DOUBLE) / nullif(sum(total_active_fleet), 0)', 3)}, 0.0) AS u
                FROM utilization GROUP BY 1, 2)
    SELECT t.*, b.by_branch FROM (
        SELECT tenant_id, count(*) AS cells, CAST(sum(total_active_fleet) AS BIGINT) AS total_fleet,
               CAST(sum(rented_count) AS BIGINT) AS total_rented,
               CAST(sum(available_count) AS BIGINT) AS total_available,
               min(utilization) AS min_utilization, max(utilization) AS max_utilization,
               {R('avg(utilization)', 4)} AS avg_utilization,
               coalesce({R('CAST(sum(rented_count) AS DOUBLE) / nullif(sum(total_active_fleet), 0)', 4)}, 0.0)
                 AS overall_utilization
        FROM utilization GROUP BY tenant_id) t
    JOIN (SELECT tenant_id, list_sort(list({{'branch_id': branch_id, 'utilization': u}})) AS by_branch
          FROM pb GROUP BY tenant_id) b ON t.tenant_id = b.tenant_id""", "utilization"))
def agg_04(d):
    """AGG-04: utilization summary (overall = sum / sum) with per-branch ratios."""
    return ut.utilization_summary(_util(d))


@query("agg_05", with_views("SELECT * FROM fleet_size", "fleet_size"))
def agg_05(d):
    """AGG-05: distinct vehicles per branch x category."""
    return ut.fleet_size(d.vehicles)


def _rentals(d):
    return dm.with_category(dm.executed_rentals(d.contracts, tenant_id=d.tenant_id), d.vehicles)


ON_RENT = f"DATE '{P.ON_RENT_DATE}'"


@query("jn_06", with_views(f"""
    SELECT f.tenant_id, f.branch_id, f.category_id, f.fleet_size AS total_vehicles,
           coalesce(r.n, 0) AS rented_vehicles,
           coalesce({R('CAST(coalesce(r.n, 0) AS DOUBLE) / nullif(f.fleet_size, 0)', 4)}, 0.0) AS utilization
    FROM fleet_size f LEFT JOIN (
        SELECT tenant_id, branch_id, category_id, count(DISTINCT vehicle_id) AS n FROM rentals
        WHERE start_date <= {ON_RENT} AND (end_date IS NULL OR end_date >= {ON_RENT}) GROUP BY 1, 2, 3) r
      ON r.tenant_id = f.tenant_id AND r.branch_id = f.branch_id AND r.category_id = f.category_id""",
                           "fleet_size", "rentals"))
def jn_06(d):
    """JN-06: fleet left-joined to vehicles on rent on a date (interval
    overlap predicate), rented 0 when none."""
    return ut.on_rent_at(_rentals(d), ut.fleet_size(d.vehicles), P.ON_RENT_DATE)


@query("jn_06_daily", with_views("SELECT * FROM on_rent_daily", "on_rent_daily"))
def jn_06_daily(d):
    """JN-06 for every day: distinct vehicles on rent per cell and day."""
    return ut.on_rent_daily(_rentals(d))


@query("agg_29", with_views(f"""
    SELECT branch_id, status_id, status_label, count(*) AS vehicle_count,
           {R('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY branch_id)', 2)} AS share_pct
    FROM vstatus WHERE NOT is_deleted GROUP BY 1, 2, 3""", "vstatus"))
def agg_29(d):
    """AGG-29: status distribution per branch with labels and share."""
    return ut.status_distribution(d.vehicles, d.fixed("status_config"), ["branch_id"])


@query("agg_29_categories", with_views(f"""
    SELECT category_id, status_id, status_label, count(*) AS vehicle_count,
           {R('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY category_id)', 2)} AS share_pct
    FROM vstatus WHERE NOT is_deleted GROUP BY 1, 2, 3""", "vstatus"))
def agg_29_categories(d):
    """AGG-29: status distribution per category."""
    return ut.status_distribution(d.vehicles, d.fixed("status_config"), ["category_id"])


@query("agg_29_overall", with_views(f"""
    SELECT tenant_id, status_id, status_label, count(*) AS vehicle_count,
           {R('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY tenant_id)', 2)} AS share_pct
    FROM vstatus WHERE NOT is_deleted GROUP BY 1, 2, 3""", "vstatus"))
def agg_29_overall(d):
    """AGG-29: status distribution of the whole fleet."""
    return ut.status_distribution(d.vehicles, d.fixed("status_config"), ["tenant_id"])


@query("cfg_05", with_views("""
    SELECT status_type, list_sort(list(status_id)) AS status_ids, count(*) AS n_statuses
    FROM status_config WHERE status_id IN (SELECT status_id FROM vehicles) GROUP BY status_type""",
                            "status_config", "vehicles"))
def cfg_05(d):
    """CFG-05: configured statuses that occur in the fleet, grouped by class."""
    used = d.vehicles.select("status_id").distinct()
    return ut.status_groups(d.fixed("status_config").join(used, "status_id", "left_semi"))


@query("jn_12", with_views(f"""
    SELECT status_id, count(*) AS vehicles,
           CAST(sum(CASE WHEN coalesce(a.n, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_active_contract,
           CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS active_contracts
    FROM vehicles v LEFT JOIN (
        SELECT tenant_id, vehicle_id, count(*) AS n FROM rentals
        WHERE start_date <= {ON_RENT} AND end_date >= {ON_RENT} GROUP BY 1, 2) a
      ON a.tenant_id = v.tenant_id AND a.vehicle_id = v.vehicle_id
    WHERE NOT v.is_deleted GROUP BY status_id""", "vehicles", "rentals"))
def jn_12(d):
    """JN-12: fleet status vs active contracts on a date (left join + counts)."""
    return ut.status_vs_contracts(d.vehicles, _rentals(d), P.ON_RENT_DATE)
