"""Queries for competitor quotes, text classification and the index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ratewise.functions.mathx import cents_avg_sql, rnd_sql as R
from ratewise.functions.text import MODEL_CATEGORIES, brand_and_model_sql, competitor_category_sql
from ratewise.operators import competitor as cp
from ratewise.operators import demand as dm
from ratewise.operators import rates as rt
from ratewise.operators import recommend as rc
from ratewise.plans import calendar_plans, feature_plans  # noqa: F401
from ratewise.plans import params as P
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.rate_plans import _cat_prices
from ratewise.plans.registry import query
from ratewise.sources.fixed import CATEGORIES, DEFAULT_COMPETITOR_TYPE, GENERIC_DAILY_RATE, fixed_table_sql

register_view("competitor_mapping", fixed_table_sql("competitor_mapping"))

COMP_CATEGORIES = sorted({c for _, c in MODEL_CATEGORIES})
_KEYS = "[" + ", ".join(f"'{k}'" for k, _ in MODEL_CATEGORIES) + "]"
_B, _M = brand_and_model_sql("vehicle_name")

register_view("listings", f"""
    SELECT l_orderkey * 10 + l_linenumber AS quote_id, 1 AS tenant_id, s_nationkey AS branch_id,
           CAST(l_shipdate AS DATE) AS price_date, s_name AS competitor_name,
           CASE WHEN p_size > 45 THEN p_name
                ELSE {_KEYS}[CAST(p_partkey % {len(MODEL_CATEGORIES)} AS INTEGER) + 1] || ' ' || p_name END AS vehicle_name,
           upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS vehicle_group,
           l_extendedprice / 10 AS total_price, CAST(l_quantity AS INTEGER) AS rental_days
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
register_view("names", f"""
    SELECT vehicle_name, vehicle_group, {_B} AS brand, {_M} AS model,
           {competitor_category_sql('vehicle_name', 'vehicle_group')} AS category
    FROM (SELECT DISTINCT vehicle_name, vehicle_group FROM listings)""", ("listings",))
_DAILY = "CASE WHEN total_price > 0 THEN total_price / greatest(rental_days, 1) ELSE 0.0 END"
register_view("quotes", f"""
    SELECT l.*, n.brand, n.model, n.category, {R(_DAILY, 2)} AS daily_price,
           {R(f'({_DAILY}) * 6', 2)} AS weekly_price, {R(f'({_DAILY}) * 25', 2)} AS monthly_price
    FROM listings l JOIN names n ON n.vehicle_name = l.vehicle_name AND n.vehicle_group = l.vehicle_group""",
              ("listings", "names"))
_SEARCH = "tenant_id, branch_id, price_date"
register_view("sup_best", f"""
    SELECT * EXCLUDE (r1) FROM (SELECT *, row_number() OVER (PARTITION BY {_SEARCH}, category, competitor_name
                                                   ORDER BY daily_price, quote_id) AS r1 FROM quotes) WHERE r1 = 1""",
              ("quotes",))
register_view("top4", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SEARCH}, category ORDER BY daily_price, quote_id)
                   AS price_rank FROM sup_best) WHERE price_rank <= 4""", ("sup_best",))
register_view("last_price", """
    SELECT tenant_id, branch_id, category_id, arg_max(avg_base_price_paid, demand_date) AS last_price,
           max(demand_date) AS last_price_date
    FROM fact WHERE avg_base_price_paid IS NOT NULL GROUP BY 1, 2, 3""", ("fact",))
register_view("hist_price", f"""
    SELECT tenant_id, branch_id, category_id, {R('avg(avg_base_price_paid)', 4)} AS historical_mean_price
    FROM fact WHERE avg_base_price_paid > 0 GROUP BY 1, 2, 3""", ("fact",))
register_view("base_rates", f"""
    SELECT tenant_id, branch_id, category_id, {R('base_daily', 4)} AS base_daily,
           {R('coalesce(CASE WHEN _w <> 0 THEN _w END, base_daily * 6)', 4)} AS base_weekly,
           {R('coalesce(CASE WHEN _m <> 0 THEN _m END, base_daily * 25)', 4)} AS base_monthly, base_source
    FROM (SELECT g.tenant_id, g.branch_id, g.category_id,
                 CASE WHEN cp.daily_rate IS NOT NULL AND cp.daily_rate <> 0 THEN cp.daily_rate
                      ELSE coalesce(CASE WHEN h.historical_mean_price <> 0 THEN h.historical_mean_price END,
                                    c.default_daily_rate, {GENERIC_DAILY_RATE}) END AS base_daily,
                 CASE WHEN cp.daily_rate IS NOT NULL AND cp.daily_rate <> 0 THEN 'config'
                      WHEN h.historical_mean_price IS NOT NULL AND h.historical_mean_price <> 0 THEN 'history'
                      WHEN c.default_daily_rate IS NOT NULL THEN 'category_default' ELSE 'generic' END AS base_source,
                 CASE WHEN cp.daily_rate IS NOT NULL AND cp.daily_rate <> 0 THEN cp.weekly_rate END AS _w,
                 CASE WHEN cp.daily_rate IS NOT NULL AND cp.daily_rate <> 0 THEN cp.monthly_rate END AS _m
          FROM (SELECT b.tenant_id, b.branch_id, c.category_id FROM branches b CROSS JOIN categories c) g
          LEFT JOIN category_prices cp ON cp.tenant_id = g.tenant_id AND cp.branch_id = g.branch_id
               AND cp.category_id = g.category_id
          LEFT JOIN hist_price h ON h.tenant_id = g.tenant_id AND h.branch_id = g.branch_id
               AND h.category_id = g.category_id
          LEFT JOIN categories c ON c.category_id = g.category_id)""",
              ("branches", "categories", "category_prices", "hist_price"))
register_view("comp_index", f"""
    WITH q AS (SELECT tenant_id, branch_id, price_date, quote_id, daily_price, category AS competitor_vehicle_type
               FROM quotes WHERE daily_price > 0),
         t3 AS (SELECT tenant_id, branch_id, price_date, competitor_vehicle_type, {cents_avg_sql('daily_price')} AS avg3
                FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, branch_id, price_date, competitor_vehicle_type
                                                   ORDER BY daily_price, quote_id) AS rk FROM q) WHERE rk <= 3
                GROUP BY 1, 2, 3, 4),
         a AS (SELECT tenant_id, branch_id, price_date, competitor_vehicle_type, min(daily_price) AS mn,
                      max(daily_price) AS mx, count(*) AS n FROM q GROUP BY 1, 2, 3, 4),
         cells AS (SELECT b.tenant_id, b.branch_id, b.category_id, b.base_daily,
                          coalesce(m.competitor_vehicle_type, '{DEFAULT_COMPETITOR_TYPE}') AS competitor_vehicle_type
                   FROM base_rates b LEFT JOIN competitor_mapping m ON m.category_id = b.category_id)
    SELECT c.tenant_id, c.branch_id, c.category_id, t3.price_date AS index_date,
           {R('t3.avg3', 2)} AS competitor_avg_price, a.mn AS competitor_min_price, a.mx AS competitor_max_price,
           a.n AS competitors_count, c.base_daily AS our_base_price,
           {R(f"c.base_daily / {R('t3.avg3', 2)}", 4)} AS price_position
    FROM cells c JOIN t3 ON t3.tenant_id = c.tenant_id AND t3.branch_id = c.branch_id
         AND t3.competitor_vehicle_type = c.competitor_vehicle_type
    JOIN a ON a.tenant_id = t3.tenant_id AND a.branch_id = t3.branch_id AND a.price_date = t3.price_date
         AND a.competitor_vehicle_type = t3.competitor_vehicle_type""",
              ("quotes", "base_rates", "competitor_mapping"))



def fact(d):
    """The demand fact of this query (a materialized feature store, which
    carries the fact columns, when the caller has one)."""
    if "_fact" not in d.__dict__:
        d.__dict__["_fact"] = dm.build_daily_demand(d)
    return d.__dict__["_fact"]


def _catalog(d):
    """The classified vehicle catalogue (classification once per vehicle)."""
    if "_catalog" not in d.__dict__:
        d.__dict__["_catalog"] = cp.classify_catalog(d.vehicle_catalog)
    return d.__dict__["_catalog"]


def _quotes(d):
    if "_quotes" not in d.__dict__:
        d.__dict__["_quotes"] = cp.price_quotes(d.listings_between(catalog=_catalog(d)))
    return d.__dict__["_quotes"]


def window_quotes(d, start, end):
    """Quotes of a date window only (the date filter is pushed into the scan)."""
    return cp.price_quotes(d.listings_between(start, end, catalog=_catalog(d)))


def base_rates(d):
    """PRC-03 base rates for every branch x category."""
    if "_base" not in d.__dict__:
        cells = rc.cell_grid(d.branches, [c[0] for c in CATEGORIES])
        hist = rt.historical_mean_price(fact(d))
        d.__dict__["_base"] = rt.resolve_base_rates(cells, _cat_prices(d), hist, d.categories, GENERIC_DAILY_RATE)
    return d.__dict__["_base"]


def comp_index(d):
    if "_cidx" not in d.__dict__:
        d.__dict__["_cidx"] = cp.competitor_index(_quotes(d), d.fixed("competitor_mapping"), base_rates(d),
                                                  DEFAULT_COMPETITOR_TYPE)
    return d.__dict__["_cidx"]


@query("cmp_01", with_views("SELECT DISTINCT vehicle_name, brand, model FROM names", "names"))
def cmp_01(d):
    """CMP-01: brand / model extraction from vehicle names (list order)."""
    from ratewise.functions.text import with_brand_and_model
    return with_brand_and_model(d.listings.select("vehicle_name").distinct())


@query("cmp_02", with_views("SELECT vehicle_name, vehicle_group, category FROM names", "names"))
def cmp_02(d):
    """CMP-02: competitor category from model dictionary, then feed group."""
    from ratewise.functions.text import competitor_category
    n = d.listings.select("vehicle_name", "vehicle_group").distinct()
    return n.select("vehicle_name", "vehicle_group",
                    competitor_category("vehicle_name", "vehicle_group").alias("category"))


@query("src_03", with_views("""
    SELECT quote_id, branch_id, price_date, competitor_name, brand, model, category,
           daily_price, weekly_price, monthly_price FROM quotes""", "quotes"))
def src_03(d):
    """SRC-03: listing feed -> flat quotes with per-day / weekly / monthly."""
    return _quotes(d).select("quote_id", "branch_id", "price_date", "competitor_name", "brand", "model",
                             "category", "daily_price", "weekly_price", "monthly_price")


register_view("cars", """
    SELECT quote_id, CASE WHEN quote_id % 11 = 0 THEN 'Unknown' ELSE competitor_name END AS competitor_name,
           CASE WHEN quote_id % 17 = 0 THEN 'Unknown' ELSE vehicle_name END AS vehicle_name,
           CASE WHEN quote_id % 13 = 0 THEN '' ELSE vehicle_group END AS vehicle_group,
           CASE WHEN quote_id % 19 = 0 THEN 0.0 ELSE total_price END AS total_price, rental_days,
           CAST(2 + quote_id % 4 AS INTEGER) AS seats,
           CAST(CASE WHEN quote_id % 2 = 0 THEN nullif(quote_id % 4, 0) ELSE quote_id % 4 END AS INTEGER) AS bags_large,
           CAST(CASE WHEN quote_id % 2 = 0 THEN nullif(quote_id % 3, 0) ELSE quote_id % 3 END AS INTEGER) AS bags_small
    FROM listings""", ("listings",))


@query("src_03_payload", with_views(f"""
    SELECT quote_id, competitor_name, c.vehicle_name, brand, model, category, {R(_DAILY, 2)} AS daily_price,
           {R(f'({_DAILY}) * 6', 2)} AS weekly_price, {R(f'({_DAILY}) * 25', 2)} AS monthly_price, seats, bags_large, bags_small
    FROM cars c JOIN (SELECT vehicle_name, vehicle_group, {_B} AS brand, {_M} AS model,
                             {competitor_category_sql('vehicle_name', 'vehicle_group')} AS category
                      FROM (SELECT DISTINCT vehicle_name, vehicle_group FROM cars)) n
      ON n.vehicle_name = c.vehicle_name AND n.vehicle_group = c.vehicle_group""", "cars"))
def src_03_payload(d):
    """SRC-03: nested car objects of the provider, some without supplier,
    name, group or price, half with the second names of the bag counts."""
    q = F.col("quote_id")
    without = lambda n, c: F.when(q % n != 0, F.col(c))
    large, small = (q % 4).cast("int"), (q % 3).cast("int")
    first = lambda c: F.when(q % 2 == 0, c)
    second = lambda c: F.when(q % 2 != 0, c)
    payload = F.to_json(F.struct(
        F.struct(without(17, "vehicle_name").alias("v_name"), without(13, "vehicle_group").alias("group"),
                 (q % 4 + 2).cast("int").alias("seats"), first(large).alias("baggage_large"), first(small).alias("baggage_small"),
                 second(large).alias("bags_large"), second(small).alias("bags_small")).alias("vehicle_info"),
        F.struct(without(19, "total_price").alias("price")).alias("pricing_info"),
        F.struct(without(11, "competitor_name").alias("name")).alias("supplier_info")))
    return cp.normalise_listings(d.listings.select("quote_id", "rental_days", payload.alias("payload")), ["quote_id"])


@query("win_15", with_views(f"""
    SELECT {_SEARCH}, category, competitor_name, quote_id, daily_price FROM sup_best""", "sup_best"))
def win_15(d):
    """WIN-15: cheapest quote per supplier (first wins ties)."""
    return cp.cheapest_per_supplier(_quotes(d), cp.SEARCH + ["category"]).select(
        *cp.SEARCH, "category", "competitor_name", "quote_id", "daily_price")


@query("top_02", with_views(f"""
    SELECT {_SEARCH}, category, competitor_name, CAST(price_rank AS INTEGER) AS price_rank, daily_price FROM top4""", "top4"))
def top_02(d):
    """TOP-02: the 4 cheapest suppliers per search and category."""
    b = cp.cheapest_per_supplier(_quotes(d), cp.SEARCH + ["category"])
    return cp.top_k(b, cp.SEARCH + ["category"], 4).select(*cp.SEARCH, "category", "competitor_name",
                                                           "price_rank", "daily_price")


_CATS_SQL = "[" + ", ".join(f"'{c}'" for c in COMP_CATEGORIES) + "]"


@query("cmp_03", with_views(f"""
    SELECT g.tenant_id, g.branch_id, g.price_date, g.category, t.avg_price, t.min_price, t.max_price,
           t.competitors_count, t.competitors, t.brands, t.models
    FROM (SELECT s.*, unnest({_CATS_SQL}) AS category FROM (SELECT DISTINCT {_SEARCH} FROM quotes) s) g
    LEFT JOIN (SELECT {_SEARCH}, category, {R(cents_avg_sql('daily_price'), 2)} AS avg_price,
                      min(daily_price) AS min_price, max(daily_price) AS max_price, count(*) AS competitors_count,
                      list(competitor_name ORDER BY price_rank) AS competitors,
                      coalesce(list_sort(list(DISTINCT brand) FILTER (WHERE brand <> 'Unknown')), []) AS brands,
                      coalesce(list_sort(list(DISTINCT model) FILTER (WHERE model <> 'Unknown')), []) AS models
               FROM top4 GROUP BY {_SEARCH}, category) t
      ON t.tenant_id = g.tenant_id AND t.branch_id = g.branch_id AND t.price_date = g.price_date
         AND t.category = g.category""", "quotes", "top4"))
def cmp_03(d):
    """CMP-03: category price blocks per search (empty categories kept)."""
    return cp.category_blocks(_quotes(d), COMP_CATEGORIES, 4)


@query("cmp_04", with_views("SELECT * FROM comp_index", "comp_index"))
def cmp_04(d):
    """CMP-04 + CMP-06: competitor index per branch, category and date."""
    return comp_index(d)


@query("top_03", with_views("""
    SELECT tenant_id, branch_id, price_date, category, quote_id, daily_price, CAST(rk AS INTEGER) AS price_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, branch_id, price_date, category
                                   ORDER BY daily_price, quote_id) AS rk FROM quotes WHERE daily_price > 0)
    WHERE rk <= 3""", "quotes"))
def top_03(d):
    """TOP-03: the three cheapest quotes per branch, type and date."""
    q = _quotes(d).where(F.col("daily_price") > 0)
    return cp.top_k(q, ["tenant_id", "branch_id", "price_date", "category"], 3).select(
        "tenant_id", "branch_id", "price_date", "category", "quote_id", "daily_price", "price_rank")


register_view("index_batch", f"""
    SELECT b.tenant_id, b.branch_id, b.category_id, s.index_date,
           coalesce(i.competitor_avg_price, 0.0) AS competitor_avg_price,
           coalesce(i.competitor_min_price, 0.0) AS competitor_min_price,
           coalesce(i.competitor_max_price, 0.0) AS competitor_max_price,
           coalesce(i.competitors_count, 0) AS competitors_count, p.last_price AS our_base_price,
           coalesce({R('p.last_price / i.competitor_avg_price', 4)}, 0.0) AS price_position,
           i.competitors_count IS NOT NULL AS has_prices
    FROM base_rates b LEFT JOIN last_price p ON p.tenant_id = b.tenant_id AND p.branch_id = b.branch_id
         AND p.category_id = b.category_id
    CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{P.RUN_DATE}', DATE '{P.RUN_DATE}' + {P.HORIZON - 1},
                                                   INTERVAL 1 DAY)) AS DATE) AS index_date) s
    LEFT JOIN comp_index i ON i.tenant_id = b.tenant_id AND i.branch_id = b.branch_id
         AND i.category_id = b.category_id AND i.index_date = s.index_date""", ("base_rates", "last_price", "comp_index"))


def _index_batch(d):
    end = P.RUN_DATE + dt.timedelta(days=P.HORIZON - 1)
    known = cp.last_known_price(fact(d)).select("tenant_id", "branch_id", "category_id", F.col("last_price").alias("base_daily"))
    cells = rc.cell_grid(d.branches, [c[0] for c in CATEGORIES]).join(known, ["tenant_id", "branch_id", "category_id"], "left")
    index = cp.competitor_index(window_quotes(d, P.RUN_DATE, end), d.fixed("competitor_mapping"), cells, DEFAULT_COMPETITOR_TYPE)
    return cp.index_batch(index, cells, P.RUN_DATE, P.HORIZON)


@query("cmp_05", with_views("SELECT * FROM index_batch", "index_batch"))
def cmp_05(d):
    """CMP-05: index over the run window for every cell against our last known
    price, zeros when no quotes."""
    return _index_batch(d)


@query("cmp_05_stats", with_views("""
    SELECT tenant_id, count(DISTINCT branch_id) AS branches, count(DISTINCT category_id) AS categories,
           count(DISTINCT index_date) AS dates_processed, count(*) AS indexes_created,
           count(*) FILTER (has_prices) AS successes, count(*) FILTER (NOT has_prices) AS failures
    FROM index_batch GROUP BY tenant_id""", "index_batch"))
def cmp_05_stats(d):
    """CMP-05: counters of the batch."""
    return cp.batch_statistics(_index_batch(d))


@query("cmp_06", with_views(f"""
    SELECT c.category_id, coalesce(m.competitor_vehicle_type, '{DEFAULT_COMPETITOR_TYPE}') AS competitor_vehicle_type
    FROM (SELECT DISTINCT category_id FROM vehicles) c
    LEFT JOIN competitor_mapping m ON m.category_id = c.category_id""", "vehicles", "competitor_mapping"))
def cmp_06(d):
    """CMP-06: competitor vehicle type of every fleet category (default Economy)."""
    m = d.fixed("competitor_mapping")
    return d.vehicles.select("category_id").distinct().join(F.broadcast(m), "category_id", "left").select(
        "category_id", F.coalesce("competitor_vehicle_type", F.lit(DEFAULT_COMPETITOR_TYPE))
        .alias("competitor_vehicle_type"))


@query("win_11", with_views("SELECT * FROM last_price", "last_price"))
def win_11(d):
    """WIN-11: last known price per series."""
    return cp.last_known_price(dm.build_daily_demand(d))


@query("agg_27", with_views(f"""
    SELECT brand, count(*) AS quotes, min(daily_price) AS min_price, max(daily_price) AS max_price,
           {R(cents_avg_sql('daily_price'), 2)} AS avg_price FROM quotes GROUP BY brand""", "quotes"))
def agg_27(d):
    """AGG-27: brand summary of the quotes."""
    return cp.brand_summary(_quotes(d))


@query("agg_28", with_views("""
    SELECT DISTINCT tenant_id, 'brand' AS kind, brand AS value FROM quotes WHERE brand <> 'Unknown'
    UNION ALL SELECT DISTINCT tenant_id, 'model', model FROM quotes WHERE model <> 'Unknown'
    UNION ALL SELECT DISTINCT tenant_id, 'category', category FROM quotes WHERE category <> 'Unknown'""", "quotes"))
def agg_28(d):
    """AGG-28: distinct brands, models and categories, as rows."""
    return cp.distinct_values(_quotes(d))
