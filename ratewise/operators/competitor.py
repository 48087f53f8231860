"""Competitor pricing (SRC-03, CMP-01..10, WIN-11, WIN-15, TOP-02, TOP-03,
AGG-17, AGG-27, AGG-28).

Text classification runs on the *distinct* vehicle names (bounded by the
vehicle catalogue, not by the number of quotes) and is joined back.  Top-k
selections use ``row_number() <= k``, which Spark evaluates as a group
limit on each map task before the shuffle, so a hot group only ships k
rows per task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import cents_avg, rnd
from ratewise.functions.text import competitor_category, with_brand_and_model
from ratewise.sinks.io import materialize

SEARCH = ["tenant_id", "branch_id", "price_date"]


def per_day_price(total, days) -> F.Column:
    """SRC-03: total / max(days, 1); 0 when the total is not positive."""
    t = F.col(total) if isinstance(total, str) else total
    d = F.col(days) if isinstance(days, str) else days
    return F.when(t > 0, t / F.greatest(d, F.lit(1))).otherwise(F.lit(0.0))


def classify_catalog(catalog: DataFrame) -> DataFrame:
    """CMP-01 + CMP-02 on the vehicle catalogue (one row per vehicle, not
    per quote): brand, model and competitor category."""
    return with_brand_and_model(catalog).withColumn(
        "category", competitor_category("vehicle_name", "vehicle_group"))


def price_quotes(listings: DataFrame) -> DataFrame:
    """SRC-03 projection: per-day / weekly (x6) / monthly (x25) prices."""
    daily = per_day_price("total_price", "rental_days")
    return listings.select("*", rnd(daily, 2).alias("daily_price"), rnd(daily * 6, 2).alias("weekly_price"),
                           rnd(daily * 25, 2).alias("monthly_price"))


def cheapest_per_supplier(quotes: DataFrame, group: list[str]) -> DataFrame:
    """WIN-15: the cheapest quote of each supplier within a group (first
    quote wins ties)."""
    w = Window.partitionBy(*group, "competitor_name").orderBy("daily_price", "quote_id")
    return quotes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_k(df: DataFrame, group: list[str], k: int, order=("daily_price", "quote_id")) -> DataFrame:
    """TOP-02 / TOP-03: the k cheapest rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("price_rank", F.row_number().over(w)).where(F.col("price_rank") <= k)


def category_blocks(quotes: DataFrame, categories: list[str], k: int = 4) -> DataFrame:
    """CMP-03: per search (branch, date) and competitor category: cheapest
    quote per supplier, the k cheapest suppliers, their avg/min/max (2 dp),
    competitor list, count, and sorted brand / model lists without
    'Unknown'.  Categories without quotes are kept with NULL statistics."""
    best = top_k(cheapest_per_supplier(quotes, SEARCH + ["category"]), SEARCH + ["category"], k)
    known = lambda c: F.when(F.col(c) != "Unknown", F.col(c))
    g = best.groupBy(*SEARCH, "category").agg(
        rnd(cents_avg("daily_price"), 2).alias("avg_price"), F.min("daily_price").alias("min_price"),
        F.max("daily_price").alias("max_price"), F.count(F.lit(1)).alias("competitors_count"),
        F.array_sort(F.collect_list(F.struct("price_rank", "competitor_name"))).getField("competitor_name")
         .alias("competitors"),
        F.array_sort(F.collect_set(known("brand"))).alias("brands"),
        F.array_sort(F.collect_set(known("model"))).alias("models"))
    # one row per search with its blocks by category, so that the quotes are read once
    stats = ["avg_price", "min_price", "max_price", "competitors_count", "competitors", "brands", "models"]
    block = F.when(F.col("category").isNotNull(), F.struct("category", F.struct(*stats).alias("s")))
    searches = g.groupBy(*SEARCH).agg(F.map_from_entries(F.collect_list(block)).alias("blocks"))
    grid = searches.select(*SEARCH, "blocks", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    return grid.select(*SEARCH, "category", F.try_element_at("blocks", F.col("category")).alias("s")).select(
        *SEARCH, "category", *[F.col(f"s.{c}").alias(c) for c in stats])


def competitor_index(quotes: DataFrame, mapping: DataFrame, base: DataFrame, default_type: str) -> DataFrame:
    """CMP-04 (+ CMP-06): per branch, our category and date: average of the
    3 cheapest quotes of the mapped vehicle type, min / max / count of all,
    our base price and position = ours / average (4 dp).

    ``mapping`` maps our category to a competitor type (default
    ``default_type``); ``base`` has (tenant, branch, category, base_daily).
    """
    q = quotes.select("tenant_id", "branch_id", "price_date", "daily_price",
                      F.col("category").alias("competitor_vehicle_type"))
    q = q.where(F.col("daily_price") > 0)
    key = ["tenant_id", "branch_id", "price_date", "competitor_vehicle_type"]
    # one pass: quotes of a key and price are one row with their number, so a
    # hot key is spread over its prices before they meet in a window
    prices = q.groupBy(*key, "daily_price").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("daily_price").rowsBetween(Window.unboundedPreceding, -1))
    taken = F.greatest(F.least("n", 3 - F.coalesce("before", F.lit(0))), F.lit(0))
    prices = prices.withColumn("before", before).withColumn("taken", taken)
    cents = F.round(F.col("daily_price") * 100.0).cast("long")
    stats = prices.groupBy(*key).agg(
        (F.sum(cents * F.col("taken")) / F.sum("taken") / 100.0).alias("avg3"), F.min("daily_price").alias("mn"),
        F.max("daily_price").alias("mx"), F.sum("n").alias("n"))
    cells = base.select("tenant_id", "branch_id", "category_id", "base_daily").join(
        F.broadcast(mapping.select("category_id", "competitor_vehicle_type")), "category_id", "left").withColumn(
        "competitor_vehicle_type", F.coalesce("competitor_vehicle_type", F.lit(default_type)))
    j = cells.join(stats, ["tenant_id", "branch_id", "competitor_vehicle_type"])
    return j.select(
        "tenant_id", "branch_id", "category_id", F.col("price_date").alias("index_date"),
        rnd("avg3", 2).alias("competitor_avg_price"), F.col("mn").alias("competitor_min_price"),
        F.col("mx").alias("competitor_max_price"), F.col("n").alias("competitors_count"),
        F.col("base_daily").alias("our_base_price"),
        rnd(F.col("base_daily") / rnd("avg3", 2), 4).alias("price_position"))


def index_batch(index: DataFrame, cells: DataFrame, start: dt.date, days: int) -> DataFrame:
    """CMP-05: index over a date range x branch x category; cells with no
    quotes get zeros; plus success / failure flags for the counters."""
    spine = cells.select("tenant_id", "branch_id", "category_id", "base_daily",
                         F.explode(F.sequence(F.lit(start), F.date_add(F.lit(start), days - 1))).alias("index_date"))
    j = spine.join(index.drop("our_base_price"), ["tenant_id", "branch_id", "category_id", "index_date"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(
        "tenant_id", "branch_id", "category_id", "index_date",
        z("competitor_avg_price").alias("competitor_avg_price"), z("competitor_min_price").alias("competitor_min_price"),
        z("competitor_max_price").alias("competitor_max_price"),
        F.coalesce("competitors_count", F.lit(0)).alias("competitors_count"),
        F.col("base_daily").alias("our_base_price"),
        F.coalesce("price_position", F.lit(0.0)).alias("price_position"),
        F.col("competitors_count").isNotNull().alias("has_prices"))


def batch_statistics(batch: DataFrame) -> DataFrame:
    """CMP-05 counters of an :func:`index_batch`, per tenant."""
    found = F.col("has_prices").cast("int")
    return batch.groupBy("tenant_id").agg(
        F.countDistinct("branch_id").alias("branches"), F.countDistinct("category_id").alias("categories"),
        F.countDistinct("index_date").alias("dates_processed"), F.count(F.lit(1)).alias("indexes_created"),
        F.sum(found).alias("successes"), F.sum(1 - found).alias("failures"))


def last_known_price(fact: DataFrame) -> DataFrame:
    """WIN-11: last known average price per series (by date)."""
    return fact.where(F.col("avg_base_price_paid").isNotNull()).groupBy("tenant_id", "branch_id", "category_id").agg(
        F.max_by("avg_base_price_paid", "demand_date").alias("last_price"),
        F.max("demand_date").alias("last_price_date"))


#: The provider's car object, as far as it is read.
CAR = ("vehicle_info struct<v_name string, `group` string, seats int, baggage_large int, baggage_small int, bags_large int, "
       "bags_small int>, pricing_info struct<price double>, supplier_info struct<name string>")


def normalise_listings(cars: DataFrame, keys: list[str], days: str = "rental_days") -> DataFrame:
    """SRC-03: provider payloads (``payload``: one nested car object) to flat
    quotes.  Missing names are ``Unknown``, a missing group is empty, a missing
    price or one not above 0 is 0; a bag count that is missing or 0 under its
    first name is taken from its second.  A payload that does not parse gives
    the defaults.  Payloads are parsed once, into a table.  Names are classified
    once each and joined back; rows without a name, which may be many, are
    classified where they are."""
    car = cars.select(*keys, days, F.from_json("payload", CAR).alias("car"))
    v = lambda f: F.col(f"car.vehicle_info.{f}")
    bags = lambda size: F.coalesce(F.nullif(v(f"baggage_{size}"), F.lit(0)), v(f"bags_{size}"))
    flat = car.select(
        *keys, F.coalesce("car.supplier_info.name", F.lit("Unknown")).alias("competitor_name"),
        F.coalesce(v("v_name"), F.lit("Unknown")).alias("vehicle_name"), F.coalesce(v("group"), F.lit("")).alias("vehicle_group"),
        per_day_price(F.coalesce("car.pricing_info.price", F.lit(0.0)), days).alias("_daily"),
        v("seats").alias("seats"), bags("large").alias("bags_large"), bags("small").alias("bags_small"))
    flat = materialize(flat, "listings")
    classify = lambda df: with_brand_and_model(df).withColumn("category", competitor_category("vehicle_name", "vehicle_group"))
    named, nameless = flat.where(F.col("vehicle_name") != "Unknown"), flat.where(F.col("vehicle_name") == "Unknown")
    names = classify(named.select("vehicle_name", "vehicle_group").distinct())
    both = named.join(names, ["vehicle_name", "vehicle_group"]).unionByName(classify(nameless))
    return both.select(
        *keys, "competitor_name", "vehicle_name", "brand", "model", "category", rnd("_daily", 2).alias("daily_price"),
        rnd(F.col("_daily") * 6, 2).alias("weekly_price"), rnd(F.col("_daily") * 25, 2).alias("monthly_price"),
        "seats", "bags_large", "bags_small")


def live_quotes(quotes: DataFrame, now: dt.datetime, ttl_hours: int = 24) -> DataFrame:
    """CMP-10 + FLT-07: expires_at = fetched_at + 24 h; live when > now."""
    q = quotes.withColumn("expires_at", F.col("fetched_at") + F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return q.where(F.col("expires_at") > F.lit(now))


def brand_summary(quotes: DataFrame) -> DataFrame:
    """AGG-27: quotes, min, max, avg (2 dp) daily price per brand."""
    return quotes.groupBy("brand").agg(
        F.count(F.lit(1)).alias("quotes"), F.min("daily_price").alias("min_price"),
        F.max("daily_price").alias("max_price"), rnd(cents_avg("daily_price"), 2).alias("avg_price"))


def distinct_values(quotes: DataFrame) -> DataFrame:
    """AGG-28: distinct brands, models and categories without 'Unknown', one
    row per (tenant, kind, value): the catalogue may grow without any task
    holding a whole list.  One pass over the quotes."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("brand", "model", "category")])
    v = quotes.select("tenant_id", F.explode(kinds).alias("v")).select("tenant_id", "v.kind", "v.value")
    return v.where(F.col("value") != "Unknown").distinct()
