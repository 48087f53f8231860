"""Base rates (FLT-02, FLT-05, PRJ-01, PRJ-02, JN-02, JN-04, JN-07,
AGG-06..10, AGG-23, PRC-03).

Rates, periods and details are joined on their composite keys; the
period band becomes a column through ``avg/max(when ...)``.  The
branch-over-default fallback is computed for every branch x category at
once (two aggregates joined on the cell, ``coalesce`` by specificity)
instead of two queries per request.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.mathx import cents_avg, rnd
from ratewise.operators.intervals import interval_join



def _daily():
    return (F.col("to_days") == 6) | (F.col("to_days").isNull() & (F.col("from_days") == 1))


def _weekly():
    return (F.col("from_days") == 7) & (F.col("to_days") == 27)


def _monthly():
    return (F.col("from_days") == 28) & F.col("to_days").isNull()


def effective_on(rates: DataFrame, day: dt.date) -> DataFrame:
    """FLT-02: active rates with start <= day and (end is null or end >= day)."""
    d = F.lit(day)
    return rates.where(F.col("is_active") & (F.col("start_date") <= d)
                       & (F.col("end_date").isNull() | (F.col("end_date") >= d)))


def rate_lines(rates: DataFrame, details: DataFrame, bands: DataFrame) -> DataFrame:
    """JN-02: rate x detail x period on their composite keys (bands are a
    small config table, broadcast)."""
    return (rates.join(details, "rate_id")
                 .join(F.broadcast(bands.select("period_id", "from_days", "to_days")), "period_id"))


def period_pivot(lines: DataFrame, keys: list[str], fn=cents_avg, digits: int = 4) -> DataFrame:
    """PRJ-01: daily / weekly / monthly columns from the period bands."""
    return lines.groupBy(*keys).agg(
        rnd(fn(F.when(_daily(), F.col("rate"))), digits).alias("daily_rate"),
        rnd(fn(F.when(_weekly(), F.col("rate"))), digits).alias("weekly_rate"),
        rnd(fn(F.when(_monthly(), F.col("rate"))), digits).alias("monthly_rate"),
    )


def derived_rates(df: DataFrame) -> DataFrame:
    """PRJ-02: weekly = 6 x daily and monthly = 25 x daily where missing."""
    return (df.withColumn("weekly_rate", F.coalesce("weekly_rate", rnd(F.col("daily_rate") * 6, 4)))
              .withColumn("monthly_rate", F.coalesce("monthly_rate", rnd(F.col("daily_rate") * 25, 4))))


def category_prices(lines: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-06 core: model count and mean rate per band per ``keys`` (one
    grouped aggregation; NULL keys form their own group)."""
    return lines.groupBy(*keys).agg(
        rnd(cents_avg(F.when(_daily(), F.col("rate"))), 4).alias("daily_rate"),
        rnd(cents_avg(F.when(_weekly(), F.col("rate"))), 4).alias("weekly_rate"),
        rnd(cents_avg(F.when(_monthly(), F.col("rate"))), 4).alias("monthly_rate"),
        F.countDistinct("model_id").alias("model_count"))


def category_prices_with_fallback(rates: DataFrame, details: DataFrame, bands: DataFrame,
                                  branches: DataFrame, categories: DataFrame, day: dt.date) -> DataFrame:
    """AGG-06 + JN-07: per branch x category, the branch-specific prices
    when that branch has rates for the category, else the default
    (branch IS NULL) prices; ``source`` tells which.

    The grid is branches x categories (two small dimensions); specific
    and default aggregates are left-joined to it and coalesced.
    """
    lines = rate_lines(effective_on(rates, day), details, bands)
    # One aggregation serves both levels: default rates carry a NULL branch,
    # so their group is the (tenant, NULL, category) group.
    both = category_prices(lines, ["tenant_id", "branch_id", "category_id"])
    spec = both.where(F.col("branch_id").isNotNull())
    dflt = both.where(F.col("branch_id").isNull()).drop("branch_id")
    from ratewise.sources.fixed import CATEGORIES
    cat_ids = F.array(*[F.lit(c[0]) for c in CATEGORIES])
    grid = branches.select("tenant_id", "branch_id", F.explode(cat_ids).alias("category_id"))
    cols = ["daily_rate", "weekly_rate", "monthly_rate", "model_count"]
    s = spec.select("tenant_id", "branch_id", "category_id", *[F.col(c).alias("s_" + c) for c in cols])
    t = dflt.select("tenant_id", "category_id", *[F.col(c).alias("d_" + c) for c in cols])
    j = grid.join(s, ["tenant_id", "branch_id", "category_id"], "left").join(t, ["tenant_id", "category_id"], "left")
    has_spec = F.col("s_model_count").isNotNull()
    out = j.select(
        "tenant_id", "branch_id", "category_id",
        *[F.when(has_spec, F.col("s_" + c)).otherwise(F.col("d_" + c)).alias(c) for c in cols],
        F.when(has_spec, F.lit("branch_specific")).when(F.col("d_model_count").isNotNull(), F.lit("default"))
         .alias("source"),
    )
    return out.where(F.col("source").isNotNull())


def _cents(band):
    """Sum of cents and count of a band's rates: both add up, in any order."""
    rate = F.when(band, F.col("rate"))
    return F.sum(F.round(rate * 100.0).cast("long")), F.count(rate)


def prices_by_day(rates: DataFrame, details: DataFrame, bands: DataFrame, cells: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
    """AGG-06 + JN-07 for every day from ``low`` to ``high`` in one plan.

    ``cells`` are the (tenant, branch, category) to price.  Rates that differ in
    nothing but the amount (same level, model and period) are summed up first, so
    the range join meets distinct periods, not rates; branch-specific prices go
    before default ones day by day."""
    level = ["tenant_id", "branch_id", "category_id"]
    lines = rate_lines(rates.where(F.col("is_active")), details, bands)
    sums = {f"{kind}_{name}": c for name, band in (("daily", _daily()), ("weekly", _weekly()), ("monthly", _monthly()))
            for kind, c in zip(("cents", "n"), _cents(band), strict=True)}
    periods = lines.groupBy(*level, "model_id", "start_date", "end_date").agg(*[c.alias(n) for n, c in sums.items()])
    days = cells.select("tenant_id", "category_id").distinct().withColumn("price_date", F.explode(F.sequence(F.lit(low), F.lit(high))))
    held = interval_join(days, periods, "price_date", "start_date", "end_date", low, high, ("tenant_id", "category_id"))
    priced = held.groupBy(*level, "price_date").agg(
        *[rnd(F.sum(f"cents_{b}") / F.nullif(F.sum(f"n_{b}"), F.lit(0)) / 100.0, 4).alias(f"{b}_rate") for b in ("daily", "weekly", "monthly")],
        F.countDistinct("model_id").alias("model_count"))
    cols = ["daily_rate", "weekly_rate", "monthly_rate", "model_count"]
    default = priced.where(F.col("branch_id").isNull()).select("tenant_id", "category_id", "price_date", *[F.col(c).alias(f"d_{c}") for c in cols])
    grid = cells.select(*level).withColumn("price_date", F.explode(F.sequence(F.lit(low), F.lit(high))))
    own = F.col("model_count").isNotNull()
    return (grid.join(priced.where(F.col("branch_id").isNotNull()), [*level, "price_date"], "left")
            .join(default, ["tenant_id", "category_id", "price_date"], "left")
            .where(own | F.col("d_model_count").isNotNull())
            .select(*level, "price_date", *[F.when(own, F.col(c)).otherwise(F.col(f"d_{c}")).alias(c) for c in cols],
                    F.when(own, "branch_specific").otherwise("default").alias("source")))


def model_prices(rates: DataFrame, details: DataFrame, bands: DataFrame, day: dt.date) -> DataFrame:
    """AGG-07: per model, max rate per band and the effective span (open
    end when any rate of the model is open-ended)."""
    eff = effective_on(rates, day)
    lines = rate_lines(eff, details, bands)
    p = period_pivot(lines, ["tenant_id", "model_id", "category_id"], F.max, 2)
    span = eff.groupBy("tenant_id", "model_id", "category_id").agg(
        F.min("start_date").alias("effective_from"),
        F.when(F.max(F.col("end_date").isNull().cast("int")) == 1, F.lit(None).cast("date"))
         .otherwise(F.max("end_date")).alias("effective_until"))
    return p.join(span, ["tenant_id", "model_id", "category_id"])


def band_price_stats(lines: DataFrame) -> DataFrame:
    """AGG-10: avg / min / max rate per category and duration band."""
    return lines.groupBy("tenant_id", "category_id", "from_days", "to_days").agg(
        rnd(cents_avg("rate"), 4).alias("avg_rate"), F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"), F.count(F.lit(1)).alias("rate_count"))


def price_summary(prices: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """AGG-09: categories found, models summed, overall daily range."""
    return prices.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("categories_found"),
        F.sum("model_count").alias("total_models"),
        F.min("daily_rate").alias("min_daily_rate"),
        F.max("daily_rate").alias("max_daily_rate"),
        F.array_sort(F.collect_list(F.struct("category_id", "daily_rate"))).alias("per_category"))


def historical_mean_price(fact: DataFrame) -> DataFrame:
    """AGG-23: mean of positive daily average prices per series."""
    return fact.where(F.col("avg_base_price_paid") > 0).groupBy("tenant_id", "branch_id", "category_id").agg(
        rnd(F.avg("avg_base_price_paid"), 4).alias("historical_mean_price"))


def resolve_base_rates(cells: DataFrame, config_prices: DataFrame, hist: DataFrame,
                       categories: DataFrame, generic: float = 150.0) -> DataFrame:
    """PRC-03: daily base = configured rate -> historical mean -> category
    default -> generic; weekly/monthly from the config or 6x / 25x daily."""
    cfg = config_prices.select("tenant_id", "branch_id", "category_id",
                               F.col("daily_rate").alias("c_daily"), F.col("weekly_rate").alias("c_weekly"),
                               F.col("monthly_rate").alias("c_monthly"))
    j = (cells.join(cfg, ["tenant_id", "branch_id", "category_id"], "left")
              .join(hist, ["tenant_id", "branch_id", "category_id"], "left")
              .join(F.broadcast(categories.select("category_id", "default_daily_rate")), "category_id", "left"))
    use_cfg = F.col("c_daily").isNotNull() & (F.col("c_daily") != 0)
    daily = F.when(use_cfg, F.col("c_daily")).otherwise(
        F.coalesce(F.when(F.col("historical_mean_price") != 0, F.col("historical_mean_price")),
                   F.col("default_daily_rate"), F.lit(generic)))
    src = (F.when(use_cfg, F.lit("config"))
            .when(F.col("historical_mean_price").isNotNull() & (F.col("historical_mean_price") != 0), F.lit("history"))
            .when(F.col("default_daily_rate").isNotNull(), F.lit("category_default"))
            .otherwise(F.lit("generic")))
    out = j.select(*cells.columns, daily.alias("base_daily"), src.alias("base_source"),
                   F.when(use_cfg, F.col("c_weekly")).alias("_w"), F.when(use_cfg, F.col("c_monthly")).alias("_m"))
    return out.select(*cells.columns, rnd("base_daily", 4).alias("base_daily"),
                      rnd(F.coalesce(F.when(F.col("_w") != 0, F.col("_w")), F.col("base_daily") * 6), 4).alias("base_weekly"),
                      rnd(F.coalesce(F.when(F.col("_m") != 0, F.col("_m")), F.col("base_daily") * 25), 4).alias("base_monthly"),
                      "base_source")
