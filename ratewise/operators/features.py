"""Feature store (FST-01..08, AGG-11, VAL-01).

The reference builds the table in seven committed steps (insert, three
UPDATE..FROM joins, four self-join lag updates, split).  Here it is one
lazily composed DataFrame: the fact aggregation, left joins to
de-duplicated side tables (weather per branch-day, holidays per day,
events per city-day, utilization per cell-day), one window pass for the
lags, and the split column.  Enrichment never changes the row count
because every side table is unique on its join key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd, safe_div
from ratewise.operators import demand as dm
from ratewise.operators import timeseries as ts
from ratewise.operators import utilization as ut
from ratewise.operators.calendar import MAJOR_EVENT_SCORE

RELIGIOUS_TYPES = ("religious", "islamic", "muslim")


def enrich_weather(fact: DataFrame, weather: DataFrame) -> DataFrame:
    """FST-02 / JN-05: weather columns by tenant, branch and date."""
    w = weather.select(
        "tenant_id", "branch_id", F.col("weather_date").alias("demand_date"),
        F.col("t_max").alias("temperature_max"), F.col("t_min").alias("temperature_min"),
        F.col("t_mean").alias("temperature_avg"), F.col("precipitation_sum").alias("precipitation_mm"),
        F.col("wind_max").alias("wind_speed_kmh"))
    return fact.join(w, ["tenant_id", "branch_id", "demand_date"], "left")


def holiday_flags(holidays: DataFrame) -> DataFrame:
    """FST-03 side table: one row per tenant and date, flags OR-ed."""
    rel = F.lower(F.col("holiday_type")).isin(*RELIGIOUS_TYPES)
    return holidays.groupBy("tenant_id", F.col("holiday_date").alias("demand_date")).agg(
        F.max(F.col("is_public_holiday").cast("int")).cast("boolean").alias("is_public_holiday"),
        F.max(rel.cast("int")).cast("boolean").alias("is_religious_holiday"))


def enrich_holidays(fact: DataFrame, holidays: DataFrame) -> DataFrame:
    """FST-03: public / religious holiday flags (false when no holiday)."""
    j = fact.join(holiday_flags(holidays), ["tenant_id", "demand_date"], "left")
    return (j.withColumn("is_public_holiday", F.coalesce("is_public_holiday", F.lit(False)))
             .withColumn("is_religious_holiday", F.coalesce("is_religious_holiday", F.lit(False)))
             .withColumn("is_school_holiday", F.lit(False)))


def enrich_events(fact: DataFrame, events: DataFrame, branches: DataFrame) -> DataFrame:
    """FST-04: event score of the branch's city and day; major if >= 3."""
    city = F.broadcast(branches.select("tenant_id", "branch_id", "city_name"))
    e = events.select("tenant_id", F.col("event_date").alias("demand_date"), "city_name", "event_score")
    j = fact.join(city, ["tenant_id", "branch_id"], "left").join(e, ["tenant_id", "demand_date", "city_name"], "left")
    return j.drop("city_name").withColumn(
        "has_major_event", F.coalesce(F.col("event_score") >= MAJOR_EVENT_SCORE, F.lit(False)))


def enrich_utilization(fact: DataFrame, rentals: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Fact utilization columns: vehicles on rent / fleet size (4 dp)."""
    on_rent = ut.on_rent_daily(rentals)
    fleet = ut.fleet_size(vehicles)
    u = on_rent.join(fleet, ut.CELL, "inner").select(
        *ut.CELL, F.col("day").alias("demand_date"),
        rnd(safe_div("vehicles_on_rent", "fleet_size"), 4).alias("utilization_contracts"))
    return (fact.join(u, dm.FACT_KEYS, "left")
                .withColumn("utilization_bookings", F.lit(None).cast("double")))


def build_feature_store(d, cutoff: dt.date, start=None, end=None) -> DataFrame:
    """FST-01: fact -> utilization -> weather -> holidays -> events -> lags -> split."""
    fact = dm.build_daily_demand(d, start, end)
    rentals = dm.with_category(dm.executed_rentals(d.contracts, tenant_id=d.tenant_id), d.vehicles)
    f = enrich_utilization(fact, rentals, d.vehicles)
    f = enrich_weather(f, d.weather)
    f = enrich_holidays(f, d.holidays)
    f = enrich_events(f, d.event_signal, d.branches)
    f = ts.calendar_lags(f)
    return f.withColumn("split_flag", ts.split_flag("demand_date", cutoff))


def feature_stats(fs: DataFrame) -> DataFrame:
    """AGG-11: one-pass statistics of the feature store per tenant."""
    n = F.count(F.lit(1))
    pct = lambda c: rnd(F.sum(F.when(F.col(c).isNotNull(), 1).otherwise(0)) * 100.0 / n, 2)
    y = F.col("executed_rentals_count").cast("double")
    return fs.groupBy("tenant_id").agg(
        n.alias("total_rows"),
        F.min("demand_date").alias("min_date"), F.max("demand_date").alias("max_date"),
        F.sum(F.when(F.col("split_flag") == "TRAIN", 1).otherwise(0)).alias("train_rows"),
        F.sum(F.when(F.col("split_flag") == "VALIDATION", 1).otherwise(0)).alias("validation_rows"),
        rnd(F.avg(y), 4).alias("target_avg"),
        F.min("executed_rentals_count").alias("target_min"),
        F.max("executed_rentals_count").alias("target_max"),
        rnd(F.stddev_samp(y), 4).alias("target_std"),
        pct("temperature_avg").alias("weather_pct"),
        pct("rentals_lag_1d").alias("lag_1d_pct"),
        pct("rentals_rolling_7d_avg").alias("rolling_7d_pct"),
        F.countDistinct("branch_id").alias("branches"),
        F.countDistinct("category_id").alias("categories"),
    )


def quality_gate(fs: DataFrame, min_rows: int = 1000, min_std: float = 0.1,
                 max_missing_pct: float = 50.0) -> DataFrame:
    """VAL-01: rows, target variance, both splits, price missing rate.

    One aggregation, then the four checks as rows (name, passed, value,
    threshold) through ``explode(array(struct ...))``.
    """
    a = fs.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp(F.col("executed_rentals_count").cast("double")).alias("sd"),
        F.sum(F.when(F.col("split_flag") == "TRAIN", 1).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("split_flag") == "VALIDATION", 1).otherwise(0)).alias("n_val"),
        F.sum(F.when(F.col("avg_base_price_paid").isNull(), 1).otherwise(0)).alias("n_price_null"),
    )
    miss = rnd(F.col("n_price_null") * 100.0 / F.col("n"), 4)
    sd = F.coalesce(rnd(F.col("sd"), 4), F.lit(0.0))
    chk = lambda name, ok, val, thr: F.struct(
        F.lit(name).alias("check_name"), ok.alias("passed"),
        val.cast("double").alias("value"), F.lit(thr).cast("double").alias("threshold"))
    checks = F.array(
        chk("minimum_rows", F.col("n") >= min_rows, F.col("n"), min_rows),
        chk("target_variance", F.coalesce(F.col("sd") > min_std, F.lit(False)), sd, min_std),
        chk("split_exists", (F.col("n_train") > 0) & (F.col("n_val") > 0),
            F.least(F.col("n_train"), F.col("n_val")), 1),
        chk("missing_rate", miss < max_missing_pct, miss, max_missing_pct),
    )
    return a.select("tenant_id", F.explode(checks).alias("c")).select("tenant_id", "c.*")


def model_matrix(fs: DataFrame) -> DataFrame:
    """FST-07: model-ready columns.  Dense category code (0-based, by id),
    flags as 0/1, lags NULL -> 0, temperature NULL -> 30, rain/event NULL
    -> 0, price NULL -> the exact median price of the tenant.

    The median and the distinct category list are small aggregates joined
    back (broadcast), not a window over the whole tenant.
    """
    med = fs.groupBy("tenant_id").agg(F.percentile("avg_base_price_paid", 0.5).alias("_median_price"))
    cats = fs.select("tenant_id", "category_id").distinct()
    from pyspark.sql import Window
    cats = cats.withColumn("category_code",
                           F.dense_rank().over(Window.partitionBy("tenant_id").orderBy("category_id")) - 1)
    j = fs.join(F.broadcast(med), "tenant_id").join(F.broadcast(cats), ["tenant_id", "category_id"])
    i = lambda c: F.col(c).cast("int")
    return j.select(
        "tenant_id", "branch_id", "category_id", "demand_date", "split_flag",
        F.col("executed_rentals_count").alias("target"),
        F.col("category_code").cast("int").alias("category_code"),
        "day_of_week", "day_of_month", "week_of_year", "month_of_year", "quarter",
        i("is_weekend").alias("is_weekend"), i("is_public_holiday").alias("is_public_holiday"),
        i("is_religious_holiday").alias("is_religious_holiday"), i("has_major_event").alias("has_major_event"),
        F.coalesce(F.col("rentals_lag_1d").cast("double"), F.lit(0.0)).alias("lag_1d"),
        F.coalesce(F.col("rentals_lag_7d").cast("double"), F.lit(0.0)).alias("lag_7d"),
        F.coalesce("rentals_rolling_7d_avg", F.lit(0.0)).alias("rolling_7d"),
        F.coalesce("rentals_rolling_30d_avg", F.lit(0.0)).alias("rolling_30d"),
        F.coalesce("temperature_avg", F.lit(30.0)).alias("temperature_avg"),
        F.coalesce("precipitation_mm", F.lit(0.0)).alias("precipitation_mm"),
        F.coalesce("event_score", F.lit(0.0)).alias("event_score"),
        rnd(F.coalesce("avg_base_price_paid", "_median_price"), 4).alias("price"),
    )
