"""Domain tables of the pricing model, derived from the driver's tables.

All are lazy projections/aggregations of the parquet inputs, so their
size grows with the data and Catalyst pushes filters and column pruning
through them into the scans.

Mapping (one tenant):

* branches    <- nation x region (city = region)
* vehicles    <- part (model = brand number, category = p_type, home
                 branch and fleet status derived from key and size)
* contracts   <- lineitem x supplier (branch = supplier nation, vehicle =
                 part, start = ship date, end = start + quantity days,
                 daily rate = price / quantity, executed when status 'F')
* rates       <- part x fixed rate bands
* weather     <- orders x customer, one row per nation and order date
* holidays    <- fixed national days over the contract years
* event_signal<- events per type (= city) and day, moved back 24 years so
                 it overlaps the contract period
* listings    <- lineitem x part x supplier (competitor quotes)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd
from ratewise.sources.fixed import TENANT_ID, fixed_table
from ratewise.sources.tables import Tables

EVENT_SHIFT_MONTHS = -288


class Domain:
    """Lazily derived domain DataFrames over one data directory.

    Each property returns the same DataFrame object on every access, so a
    plan that uses a table twice has identical sub-plans and Spark reuses
    the exchange instead of recomputing it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tenant_id: int = TENANT_ID):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.tenant_id = tenant_id

    # ---- fixed tables ------------------------------------------------------
    def fixed(self, name: str) -> DataFrame:
        return fixed_table(self.spark, name)

    @cached_property
    def categories(self) -> DataFrame:
        return self.fixed("categories")

    # ---- dimensions --------------------------------------------------------
    @cached_property
    def branches(self) -> DataFrame:
        n, r = self.t.nation, self.t.region
        name = F.col("n_name")
        json_name = F.concat(F.lit('{"en":"'), name, F.lit('","ar":"فرع '), name, F.lit('"}'))
        return (
            n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(
                F.lit(self.tenant_id).alias("tenant_id"),
                F.col("n_nationkey").alias("branch_id"),
                F.when(F.col("n_nationkey") % 2 == 0, json_name).otherwise(name).alias("branch_name"),
                F.col("r_regionkey").alias("city_id"),
                F.col("r_name").alias("city_name"),
                (F.col("n_nationkey") % 2 == 0).alias("is_airport"),
                F.lit(True).alias("is_active"),
            )
        )

    @cached_property
    def vehicles(self) -> DataFrame:
        p = self.t.part
        return (
            p.join(F.broadcast(self.categories.select("p_type", "category_id")), "p_type")
            .select(
                F.lit(self.tenant_id).alias("tenant_id"),
                F.col("p_partkey").alias("vehicle_id"),
                F.substring("p_brand", 7, 8).try_cast("int").alias("model_id"),
                F.col("category_id"),
                (F.col("p_partkey") % 25).cast("int").alias("branch_id"),
                (F.lit(140) + F.col("p_size") % 17).cast("int").alias("status_id"),
                (F.col("p_size") == 50).alias("is_deleted"),
            )
        )

    # ---- facts -------------------------------------------------------------
    @cached_property
    def contracts(self) -> DataFrame:
        li, s = self.t.lineitem, self.t.supplier
        start = F.to_date("l_shipdate")
        return (
            li.join(s.select("s_suppkey", "s_nationkey"), li.l_suppkey == s.s_suppkey)
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contract_id"),
                F.lit(self.tenant_id).alias("tenant_id"),
                F.col("s_nationkey").alias("branch_id"),
                F.col("l_partkey").alias("vehicle_id"),
                start.alias("start_date"),
                F.date_add(start, F.col("l_quantity").cast("int")).alias("end_date"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("daily_rate"),
                F.col("l_returnflag").alias("contract_type"),
                F.when(F.col("l_linestatus") == "F", F.lit(211)).otherwise(F.lit(210)).alias("status_id"),
            )
        )

    @cached_property
    def rates(self) -> DataFrame:
        """Rental rates: one per part; even keys are branch-specific."""
        p = self.t.part
        return (
            p.join(F.broadcast(self.categories.select("p_type", "category_id")), "p_type")
            .select(
                F.col("p_partkey").alias("rate_id"),
                F.lit(self.tenant_id).alias("tenant_id"),
                F.substring("p_brand", 7, 8).try_cast("int").alias("model_id"),
                F.col("category_id"),
                F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 25).cast("int")).alias("branch_id"),
                F.make_date(F.lit(1994) + F.col("p_size") % 6, F.lit(1) + F.col("p_size") % 12, F.lit(1)).alias("start_date"),
                F.when(F.col("p_size") <= 25,
                       F.make_date(F.lit(1999) + F.col("p_size") % 3, F.lit(12), F.lit(31))).alias("end_date"),
                F.lit(True).alias("is_active"),
                (F.col("p_retailprice") / 10).alias("base_rate"),
            )
        )

    @cached_property
    def rate_details(self) -> DataFrame:
        """Rate x period rows (the composite-key detail table)."""
        from ratewise.sources.fixed import RATE_BANDS
        bands = F.array(*[F.struct(F.lit(pid).alias("period_id"), F.lit(float(mult)).alias("multiplier"))
                          for pid, _lo, _hi, mult in RATE_BANDS])
        return (
            self.rates.select("rate_id", "base_rate", F.explode(bands).alias("b"))
            .select("rate_id", F.col("b.period_id").alias("period_id"),
                    rnd(F.col("base_rate") * F.col("b.multiplier"), 2).alias("rate"))
        )

    @cached_property
    def weather(self) -> DataFrame:
        """Daily weather per branch, from orders of the branch's customers."""
        o, c = self.t.orders, self.t.customer
        g = (
            o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").alias("branch_id"),
                     F.to_date("o_orderdate").alias("weather_date"))
            .agg(F.sum(F.floor("o_totalprice")).alias("_tp"),
                 F.max("o_orderkey").alias("_mx"),
                 F.sum("o_orderkey").alias("_sk"),
                 F.min("o_orderkey").alias("_mn"))
        )
        t_max = F.lit(20.0) + (F.col("_tp") % 2600) / 100.0
        rain_raw = F.col("_mx") % 5000
        return g.join(F.broadcast(self.branches.select("branch_id", "city_name")), "branch_id").select(
            F.lit(self.tenant_id).alias("tenant_id"),
            "branch_id",
            "city_name",
            "weather_date",
            t_max.alias("t_max"),
            (t_max - 12.0).alias("t_min"),
            (t_max - 6.0).alias("t_mean"),
            F.when(rain_raw < 2500, F.lit(0.0)).otherwise((rain_raw - 2500) / 100.0).alias("precipitation_sum"),
            ((F.col("_sk") % 700) / 10.0).alias("wind_max"),
            (F.col("_mn") % 100).cast("int").alias("weather_code"),
        )

    @cached_property
    def contract_years(self) -> DataFrame:
        """One row per calendar year touched by the contracts (from the same
        min / max aggregate as the day spine)."""
        return self.day_bounds.select(F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("year"))

    @cached_property
    def day_bounds(self) -> DataFrame:
        """One row per tenant: first and last contract start day."""
        return self.contracts.groupBy("tenant_id").agg(
            F.min("start_date").alias("lo"), F.max("start_date").alias("hi"))

    @cached_property
    def day_spine(self) -> DataFrame:
        """Every day of the contract period, per tenant."""
        from ratewise.operators.calendar import day_spine
        return day_spine(self.day_bounds)

    @cached_property
    def city_spine(self) -> DataFrame:
        """Every day of the contract period for every branch city."""
        cities = self.branches.select("tenant_id", "city_name").distinct()
        return self.day_spine.join(F.broadcast(cities), "tenant_id")

    @cached_property
    def holidays(self) -> DataFrame:
        from ratewise.operators.calendar import fixed_holidays
        from ratewise.sources.fixed import FIXED_HOLIDAYS
        return fixed_holidays(self.contract_years, FIXED_HOLIDAYS, self.tenant_id)

    @cached_property
    def listings(self) -> DataFrame:
        """Competitor quotes: one per line item; the supplier is the
        competitor, the part gives the vehicle name and feed group."""
        return self.listings_between()

    @cached_property
    def vehicle_catalog(self) -> DataFrame:
        """Competitor vehicle names per part: a model name of the
        dictionary (by part key) followed by the part name; large parts
        carry the bare part name.  The feed group is the part type."""
        from ratewise.functions.text import MODEL_CATEGORIES
        keys = F.array(*[F.lit(k) for k, _ in MODEL_CATEGORIES])
        vname = F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(
            F.concat(F.element_at(keys, (F.col("p_partkey") % len(MODEL_CATEGORIES) + 1).cast("int")),
                     F.lit(" "), F.col("p_name")))
        return self.t.part.select("p_partkey", vname.alias("vehicle_name"),
                                  F.initcap("p_type").alias("vehicle_group"))

    def listings_between(self, start=None, end=None, catalog: DataFrame | None = None) -> DataFrame:
        """Quotes dated in [start, end]; the bounds filter the raw ship
        timestamp so the predicate reaches the parquet scan.  ``catalog``
        (default :attr:`vehicle_catalog`) may carry extra per-vehicle
        columns, e.g. the classification."""
        import datetime as dt
        li, s = self.t.lineitem, self.t.supplier
        if start is not None:
            li = li.where(F.col("l_shipdate") >= F.lit(dt.datetime.combine(start, dt.time())))
        if end is not None:
            li = li.where(F.col("l_shipdate") < F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())))
        cat = self.vehicle_catalog if catalog is None else catalog
        extra = [c for c in cat.columns if c not in ("p_partkey", "vehicle_name", "vehicle_group")]
        return (
            li.join(cat, li.l_partkey == cat.p_partkey)
            .join(s.select("s_suppkey", "s_name", "s_nationkey"), li.l_suppkey == s.s_suppkey)
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("quote_id"),
                F.lit(self.tenant_id).alias("tenant_id"),
                F.col("s_nationkey").alias("branch_id"),
                F.to_date("l_shipdate").alias("price_date"),
                F.col("s_name").alias("competitor_name"),
                "vehicle_name", "vehicle_group", *extra,
                (F.col("l_extendedprice") / 10).alias("total_price"),
                F.col("l_quantity").cast("int").alias("rental_days"),
            )
        )

    @cached_property
    def rec_history(self) -> DataFrame:
        """Versioned recommendations with workflow status, one per order:
        run = order date, cell = customer nation x (order key mod 6) + 1,
        target day = run + (order key mod 30), status from the order status
        (F approved, O skipped, P pending).  One row per natural key (the
        highest order key wins)."""
        o, c = self.t.orders, self.t.customer
        run = F.to_date("o_orderdate")
        pct = ((F.col("o_orderkey") % 81) - 30).cast("double")
        rows = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey).select(
            F.lit(self.tenant_id).alias("tenant_id"), run.alias("run_date"),
            F.col("c_nationkey").alias("branch_id"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("category_id"),
            F.date_add(run, (F.col("o_orderkey") % 30).cast("int")).alias("forecast_date"),
            F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"),
            rnd(F.col("o_totalprice") / 1000.0, 2).alias("rec_daily"), pct.alias("premium_discount_pct"))
        key = ["tenant_id", "run_date", "branch_id", "category_id", "forecast_date"]
        g = rows.groupBy(*key).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "rec_daily",
                                                     "premium_discount_pct"), "o_orderkey").alias("r"))
        st = F.col("r.o_orderstatus")
        return g.join(F.broadcast(self.categories.select("category_id", "default_min_price",
                                                         "default_max_discount_pct", "default_max_premium_pct")),
                      "category_id").select(
            *key, F.col("r.o_orderkey").alias("source_id"), F.col("r.o_orderpriority").alias("priority"),
            F.col("r.rec_daily").alias("rec_daily"), F.col("r.premium_discount_pct").alias("premium_discount_pct"),
            F.col("default_min_price").alias("guardrail_min_price"),
            F.col("default_max_discount_pct").alias("guardrail_max_discount_pct"),
            F.col("default_max_premium_pct").alias("guardrail_max_premium_pct"),
            F.when(st == "F", "approved").when(st == "O", "skipped").otherwise("pending").alias("status"))

    @cached_property
    def event_signal(self) -> DataFrame:
        from ratewise.operators.calendar import event_signal
        ev = self.t.events.select("ts", "event_type")
        ev = ev.join(F.broadcast(self.fixed("event_city")), "event_type")
        ev = ev.select(F.add_months(F.to_date("ts"), EVENT_SHIFT_MONTHS).alias("event_date"), "city_name")
        return event_signal(ev, self.tenant_id)
