"""Several tenants, derived from the driver's tables (SRC-01).

A tenant is a region's rental company: its branches are the region's nations,
its contracts those of its branches, its catalogue all parts, each in a
category of its own (so vehicle ids repeat between tenants).  Configuration is
a history of changes, one per order or customer; the latest change of a key is
in force.

Tables are written partitioned by ``tenant_id``, so a scan for one tenant reads
that tenant's folder, and a join with chosen tenants prunes the others while
the query runs.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.sinks.io import new_table, write_partitioned
from ratewise.sources.domain import Domain
from ratewise.sources.fixed import CATEGORIES
from ratewise.sources.tables import load

#: Names under which weights are configured, one of them an alias.
WEIGHT_NAMES = ("utilization", "forecast", "competitor", "weather", "holiday", "demand_forecast")
CONFIGURED_TYPES = ("economy", "Compact", "standard", "fullsize", "SUV", "luxury", "van")
STATUS_TYPES = ("AVAILABLE", "RENTED", "EXCLUDED")
SETTING_TYPES = ("int", "float", "bool", "string", "json")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key in the order of ``by``; one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


class Tenants:
    """Tenants' tables over a :class:`Domain`."""

    def __init__(self, d: Domain):
        self.d = d
        self._paths: dict[str, str] = {}

    @cached_property
    def tenants(self) -> DataFrame:
        return self.d.t.region.select((F.col("r_regionkey") + 1).alias("tenant_id"), F.col("r_name").alias("tenant_name"),
                                      (F.col("r_regionkey") % 4 != 1).alias("is_active"))

    @cached_property
    def branches(self) -> DataFrame:
        """25 nations: broadcast where joined."""
        return self.d.t.nation.select((F.col("n_regionkey") + 1).alias("tenant_id"), F.col("n_nationkey").alias("branch_id"),
                                      F.col("n_name").alias("branch_name"))

    @cached_property
    def contracts(self) -> DataFrame:
        owner = self.branches.select("tenant_id", "branch_id")
        return self.d.contracts.drop("tenant_id").join(F.broadcast(owner), "branch_id")

    @cached_property
    def vehicles(self) -> DataFrame:
        """Every tenant's catalogue: all parts, the category moved on by tenant."""
        v = self.d.vehicles.select("vehicle_id", "category_id", "model_id")
        moved = (F.col("category_id") + F.col("tenant_id") - 2) % len(CATEGORIES) + 1
        return v.crossJoin(F.broadcast(self.tenants.select("tenant_id"))).select(  # a row per region: five
            "tenant_id", "vehicle_id", "model_id", moved.cast("int").alias("category_id"))

    @cached_property
    def _changes(self) -> DataFrame:
        o, c = self.d.t.orders, self.d.t.customer
        owned = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey)
        return owned.join(F.broadcast(self.branches), F.col("c_nationkey") == F.col("branch_id")).select(
            "tenant_id", "branch_id", F.col("o_orderkey").alias("change_id"), F.to_date("o_orderdate").alias("changed_on"),
            F.col("o_custkey").alias("n"), F.col("o_orderstatus").alias("status"))

    def weights(self, as_of: dt.date) -> DataFrame:
        """The weight rows in force on a day: (tenant, signal name), the weight and whether it is enabled."""
        name = F.element_at(F.array(*[F.lit(n) for n in WEIGHT_NAMES]), (F.col("change_id") % len(WEIGHT_NAMES) + 1).cast("int"))
        rows = self._changes.where(F.col("changed_on") <= F.lit(as_of)).select(
            "tenant_id", name.alias("signal_name"), ((F.col("n") % 50) / 100.0).alias("weight"), (F.col("status") != "P").alias("is_enabled"),
            "changed_on", "change_id")
        return latest(rows, ["tenant_id", "signal_name"], ["changed_on", "change_id"]).drop("changed_on", "change_id")

    def guardrails(self, as_of: dt.date) -> DataFrame:
        """The guardrail rows in force on a day, per tenant, branch and category
        (NULL: all); fields may be zero or NULL, rows inactive."""
        key = F.col("change_id")
        rows = self._changes.where(F.col("changed_on") <= F.lit(as_of)).select(
            "tenant_id", F.when(key % 3 == 0, F.col("branch_id")).alias("branch_id"),
            F.when(key % 7 != 0, (key % 7).cast("int")).alias("category_id"),
            F.when(F.col("n") % 5 != 0, (F.col("n") % 4 * 60).cast("double")).alias("min_price"), (F.col("n") % 41).cast("double").alias("max_discount_pct"),
            F.when(key % 13 != 0, (key % 61).cast("double")).alias("max_premium_pct"), F.lit(None).cast("double").alias("max_price"),
            (F.col("status") == "F").alias("is_active"), "changed_on", "change_id")
        return latest(rows, ["tenant_id", "branch_id", "category_id"], ["changed_on", "change_id"]).drop("changed_on", "change_id")

    @cached_property
    def settings(self) -> DataFrame:
        """Key-value settings, the value a text, its type declared; some values
        are not of their type."""
        c = self.d.t.customer.join(F.broadcast(self.branches), F.col("c_nationkey") == F.col("branch_id"))
        key = F.col("c_custkey")
        kind = F.element_at(F.array(*[F.lit(t) for t in SETTING_TYPES]), (key % len(SETTING_TYPES) + 1).cast("int"))
        text = (F.when(key % 11 == 0, "n/a").when(kind == "int", F.floor("c_acctbal").cast("string")).when(kind == "float", (F.col("c_acctbal") / 4).cast("string"))
                .when(kind == "bool", F.when(key % 2 == 0, "True").otherwise("false")).when(kind == "string", F.col("c_name"))
                .otherwise(F.concat(F.lit('["'), "c_mktsegment", F.lit('",'), key.cast("string"), F.lit("]"))))
        rows = c.select("tenant_id", F.concat(F.lit("s"), (key % 40).cast("string")).alias("setting_key"), text.alias("value"), kind.alias("type"), "c_custkey")
        return latest(rows, ["tenant_id", "setting_key"], ["c_custkey"]).drop("c_custkey")

    def vehicle_types(self, as_of: dt.date) -> DataFrame:
        """Competitor vehicle types configured for categories, in force on a day;
        some inactive, some of no known type, in any case of letters."""
        kind = F.element_at(F.array(*[F.lit(t) for t in CONFIGURED_TYPES]), (F.col("change_id") % len(CONFIGURED_TYPES) + 1).cast("int"))
        rows = self._changes.where(F.col("changed_on") <= F.lit(as_of)).select(
            "tenant_id", (F.col("n") % 7).cast("int").alias("category_id"), kind.alias("vehicle_type"), (F.col("status") != "P").alias("is_active"),
            "changed_on", "change_id")
        return latest(rows, ["tenant_id", "category_id"], ["changed_on", "change_id"]).drop("changed_on", "change_id")

    def statuses(self, as_of: dt.date) -> DataFrame:
        """Vehicle statuses configured by tenants with an odd id; the others have configured none."""
        kind = F.element_at(F.array(*[F.lit(t) for t in STATUS_TYPES]), (F.col("change_id") % len(STATUS_TYPES) + 1).cast("int"))
        rows = self._changes.where((F.col("changed_on") <= F.lit(as_of)) & (F.col("tenant_id") % 2 == 1)).select(
            "tenant_id", (F.col("n") % 17 + 140).cast("int").alias("status_id"), kind.alias("status_type"), (F.col("status") != "P").alias("is_active"),
            "changed_on", "change_id")
        return latest(rows, ["tenant_id", "status_id"], ["changed_on", "change_id"]).drop("changed_on", "change_id")

    def written(self, name: str) -> str:
        """The path of a table partitioned by tenant, written once."""
        if name not in self._paths:
            self._paths[name] = new_table(self.d.spark, f"tenant-{name}")
            write_partitioned(getattr(self, name), self._paths[name], ["tenant_id"])
        return self._paths[name]

    def scan(self, name: str, tenant_id: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """A scan of the partitioned table, of one tenant's folder alone if named."""
        return load(self.d.spark, self.written(name), tenant_id, columns)


def typed_settings(settings: DataFrame) -> DataFrame:
    """CFG-07: each value in the column of its declared type; NULL if it is not of it."""
    def of(kind: str) -> Column:
        return F.when(F.col("type") == kind, F.col("value"))

    flag = F.lower(of("bool"))
    return settings.select(
        "tenant_id", "setting_key", of("int").try_cast("bigint").alias("int_value"), of("float").try_cast("double").alias("float_value"),
        F.when(flag.isin("true", "false"), flag == "true").alias("bool_value"), of("string").alias("string_value"),
        F.json_array_length(of("json")).alias("json_items"))


def default_where_empty(config: DataFrame, defaults: DataFrame, owners: DataFrame, owner: str = "tenant_id") -> DataFrame:
    """CFG-05: each owner's configured rows, or, of an owner without any, all
    default rows.  ``defaults`` is a small fixed table."""
    without = owners.select(owner).distinct().join(config.select(owner).distinct(), owner, "left_anti")
    return config.select(owner, *defaults.columns).unionByName(without.crossJoin(F.broadcast(defaults)))


def feed_categories(cells: DataFrame, types: DataFrame, dictionary: DataFrame, default_type: str, default_category: str) -> DataFrame:
    """CMP-06: category -> configured vehicle type (active rows, else the
    default) -> the feed's category of that type (any case, else the default)."""
    active = types.where("is_active").select("tenant_id", "category_id", "vehicle_type")
    typed = cells.join(active, ["tenant_id", "category_id"], "left").withColumn("vehicle_type", F.coalesce("vehicle_type", F.lit(default_type)))
    words = F.broadcast(dictionary.select(F.col("vehicle_type").alias("_type"), "feed_category"))  # a fixed vocabulary
    return typed.join(words, F.lower("vehicle_type") == F.col("_type"), "left").drop("_type").withColumn(
        "feed_category", F.coalesce("feed_category", F.lit(default_category)))
