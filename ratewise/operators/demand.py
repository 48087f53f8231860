"""Daily demand fact (FLT-01, FLT-04, JN-01, AGG-01).

The reference inserts the fact with one INSERT..SELECT per tenant and
date range.  Here it is one DataFrame: filter (pushed into the scan),
dimension join, one grouped aggregation with map-side partial
aggregation, calendar columns computed after the aggregation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.calendar import FACT_WEEKEND, calendar_parts
from ratewise.functions.mathx import rnd

EXECUTED_STATUS = 211
SERIES_KEYS = ["tenant_id", "branch_id", "category_id"]
FACT_KEYS = SERIES_KEYS + ["demand_date"]


def executed_rentals(contracts: DataFrame, start: dt.date | None = None,
                     end: dt.date | None = None, tenant_id: int | None = None,
                     status_id: int = EXECUTED_STATUS) -> DataFrame:
    """FLT-01: executed contracts of a tenant starting in ``[start, end]``."""
    cond = F.col("status_id") == status_id
    if tenant_id is not None:
        cond &= F.col("tenant_id") == tenant_id
    if start is not None:
        cond &= F.col("start_date") >= F.lit(start)
    if end is not None:
        cond &= F.col("start_date") <= F.lit(end)
    return contracts.where(cond)


def with_category(contracts: DataFrame, vehicles: DataFrame) -> DataFrame:
    """JN-01: contract -> vehicle -> model/category inner join chain.

    The vehicle table grows with the fleet, so no broadcast is forced;
    Spark picks broadcast or a shuffle join from the measured size (AQE).
    """
    v = vehicles.select("tenant_id", "vehicle_id", "model_id", "category_id")
    return contracts.join(v, ["tenant_id", "vehicle_id"], "inner")


def in_scope(df: DataFrame, branches: DataFrame | None = None,
             categories: DataFrame | None = None) -> DataFrame:
    """FLT-04: ``branch_id IN (SELECT ...) AND category_id IN (SELECT ...)``.

    Written as left-semi joins against the (small) scope lists.
    """
    if branches is not None:
        df = df.join(F.broadcast(branches.select("branch_id").distinct()), "branch_id", "left_semi")
    if categories is not None:
        df = df.join(F.broadcast(categories.select("category_id").distinct()), "category_id", "left_semi")
    return df


def daily_demand(executed: DataFrame, weekend_days=FACT_WEEKEND) -> DataFrame:
    """AGG-01: rentals and rate statistics per tenant x branch x category x day."""
    agg = (
        executed.groupBy("tenant_id", "branch_id", "category_id",
                         F.col("start_date").alias("demand_date"))
        .agg(F.count(F.lit(1)).alias("executed_rentals_count"),
             F.avg("daily_rate").alias("avg_base_price_paid"),
             F.min("daily_rate").alias("min_base_price_paid"),
             F.max("daily_rate").alias("max_base_price_paid"))
    )
    return agg.select(
        *FACT_KEYS,
        "executed_rentals_count",
        rnd("avg_base_price_paid", 4).alias("avg_base_price_paid"),
        rnd("min_base_price_paid", 4).alias("min_base_price_paid"),
        rnd("max_base_price_paid", 4).alias("max_base_price_paid"),
        *calendar_parts("demand_date", weekend_days),
    )


def build_daily_demand(d, start=None, end=None, scope_branches=None, scope_categories=None,
                       weekend_days=FACT_WEEKEND) -> DataFrame:
    """FLT-01 -> JN-01 -> FLT-04 -> AGG-01 over a :class:`Domain`."""
    ex = executed_rentals(d.contracts, start, end, d.tenant_id)
    ex = with_category(ex, d.vehicles)
    ex = in_scope(ex, scope_branches, scope_categories)
    return daily_demand(ex, weekend_days)
