"""Fleet utilization (FLT-03, PRJ-05, JN-04, JN-06, JN-12, AGG-02..05,
AGG-29, CFG-05).

Status classes come from a configuration table (RENTED / AVAILABLE /
EXCLUDED); it is a handful of rows and always broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd, safe_div

CELL = ["tenant_id", "branch_id", "category_id"]


def classify_status(vehicles: DataFrame, status_config: DataFrame) -> DataFrame:
    """PRJ-05: vehicle status -> class via the config map; unknown ids
    get class UNKNOWN and label ``Status <id>``."""
    cfg = F.broadcast(status_config.select("status_id", "status_name", "status_type"))
    return (
        vehicles.join(cfg, "status_id", "left")
        .withColumn("status_class", F.coalesce(F.col("status_type"), F.lit("UNKNOWN")))
        .withColumn("status_label", F.coalesce(F.col("status_name"),
                                               F.concat(F.lit("Status "), F.col("status_id").cast("string"))))
    )


def active_fleet(vehicles: DataFrame, status_config: DataFrame) -> DataFrame:
    """FLT-03: not soft-deleted and in an active (RENTED/AVAILABLE) status.

    A broadcast left-semi join on the status list from the config.
    """
    active = status_config.where(F.col("status_type").isin("RENTED", "AVAILABLE")).select("status_id")
    return vehicles.where(~F.col("is_deleted")).join(F.broadcast(active), "status_id", "left_semi")


def utilization(vehicles: DataFrame, status_config: DataFrame) -> DataFrame:
    """AGG-02: rented, available, total and ratio (4 dp) per branch x category.

    Cells whose vehicles are all excluded have no row.
    """
    v = classify_status(active_fleet(vehicles, status_config), status_config)
    g = v.groupBy(*CELL).agg(
        F.sum(F.when(F.col("status_class") == "RENTED", 1).otherwise(0)).alias("rented_count"),
        F.sum(F.when(F.col("status_class") == "AVAILABLE", 1).otherwise(0)).alias("available_count"),
    )
    total = F.col("rented_count") + F.col("available_count")
    return g.select(
        *CELL, "rented_count", "available_count", total.alias("total_active_fleet"),
        rnd(safe_div(F.col("rented_count"), total, 0.0), 4).alias("utilization"),
    )


def fleet_snapshot(vehicles: DataFrame, status_config: DataFrame) -> DataFrame:
    """AGG-03: vehicle count by branch, category and status with class and label."""
    v = classify_status(vehicles.where(~F.col("is_deleted")), status_config)
    return v.groupBy(*CELL, "status_id", "status_class", "status_label").agg(
        F.count(F.lit(1)).alias("vehicle_count"))


def utilization_summary(util: DataFrame) -> DataFrame:
    """AGG-04: fleet totals, min/max/avg of the cell ratios and the overall
    ratio (sum rented / sum active, not a mean of ratios), per tenant,
    plus a per-branch ratio (3 dp) as an array of structs.

    The per-branch part aggregates first, so the array has one entry per
    branch (bounded by the branch count).
    """
    per_branch = util.groupBy("tenant_id", "branch_id").agg(
        F.sum("rented_count").alias("r"), F.sum("total_active_fleet").alias("t"))
    per_branch = per_branch.select(
        "tenant_id", F.struct("branch_id", rnd(safe_div("r", "t", 0.0), 3).alias("utilization")).alias("b"))
    branches = per_branch.groupBy("tenant_id").agg(F.array_sort(F.collect_list("b")).alias("by_branch"))
    tot = util.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("total_active_fleet").alias("total_fleet"),
        F.sum("rented_count").alias("total_rented"),
        F.sum("available_count").alias("total_available"),
        F.min("utilization").alias("min_utilization"),
        F.max("utilization").alias("max_utilization"),
        rnd(F.avg("utilization"), 4).alias("avg_utilization"),
    ).withColumn("overall_utilization", rnd(safe_div("total_rented", "total_fleet", 0.0), 4))
    return tot.join(branches, "tenant_id")


def fleet_size(vehicles: DataFrame) -> DataFrame:
    """AGG-05: distinct vehicles per branch x category (non-deleted)."""
    return vehicles.where(~F.col("is_deleted")).groupBy(*CELL).agg(
        F.countDistinct("vehicle_id").alias("fleet_size"))


def on_rent_at(rentals: DataFrame, fleet: DataFrame, day: dt.date) -> DataFrame:
    """JN-06 (one day): fleet per cell left-joined to vehicles on rent on
    ``day`` (start <= day and (end is null or end >= day)), rented 0 when
    none; utilization = rented / fleet.

    ``rentals`` are executed contracts with category; ``fleet`` is the
    AGG-05 output.  The on-rent side is a filter + distinct count.
    """
    d = F.lit(day)
    active = rentals.where((F.col("start_date") <= d) & (F.col("end_date").isNull() | (F.col("end_date") >= d)))
    rented = active.groupBy(*CELL).agg(F.countDistinct("vehicle_id").alias("rented_vehicles"))
    j = fleet.join(rented, CELL, "left")
    rv = F.coalesce(F.col("rented_vehicles"), F.lit(0))
    return j.select(*CELL, F.col("fleet_size").alias("total_vehicles"), rv.alias("rented_vehicles"),
                    rnd(safe_div(rv, "fleet_size", 0.0), 4).alias("utilization"))


def on_rent_daily(rentals: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """JN-06 (every day): distinct vehicles on rent per cell and day.

    A window over each (cell, vehicle) in order of the start leaves of a
    contract the days that no earlier one covers, so overlapping contracts
    count once and no table of all vehicles' days is held: the sort spills.
    What is left is one step up and one down, summed per (cell, day) on the
    map side; a running sum over a cell's steps is the count, which holds
    until the next step.  The window hashes on the vehicle too, so a hot cell
    is spread over many tasks.  A contract without an end lasts until ``end``
    (and has no days if that is not given).
    """
    lo = F.col("start_date") if start is None else F.greatest(F.col("start_date"), F.lit(start))
    hi = F.col("end_date") if end is None else F.least(F.col("end_date"), F.lit(end))
    spans = rentals.select(*CELL, "vehicle_id", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    earlier = Window.partitionBy(*CELL, "vehicle_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("hi").over(earlier)
    new = spans.select(*CELL, "vehicle_id", F.greatest("lo", F.date_add(covered, 1)).alias("lo"), "hi").where("lo <= hi")
    step = lambda day, n: F.struct(F.col(day).alias("day") if n > 0 else F.date_add(day, 1).alias("day"), F.lit(n).alias("n"))
    steps = new.select(*CELL, "vehicle_id", F.explode(F.array(step("lo", 1), step("hi", -1))).alias("s")).select(*CELL, "vehicle_id", "s.*")
    change = steps.groupBy(*CELL, "day").agg(F.sum("n").alias("spans"),
                                             F.sum(F.when(F.col("vehicle_id").isNotNull(), F.col("n")).otherwise(0)).alias("vehicles"))
    by_day = Window.partitionBy(*CELL).orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = change.select(*CELL, "day", F.lead("day").over(by_day).alias("next"), F.sum("spans").over(so_far).alias("spans"),
                         F.sum("vehicles").over(so_far).alias("vehicles_on_rent")).where("spans > 0")
    return runs.select(*CELL, F.explode(F.expr("sequence(day, date_sub(next, 1))")).alias("day"), "vehicles_on_rent")


def status_distribution(vehicles: DataFrame, status_config: DataFrame, by: list[str]) -> DataFrame:
    """AGG-29: vehicles per status (with label), share of the group total.

    The share's denominator is a window sum over the *aggregated* rows.
    """
    v = classify_status(vehicles.where(~F.col("is_deleted")), status_config)
    g = v.groupBy(*by, "status_id", "status_label").agg(F.count(F.lit(1)).alias("vehicle_count"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return g.withColumn("share_pct", rnd(F.col("vehicle_count") * 100.0 / F.sum("vehicle_count").over(w), 2))


def status_groups(status_config: DataFrame, keys=()) -> DataFrame:
    """CFG-05: status ids grouped by class (and ``keys``), sorted."""
    return status_config.groupBy(*keys, "status_type").agg(
        F.array_sort(F.collect_list("status_id")).alias("status_ids"),
        F.count(F.lit(1)).alias("n_statuses"))


def status_vs_contracts(vehicles: DataFrame, rentals: DataFrame, day: dt.date) -> DataFrame:
    """JN-12: each vehicle's fleet status against the number of contracts
    active on ``day`` (left join on a composite predicate + count)."""
    d = F.lit(day)
    act = rentals.where((F.col("start_date") <= d) & (F.col("end_date") >= d)).groupBy(
        "tenant_id", "vehicle_id").agg(F.count(F.lit(1)).alias("active_contracts"))
    j = vehicles.where(~F.col("is_deleted")).join(act, ["tenant_id", "vehicle_id"], "left")
    n = F.coalesce(F.col("active_contracts"), F.lit(0))
    return j.groupBy("status_id").agg(
        F.count(F.lit(1)).alias("vehicles"),
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("with_active_contract"),
        F.sum(n).alias("active_contracts"))
