"""Queries for recommendation versions and the approval workflow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd_sql as R
from ratewise.functions.text import localized_name
from ratewise.operators import recommend as rc
from ratewise.plans import params as P  # noqa: F401
from ratewise.plans import recommend_plans  # noqa: F401  (registers shared views)
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.registry import query
from ratewise.sources.fixed import CATEGORIES

register_view("rec_history", f"""
    SELECT g.tenant_id, g.run_date, g.branch_id, g.category_id, g.forecast_date, g.source_id, g.priority,
           g.rec_daily, g.premium_discount_pct, c.default_min_price AS guardrail_min_price,
           c.default_max_discount_pct AS guardrail_max_discount_pct,
           c.default_max_premium_pct AS guardrail_max_premium_pct,
           CASE g.st WHEN 'F' THEN 'approved' WHEN 'O' THEN 'skipped' ELSE 'pending' END AS status
    FROM (SELECT tenant_id, run_date, branch_id, category_id, forecast_date, max(o_orderkey) AS source_id,
                 arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_orderpriority, o_orderkey) AS priority,
                 arg_max(rec_daily, o_orderkey) AS rec_daily, arg_max(pct, o_orderkey) AS premium_discount_pct
          FROM (SELECT 1 AS tenant_id, CAST(o_orderdate AS DATE) AS run_date, c_nationkey AS branch_id,
                       CAST(o_orderkey % 6 + 1 AS INTEGER) AS category_id,
                       CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS forecast_date,
                       o_orderkey, o_orderstatus, o_orderpriority,
                       {R('o_totalprice / 1000.0', 2)} AS rec_daily, CAST(o_orderkey % 81 - 30 AS DOUBLE) AS pct
                FROM orders JOIN customer ON o_custkey = c_custkey)
          GROUP BY 1, 2, 3, 4, 5) g
    JOIN categories c ON c.category_id = g.category_id""", ("categories",))

KEY = "tenant_id, branch_id, category_id, forecast_date"
COLS = ("tenant_id, run_date, branch_id, category_id, forecast_date, rec_daily, premium_discount_pct, status")
REVIEW_DATE = dt.date(1998, 6, 15)
BULK_FROM, BULK_TO = dt.date(1998, 1, 1), dt.date(1998, 12, 31)


def _hist(d):
    return d.rec_history


def _cols(df):
    return df.select(*[c.strip() for c in COLS.split(",")])


@query("win_09", with_views(f"""
    SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY run_date DESC) AS rn
                        FROM rec_history) WHERE rn = 1""", "rec_history"))
def win_09(d):
    """WIN-09: latest version (run_date) per tenant, branch, category, date."""
    return _cols(rc.latest_version(_hist(d)))


@query("jn_10", with_views(f"""
    SELECT {', '.join('h.' + c.strip() for c in COLS.split(','))} FROM rec_history h
    JOIN (SELECT {KEY}, max(run_date) AS run_date FROM rec_history GROUP BY {KEY}) m
      ON m.tenant_id = h.tenant_id AND m.branch_id = h.branch_id AND m.category_id = h.category_id
     AND m.forecast_date = h.forecast_date AND m.run_date = h.run_date""", "rec_history"))
def jn_10(d):
    """JN-10: the latest-version view as a join to the aggregated subquery,
    written as a window (no self-join)."""
    return _cols(rc.latest_run(_hist(d), rc.REC_KEY))


@query("win_10", with_views(f"""
    SELECT {COLS} FROM (SELECT *, max(run_date) OVER (PARTITION BY tenant_id, branch_id, category_id) AS mx
                        FROM rec_history) WHERE run_date = mx""", "rec_history"))
def win_10(d):
    """WIN-10: rows of the latest run per branch x category."""
    return _cols(rc.latest_run(_hist(d), ["tenant_id", "branch_id", "category_id"]))


@query("jn_11", with_views(f"""
    SELECT {COLS} FROM (SELECT *, max(run_date) OVER (PARTITION BY tenant_id) AS mx FROM rec_history)
    WHERE run_date = mx""", "rec_history"))
def jn_11(d):
    """JN-11: ``run_date = (SELECT max(run_date))`` per tenant, as a window max."""
    return _cols(rc.latest_run(_hist(d), ["tenant_id"]))


DECISIONS_SQL = """
    SELECT h.*, CASE WHEN priority = '1-URGENT' THEN 'approved' ELSE 'skipped' END AS d_status
    FROM rec_history h WHERE priority IN ('1-URGENT', '5-LOW')"""


def _decisions(d):
    h = _hist(d)
    dec = h.where(F.col("priority").isin("1-URGENT", "5-LOW")).select(
        *rc.REC_KEY, "run_date",
        F.when(F.col("priority") == "1-URGENT", "approved").otherwise("skipped").alias("status"),
        F.lit("ops").alias("decided_by"), F.col("run_date").alias("decided_at"),
        F.when(F.col("priority") == "5-LOW", F.lit("low priority")).alias("reason"))
    return dec


@query("prc_08", with_views(f"""
    SELECT h.tenant_id, h.run_date, h.branch_id, h.category_id, h.forecast_date, h.rec_daily,
           h.premium_discount_pct, coalesce(x.d_status, h.status) AS status,
           CASE WHEN x.d_status IS NOT NULL THEN 'ops' END AS decided_by,
           CASE WHEN x.d_status IS NOT NULL THEN x.run_date END AS decided_at,
           CASE WHEN x.d_status = 'skipped' THEN 'low priority' END AS reason
    FROM rec_history h LEFT JOIN ({DECISIONS_SQL}) x
      ON x.tenant_id = h.tenant_id AND x.branch_id = h.branch_id AND x.category_id = h.category_id
     AND x.forecast_date = h.forecast_date AND x.run_date = h.run_date""", "rec_history"))
def prc_08(d):
    """PRC-08: approve / skip decisions applied by key (unmatched rows unchanged)."""
    out = rc.apply_decisions(_cols(_hist(d)).withColumn("decided_by", F.lit(None).cast("string"))
                             .withColumn("decided_at", F.lit(None).cast("date"))
                             .withColumn("reason", F.lit(None).cast("string")), _decisions(d))
    return out


@query("prc_09", with_views(f"""
    SELECT {COLS.replace('status', "CASE WHEN ch THEN 'approved' ELSE status END AS status")}, ch AS changed
    FROM (SELECT *, status = 'pending' AND category_id = 1
                    AND forecast_date BETWEEN DATE '{BULK_FROM}' AND DATE '{BULK_TO}' AS ch FROM rec_history)""",
                            "rec_history"))
def prc_09(d):
    """PRC-09: bulk approve pending rows of a category and date range."""
    b = rc.bulk_approve(_cols(_hist(d)), category_id=1, start=BULK_FROM, end=BULK_TO)
    return b.select(*[c.strip() for c in COLS.split(",")], "changed")


@query("prc_10", with_views(f"""
    SELECT r.tenant_id, r.run_date, r.branch_id, r.category_id, r.forecast_date, r.rec_daily, r.status,
           coalesce(CASE WHEN json_valid(b.branch_name) THEN json_extract_string(b.branch_name, '$.ar') END,
                    CASE WHEN json_valid(b.branch_name) THEN json_extract_string(b.branch_name, '$.en') END,
                    b.branch_name) AS branch_label, c.category_name
    FROM (SELECT *, max(run_date) OVER (PARTITION BY tenant_id, branch_id, category_id) AS mx
          FROM rec_history WHERE forecast_date >= DATE '{REVIEW_DATE}') r
    JOIN branches b ON b.tenant_id = r.tenant_id AND b.branch_id = r.branch_id
    JOIN categories c ON c.category_id = r.category_id
    WHERE r.run_date = r.mx""", "rec_history", "branches", "categories"))
def prc_10(d):
    """PRC-10: recommendations from a start date on the latest run per
    cell, with localized branch names."""
    h = _hist(d).where(F.col("forecast_date") >= F.lit(REVIEW_DATE))
    lat = rc.latest_run(h, ["tenant_id", "branch_id", "category_id"])
    b = d.branches.select("tenant_id", "branch_id", localized_name("branch_name").alias("branch_label"))
    j = lat.join(F.broadcast(b), ["tenant_id", "branch_id"]).join(
        F.broadcast(d.categories.select("category_id", "category_name")), "category_id")
    return j.select("tenant_id", "run_date", "branch_id", "category_id", "forecast_date", "rec_daily", "status",
                    "branch_label", "category_name")


@query("prc_11", with_views(f"""
    SELECT {COLS} FROM (SELECT *, max(run_date) OVER (PARTITION BY tenant_id) AS mx FROM rec_history
                        WHERE forecast_date = DATE '{REVIEW_DATE}') WHERE run_date = mx""", "rec_history"))
def prc_11(d):
    """PRC-11: every recommendation for one date from the latest run."""
    h = _hist(d).where(F.col("forecast_date") == F.lit(REVIEW_DATE))
    return _cols(rc.latest_run(h, ["tenant_id"]))


@query("prc_12", with_views(f"""
    SELECT {COLS} FROM rec_history WHERE forecast_date BETWEEN DATE '{BULK_FROM}' AND DATE '{BULK_TO}'""",
                            "rec_history"))
def prc_12(d):
    """PRC-12: recommendation and decision history over a date range."""
    h = _hist(d).where(F.col("forecast_date").between(F.lit(BULK_FROM), F.lit(BULK_TO)))
    return _cols(h).orderBy("forecast_date", "branch_id", "category_id", "run_date")


@query("prc_13", with_views("""
    SELECT tenant_id, run_date, branch_id, category_id, forecast_date, rec_daily, premium_discount_pct
    FROM rec_history WHERE status = 'approved'
      AND (rec_daily < guardrail_min_price - 0.005 OR premium_discount_pct > guardrail_max_premium_pct + 1e-9
           OR premium_discount_pct < -guardrail_max_discount_pct - 1e-9)""", "rec_history"))
def prc_13(d):
    """PRC-13: approvals that break the guardrails (to be rejected)."""
    v = rc.guardrail_violations(_hist(d))
    return v.select("tenant_id", "run_date", "branch_id", "category_id", "forecast_date", "rec_daily",
                    "premium_discount_pct")


@query("prc_14", with_views(f"""
    SELECT g.tenant_id, g.branch_id, g.category_id, r.run_date, r.rec_daily, r.status,
           r.rec_daily IS NOT NULL AS has_card, p.base_daily,
           r.rec_daily <= r.guardrail_min_price OR r.premium_discount_pct >= r.guardrail_max_premium_pct
             OR r.premium_discount_pct <= -r.guardrail_max_discount_pct AS guardrail_applied
    FROM cells g LEFT JOIN base_rates p ON p.tenant_id = g.tenant_id AND p.branch_id = g.branch_id
      AND p.category_id = g.category_id LEFT JOIN (
        SELECT * FROM (SELECT *, max(run_date) OVER (PARTITION BY tenant_id, branch_id, category_id) AS mx
                       FROM rec_history WHERE forecast_date = DATE '{REVIEW_DATE}') WHERE run_date = mx) r
      ON r.tenant_id = g.tenant_id AND r.branch_id = g.branch_id AND r.category_id = g.category_id""",
                            "cells", "rec_history", "base_rates"))
def prc_14(d):
    """PRC-14: daily review cards -- every branch x category for a date,
    base against recommended price of the latest run and whether a guardrail
    was reached; NULL card when there is no recommendation."""
    from ratewise.plans.competitor_plans import base_rates
    h = _hist(d).where(F.col("forecast_date") == F.lit(REVIEW_DATE))
    lat = rc.latest_run(h, ["tenant_id", "branch_id", "category_id"])
    grid = rc.cell_grid(d.branches, [c[0] for c in CATEGORIES])
    j = grid.join(lat, ["tenant_id", "branch_id", "category_id"], "left")
    j = j.join(base_rates(d).select("tenant_id", "branch_id", "category_id", "base_daily"),
               ["tenant_id", "branch_id", "category_id"], "left")
    clamped = ((F.col("rec_daily") <= F.col("guardrail_min_price"))
               | (F.col("premium_discount_pct") >= F.col("guardrail_max_premium_pct"))
               | (F.col("premium_discount_pct") <= -F.col("guardrail_max_discount_pct")))
    return j.select("tenant_id", "branch_id", "category_id", "run_date", "rec_daily", "status",
                    F.col("rec_daily").isNotNull().alias("has_card"), "base_daily", clamped.alias("guardrail_applied"))


@query("prc_15", with_views(f"""
    SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, branch_id, category_id
                                                     ORDER BY forecast_date, run_date DESC) AS rn
                        FROM rec_history WHERE status = 'pending') WHERE rn = 1""", "rec_history"))
def prc_15(d):
    """PRC-15: category-wide skip targets the first pending day per cell."""
    p = _hist(d).where(F.col("status") == "pending")
    w = Window.partitionBy("tenant_id", "branch_id", "category_id").orderBy("forecast_date", F.col("run_date").desc())
    return _cols(p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


@query("agg_18", with_views(f"""
    SELECT tenant_id, run_date, count(*) AS total,
           CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
           CAST(sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved,
           CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
           count(DISTINCT branch_id) AS branches, count(DISTINCT category_id) AS categories,
           min(forecast_date) AS min_date, max(forecast_date) AS max_date,
           {R('avg(premium_discount_pct)', 4)} AS avg_adjustment_pct
    FROM rec_history GROUP BY 1, 2""", "rec_history"))
def agg_18(d):
    """AGG-18: recommendation summary per run."""
    return rc.recommendation_summary(_hist(d))


@query("agg_30", with_views("""
    SELECT tenant_id, CAST(sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved,
           CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
           count(DISTINCT run_date) AS runs, count(*) AS generated
    FROM rec_history GROUP BY tenant_id""", "rec_history"))
def agg_30(d):
    """AGG-30: decision and run counters."""
    h = _hist(d)
    st = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return h.groupBy("tenant_id").agg(st("approved").alias("approved"), st("pending").alias("pending"),
                                      F.countDistinct("run_date").alias("runs"),
                                      F.count(F.lit(1)).alias("generated"))
