"""Signals and price recommendations (SIG-*, PRC-01..15, JN-09..11,
WIN-09, WIN-10).

The reference loops branch x category x day and issues five signal
SELECTs and one MERGE per cell-day.  Here a recommendation run is one
plan: a horizon spine (cells x days), left joins to the signal tables
(each unique on its key), the scoring expressions, and one write.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions import signals as sg
from ratewise.functions.calendar import DEFAULT_WEEKEND, is_weekend
from ratewise.functions.mathx import money, rnd

CELL = ["tenant_id", "branch_id", "category_id"]
SIGNALS = ["utilization", "forecast", "competitor", "weather", "holiday"]
SIGNAL_ALIASES = {"demand_forecast": "forecast"}


def cell_grid(branches: DataFrame, category_ids: list[int]) -> DataFrame:
    """JN-09: every branch x category (categories as a literal array)."""
    return branches.select("tenant_id", "branch_id",
                           F.explode(F.array(*[F.lit(c) for c in category_ids])).alias("category_id"))


def horizon_spine(cells: DataFrame, start: dt.date, horizon: int) -> DataFrame:
    """PRC-04: start + 0..h-1 with horizon_day 1..h for every cell."""
    return cells.select("*", F.posexplode(F.sequence(F.lit(start), F.date_add(F.lit(start), horizon - 1)))
                        .alias("_i", "forecast_date")).withColumn("horizon_day", F.col("_i") + 1).drop("_i")


def signal_weights(config: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """SIG-P: (tenant, signal_name, weight, is_enabled) rows -> one row per
    tenant with a weight column per signal; missing signals take the
    default, disabled ones weigh 0.  ``demand_forecast`` is read as
    ``forecast``; a row under the signal's own name goes before one under
    the other, and of several rows of a name the largest weight counts."""
    name = F.col("signal_name")
    for k, v in SIGNAL_ALIASES.items():
        name = F.when(name == k, F.lit(v)).otherwise(name)
    c = config.select("tenant_id", name.alias("signal_name"), (name == F.col("signal_name")).alias("own"),
                      F.when(F.col("is_enabled"), F.col("weight")).otherwise(F.lit(0.0)).alias("weight"))
    p = c.groupBy("tenant_id").pivot("signal_name", SIGNALS).agg(F.max_by("weight", F.struct("own", "weight")))
    return p.select("tenant_id", *[F.coalesce(F.col(s), F.lit(defaults[s])).alias("w_" + s) for s in SIGNALS])


def weights_check(weights: DataFrame) -> DataFrame:
    """SIG-V: weight sum and validity (|sum - 1| < .01) per tenant."""
    total = sum((F.col("w_" + s) for s in SIGNALS[1:]), F.col("w_" + SIGNALS[0]))
    return weights.select("tenant_id", rnd(total, 4).alias("weight_sum"), sg.weights_valid(total).alias("is_valid"))


def guardrail_rows(config: DataFrame, owner: list[str], cols: list[str]) -> DataFrame:
    """Per owner its greatest active row of each category (``of``, a map: at most
    one entry per category) and of all categories (``rest``)."""
    best = config.where("is_active").groupBy(*owner, F.col("category_id").cast("long").alias("_category")).agg(
        F.max(F.struct(*cols, "max_price")).alias("_row"))
    one = F.col("_category").isNull()
    return best.groupBy(*owner).agg(F.map_from_entries(F.collect_list(F.when(~one, F.struct("_category", "_row")))).alias("of"),
                                    F.max(F.when(one, F.col("_row"))).alias("rest"))


def resolve_guardrails(cells: DataFrame, config: DataFrame | None, categories: DataFrame,
                       generic=(50.0, 25.0, 50.0)) -> DataFrame:
    """PRC-02 / JN-07: per cell, the most specific active guardrail row
    (branch and category, branch, category, all); a field of it that is zero or
    NULL counts as missing and is the generic one.  Without a row the category's
    default, else the generic one.  A highest price comes from a configuration
    row alone.  Each level is an equi-join; of several rows of a level the
    greatest counts."""
    cols = ["min_price", "max_discount_pct", "max_premium_pct"]
    out, found = cells, F.lit(None)
    if config is not None:
        mine = guardrail_rows(config.where("branch_id IS NOT NULL"), ["tenant_id", "branch_id"], cols)
        general = guardrail_rows(config.where("branch_id IS NULL"), ["tenant_id"], cols)
        out = out.join(mine.withColumnsRenamed({"of": "_of_branch", "rest": "_branch"}), ["tenant_id", "branch_id"], "left")
        out = out.join(F.broadcast(general.withColumnsRenamed({"of": "_of_all", "rest": "_all"})), "tenant_id", "left")  # broadcast: a row per tenant
        of = lambda rows: F.try_element_at(rows, F.col("category_id").cast("long"))
        found = F.coalesce(of("_of_branch"), "_branch", of("_of_all"), "_all")
        out = out.withColumn("_g", found)
        found = F.col("_g")
    d = F.broadcast(categories.select("category_id", *[F.col("default_" + c).alias("_d_" + c) for c in cols]))
    out = out.join(d, "category_id", "left")
    sel = []
    for c, gen in zip(cols, generic, strict=True):
        value = F.coalesce(F.col("_d_" + c), F.lit(gen))
        if config is not None:
            value = F.when(found.isNotNull(), F.coalesce(F.nullif(found[c], F.lit(0.0)), F.lit(gen))).otherwise(value)
        sel.append(value.alias("guardrail_" + c))
    if config is not None:
        sel.append(found["max_price"].alias("guardrail_max_price"))
    return out.select(*cells.columns, *sel)


def holiday_calendar(holiday_window: DataFrame, weekend_days=DEFAULT_WEEKEND) -> DataFrame:
    """Calendar rows the holiday signal reads (Q7: built, not assumed):
    holiday flag, days to the next holiday (NULL beyond the window), no
    school-holiday feed, weekend flag."""
    dth = F.when(F.col("days_to_next_holiday") >= 0, F.col("days_to_next_holiday"))
    return holiday_window.select("tenant_id", F.col("cal_date").alias("forecast_date"), "is_holiday",
                                 dth.alias("days_to_holiday"), F.lit(False).alias("is_school_holiday"),
                                 is_weekend("cal_date", weekend_days).alias("is_weekend"))


#: The key that each input of a run is unique on.
INPUT_KEYS = {"base": CELL, "guard": CELL, "weights": ["tenant_id"], "util": CELL + ["forecast_date"], "forecast": CELL + ["forecast_date"],
              "mean_demand": CELL, "comp": CELL + ["forecast_date"], "weather": ["tenant_id", "branch_id", "forecast_date"],
              "calendar": ["tenant_id", "forecast_date"]}
#: The inputs that each signal reads.
SIGNAL_INPUTS = {"utilization": ("util",), "forecast": ("forecast", "mean_demand"), "competitor": ("base", "comp"),
                 "weather": ("weather",), "holiday": ("calendar",)}


def with_inputs(spine: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """The cell-days of the spine with the columns of ``inputs``, by name;
    a cell-day without a row of an input keeps NULLs."""
    found = {"weather": "_wx", "calendar": "_cal"}
    for name, rows in inputs.items():
        if name in found:
            rows = rows.withColumn(found[name], F.lit(True))
        spine = spine.join(rows, INPUT_KEYS[name], "left")
    return spine


def signal(name: str, weekend_days=DEFAULT_WEEKEND) -> Column:
    """SIG-U / F / C / W / H over the columns of the signal's inputs."""
    if name == "utilization":
        return sg.utilization_signal("utilization_contracts", "utilization_bookings")
    if name == "forecast":
        return sg.forecast_signal("forecast_demand", "mean_train_demand")
    if name == "competitor":
        return sg.competitor_signal("base_daily", "competitor_avg_price")
    if name == "weather":
        return sg.weather_signal("bad_weather_score", "extreme_heat_flag", "precipitation_sum", F.coalesce(F.col("_wx"), F.lit(False)))
    wk = is_weekend("forecast_date", weekend_days)
    return F.when(F.col("_cal").isNull(), sg.holiday_signal_without_calendar(wk)).otherwise(
        sg.holiday_signal("is_holiday", "days_to_holiday", "is_school_holiday", "is_weekend"))


def signal_of_days(spine: DataFrame, name: str, inputs: dict[str, DataFrame], weekend_days=DEFAULT_WEEKEND) -> DataFrame:
    """One signal of every cell-day: reads that signal's inputs and no others."""
    j = with_inputs(spine, {i: inputs[i] for i in SIGNAL_INPUTS[name]})
    return j.select(*CELL, "forecast_date", rnd(signal(name, weekend_days), 4).alias(f"{name}_signal"))


def generate(spine: DataFrame, inputs: dict[str, DataFrame], run_date: dt.date, model_name: str = "pricing_engine_v1",
             model_version: str = "1.0.0", weekend_days=DEFAULT_WEEKEND) -> DataFrame:
    """PRC-05: signals -> weighted adjustment -> guardrail clamp -> prices
    and explanation for every cell-day of the spine.

    Inputs (all unique on their join keys, ``INPUT_KEYS``):
      base     (tenant, branch, category) -> base_daily/weekly/monthly
      guard    (tenant, branch, category) -> guardrail_* columns, guardrail_max_price NULL where there is none
      weights  (tenant) -> w_<signal>
      util     (cell, forecast_date) -> utilization_contracts, utilization_bookings
      forecast (cell, forecast_date) -> forecast_demand
      mean_demand (cell) -> mean_train_demand
      comp     (cell, forecast_date) -> competitor_avg_price
      weather  (tenant, branch, forecast_date) -> bad_weather_score, extreme_heat_flag, precipitation_sum
      calendar (tenant, forecast_date) -> is_holiday, days_to_holiday, is_school_holiday, is_weekend
    """
    j = with_inputs(spine, {name: inputs[name] for name in INPUT_KEYS})
    j = j.select("*", *[signal(n, weekend_days).alias(n + "_signal") for n in SIGNALS])
    raw = sg.weighted_adjustment({n: F.col(n + "_signal") for n in SIGNALS},
                                 {n: F.col("w_" + n) for n in SIGNALS})
    j = j.withColumn("raw_adjustment_pct", raw)
    cl = sg.clamp_price("base_daily", "raw_adjustment_pct", "guardrail_min_price",
                        "guardrail_max_discount_pct", "guardrail_max_premium_pct", "guardrail_max_price")
    j = j.select("*", cl["price"].alias("rec_daily"), cl["pct"].alias("premium_discount_pct"),
                 cl["applied"].alias("guardrail_applied"))
    factor = 1 + F.col("premium_discount_pct") / 100.0
    return j.select(
        *CELL, F.lit(run_date).alias("run_date"), "forecast_date", "horizon_day",
        money("base_daily").alias("base_daily"), money("base_weekly").alias("base_weekly"),
        money("base_monthly").alias("base_monthly"),
        "rec_daily", money(F.col("base_weekly") * factor).alias("rec_weekly"),
        money(F.col("base_monthly") * factor).alias("rec_monthly"),
        "premium_discount_pct",
        *[rnd(n + "_signal", 4).alias(n + "_signal") for n in SIGNALS],
        "raw_adjustment_pct", "guardrail_applied",
        "guardrail_min_price", "guardrail_max_discount_pct", "guardrail_max_premium_pct", "guardrail_max_price",
        sg.explanation(*[F.col(n + "_signal") for n in SIGNALS], F.col("raw_adjustment_pct"),
                       F.col("premium_discount_pct"), F.col("guardrail_applied")).alias("explanation_text"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit("pending").alias("status"),
    )


def run_statistics(recs: DataFrame) -> DataFrame:
    """PRC-07 counters: branches, categories, cells, generated rows, rows
    clamped by a guardrail."""
    return recs.groupBy("tenant_id", "run_date").agg(
        F.countDistinct("branch_id").alias("branches_processed"),
        F.countDistinct("category_id").alias("categories_processed"),
        F.countDistinct("branch_id", "category_id").alias("cells"),
        F.count(F.lit(1)).alias("recommendations_generated"),
        F.sum(F.col("guardrail_applied").cast("int")).alias("guardrail_applied_count"))


# ---- versions and workflow ---------------------------------------------------

REC_KEY = ["tenant_id", "branch_id", "category_id", "forecast_date"]


def latest_version(recs: DataFrame, key=REC_KEY) -> DataFrame:
    """WIN-09 / JN-10: the latest run_date row per key (row_number = 1,
    run_date desc) -- one window, no self-join."""
    w = Window.partitionBy(*key).orderBy(F.col("run_date").desc())
    return recs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_run(recs: DataFrame, by: list[str], run: str = "run_date") -> DataFrame:
    """WIN-10 / JN-11: rows of the latest ``run`` date within each ``by`` group
    (partial maxima per group joined back: the history itself is not
    gathered by group)."""
    latest = recs.groupBy(*by).agg(F.max(run).alias(run))
    return recs.join(latest, [*by, run], "left_semi")


def apply_decisions(recs: DataFrame, decisions: DataFrame, key=None) -> DataFrame:
    """PRC-08: approve / skip rows by key: status, actor, stamp and reason
    from the decision; rows without a decision unchanged."""
    key = key or REC_KEY + ["run_date"]
    d = decisions.select(*key, F.col("status").alias("_st"), F.col("decided_by").alias("_by"),
                         F.col("decided_at").alias("_at"), F.col("reason").alias("_reason"))
    j = recs.join(d, key, "left")
    hit = F.col("_st").isNotNull()
    return j.select(*[c for c in recs.columns if c not in ("status", "decided_by", "decided_at", "reason")],
                    F.when(hit, F.col("_st")).otherwise(F.col("status")).alias("status"),
                    F.when(hit, F.col("_by")).alias("decided_by"), F.when(hit, F.col("_at")).alias("decided_at"),
                    F.when(hit, F.col("_reason")).alias("reason"))


def bulk_approve(recs: DataFrame, branch_id=None, category_id=None, start=None, end=None,
                 actor: str = "system", at: dt.datetime | None = None) -> DataFrame:
    """PRC-09: approve every *pending* row in scope; others unchanged.
    ``changed`` marks the rows this call approved (count = affected)."""
    cond = F.col("status") == "pending"
    if branch_id is not None:
        cond &= F.col("branch_id") == branch_id
    if category_id is not None:
        cond &= F.col("category_id") == category_id
    if start is not None:
        cond &= F.col("forecast_date") >= F.lit(start)
    if end is not None:
        cond &= F.col("forecast_date") <= F.lit(end)
    return (recs.withColumn("changed", cond)
                .withColumn("status", F.when(cond, F.lit("approved")).otherwise(F.col("status")))
                .withColumn("approved_by", F.when(cond, F.lit(actor)))
                .withColumn("approved_at", F.when(cond, F.lit(at))))


def guardrail_violations(decisions: DataFrame) -> DataFrame:
    """PRC-13: approvals whose price breaks the guardrails (below the
    minimum price, or a change beyond the discount / premium limits)."""
    pct = F.col("premium_discount_pct")
    bad = ((F.col("rec_daily") < F.col("guardrail_min_price") - 0.005)
           | (pct > F.col("guardrail_max_premium_pct") + 1e-9)
           | (pct < -F.col("guardrail_max_discount_pct") - 1e-9))
    return decisions.where((F.col("status") == "approved") & bad)


def recommendation_summary(recs: DataFrame) -> DataFrame:
    """AGG-18 / AGG-30: status counts, distinct cells, date range, mean
    adjustment per run."""
    st = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return recs.groupBy("tenant_id", "run_date").agg(
        F.count(F.lit(1)).alias("total"), st("pending").alias("pending"), st("approved").alias("approved"),
        st("skipped").alias("skipped"), F.countDistinct("branch_id").alias("branches"),
        F.countDistinct("category_id").alias("categories"), F.min("forecast_date").alias("min_date"),
        F.max("forecast_date").alias("max_date"), rnd(F.avg("premium_discount_pct"), 4).alias("avg_adjustment_pct"))
