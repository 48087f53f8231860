"""Queries for configuration edits, writers, feeds, gates and scalar
functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewise.functions import calendar as cf
from ratewise.functions.mathx import cents_avg, cents_avg_sql, money, money_sql, rnd, rnd_sql as R, safe_div
from ratewise.functions.text import localized_name
from ratewise.operators import backfill as bf
from ratewise.operators import boosted as bo
from ratewise.operators import calendar as cal
from ratewise.operators import demand as dm
from ratewise.operators import forecast as fc
from ratewise.operators import training as tr
from ratewise.operators import utilization as ut
from ratewise.plans import params as P
from ratewise.plans import profile_plans  # noqa: F401
from ratewise.plans.competitor_plans import _quotes, comp_index
from ratewise.plans.demand_plans import calendar_sql
from ratewise.plans.feature_plans import _fact_split, _fs
from ratewise.plans.forecast_plans import forecast_runs
from ratewise.plans.oracle_views import register_view, with_views
from ratewise.plans.profile_plans import _top_branches
from ratewise.plans.registry import query
from ratewise.sinks import io
from ratewise.sources.fixed import CATEGORIES, HOLIDAY_TYPE_PRIORITY, fixed_table_sql

CELLK = ["tenant_id", "branch_id", "category_id"]


# ---- configuration ----------------------------------------------------------------

@query("cfg_02", with_views(f"""
    SELECT g.guardrail_id, g.category_id, g.branch_id,
           coalesce(p.new_min, g.min_price) AS min_price, g.max_discount_pct, g.max_premium_pct,
           p.new_min IS NOT NULL AS changed,
           CASE WHEN p.new_min IS NOT NULL THEN CAST(to_json({{'min_price': g.min_price}}) AS VARCHAR) END AS old_value,
           CASE WHEN p.new_min IS NOT NULL THEN CAST(to_json({{'min_price': p.new_min}}) AS VARCHAR) END AS new_value
    FROM guardrail_config g LEFT JOIN (
        SELECT category_id, CAST(floor(min(daily_rate)) AS DOUBLE) AS new_min FROM rentals GROUP BY 1) p
      ON p.category_id = g.category_id""", "guardrail_config", "rentals"))
def cfg_02(d):
    """CFG-02 + SNK-05: partial update of the guardrail rows -- only the
    provided field (min_price, from the cheapest executed rate of the
    category) changes; old / new values as JSON audit documents."""
    rentals = dm.with_category(dm.executed_rentals(d.contracts), d.vehicles)
    patch = rentals.groupBy("category_id").agg(F.floor(F.min("daily_rate")).cast("double").alias("new_min"))
    g = d.fixed("guardrail_config")
    j = g.join(patch, "category_id", "left")
    hit = F.col("new_min").isNotNull()
    return j.select("guardrail_id", "category_id", "branch_id",
                    F.coalesce("new_min", "min_price").alias("min_price"), "max_discount_pct", "max_premium_pct",
                    hit.alias("changed"),
                    F.when(hit, F.to_json(F.struct("min_price"))).alias("old_value"),
                    F.when(hit, F.to_json(F.struct(F.col("new_min").alias("min_price")))).alias("new_value"))


register_view("rank_all", """
    SELECT branch_id, count(*) AS rentals, rank() OVER (ORDER BY count(*) DESC, branch_id) AS rk
    FROM rentals GROUP BY branch_id""", ("rentals",))


@query("cfg_03", with_views("""
    SELECT r.branch_id, CASE WHEN e.branch_id IS NULL THEN 'inserted' ELSE 'rejected' END AS action
    FROM (SELECT branch_id FROM rank_all WHERE rk <= 6) r
    LEFT JOIN (SELECT r.branch_id FROM rentals r JOIN branches b ON b.branch_id = r.branch_id
               WHERE b.is_airport GROUP BY r.branch_id ORDER BY count(*) DESC, r.branch_id LIMIT 3) e
      ON e.branch_id = r.branch_id""", "rank_all", "rentals", "branches"))
def cfg_03(d):
    """CFG-03: insert-if-absent -- the six busiest branches offered to a
    selection that holds the top airport branches; existing ones rejected."""
    rentals = dm.with_category(dm.executed_rentals(d.contracts), d.vehicles)
    n = rentals.groupBy("branch_id").agg(F.count(F.lit(1)).alias("rentals"))
    cand = n.orderBy(F.col("rentals").desc(), "branch_id").limit(6).select("branch_id")
    existing = _top_branches(d).where("is_airport").select("branch_id")
    ins = cand.join(existing, "branch_id", "left_anti").withColumn("action", F.lit("inserted"))
    rej = cand.join(existing, "branch_id", "left_semi").withColumn("action", F.lit("rejected"))
    return ins.unionByName(rej)


@query("cfg_04", with_views("""
    SELECT branch_id AS item_id, CAST(row_number() OVER (ORDER BY branch_id) AS INTEGER) AS rank_order
    FROM rank_all WHERE rk <= 6 ORDER BY rank_order""", "rank_all"))
def cfg_04(d):
    """CFG-04: active branch selections ordered by rank."""
    rentals = dm.with_category(dm.executed_rentals(d.contracts), d.vehicles)
    n = rentals.groupBy("tenant_id", "branch_id").agg(F.count(F.lit(1)).alias("rentals"))
    wr = Window.partitionBy("tenant_id").orderBy(F.col("rentals").desc(), "branch_id")
    top = n.withColumn("_rk", F.row_number().over(wr)).where("_rk <= 6")
    w = Window.partitionBy("tenant_id").orderBy("branch_id")
    return top.select(F.col("branch_id").alias("item_id"), F.row_number().over(w).alias("rank_order")) \
        .orderBy("rank_order")


@query("cfg_06", with_views("""
    SELECT m.category_id, m.competitor_vehicle_type, count(*) AS index_rows
    FROM competitor_mapping m JOIN comp_index i ON i.category_id = m.category_id
    GROUP BY 1, 2""", "competitor_mapping", "comp_index"))
def cfg_06(d):
    """CFG-06: active mappings in use, with the index rows they produce."""
    m = d.fixed("competitor_mapping")
    c = comp_index(d).groupBy("category_id").agg(F.count(F.lit(1)).alias("index_rows"))
    return F.broadcast(m).join(c, "category_id")


# ---- writers --------------------------------------------------------------------

MERGE_T_END, MERGE_S_START = dt.date(2000, 1, 20), dt.date(2000, 1, 15)


@query("snk_01", with_views(f"""
    WITH t AS (SELECT * FROM event_signal WHERE event_date <= DATE '{MERGE_T_END}'),
         s AS (SELECT tenant_id, event_date, city_name, event_volume + 1 AS event_volume,
                      round(ln(1 + event_volume + 1), 4) AS event_score
               FROM event_signal WHERE event_date >= DATE '{MERGE_S_START}')
    SELECT coalesce(s.tenant_id, t.tenant_id) AS tenant_id, coalesce(s.event_date, t.event_date) AS event_date,
           coalesce(s.city_name, t.city_name) AS city_name,
           CASE WHEN s.tenant_id IS NOT NULL THEN s.event_volume ELSE t.event_volume END AS event_volume,
           CASE WHEN s.tenant_id IS NOT NULL THEN s.event_score ELSE t.event_score END AS event_score
    FROM t FULL OUTER JOIN s ON s.tenant_id = t.tenant_id AND s.event_date = t.event_date
                             AND s.city_name = t.city_name""", "event_signal"))
def snk_01(d):
    """SNK-01 / STM-03 batch: upsert a later feed window into the event
    table (matched updated, new inserted, others kept)."""
    e = d.event_signal
    target = e.where(F.col("event_date") <= F.lit(MERGE_T_END))
    src = e.where(F.col("event_date") >= F.lit(MERGE_S_START)).withColumn(
        "event_volume", F.col("event_volume") + 1).withColumn("event_score", cal.event_score(F.col("event_volume")))
    return io.merge_by_key(target, src, ["tenant_id", "event_date", "city_name"], created_col=None,
                           updated_col=None)


R_FROM, R_TO = dt.date(2000, 1, 1), dt.date(2000, 3, 31)


@query("snk_02", with_views("SELECT * FROM fact", "fact"))
def snk_02(d):
    """SNK-02: a date range of the stored fact is replaced by its rebuild.
    The stored range is stale (no rentals counted); its months are
    overwritten as partitions, all others stay, and the table is read back."""
    f = dm.build_daily_demand(d)
    month = F.trunc("demand_date", "MONTH").alias("month")
    stale = F.when(F.col("demand_date").between(F.lit(R_FROM), F.lit(R_TO)), F.lit(0)).otherwise(
        F.col("executed_rentals_count")).cast(f.schema["executed_rentals_count"].dataType)
    path = io.new_table(d.spark, "demand_fact")
    io.write_partitioned(f.withColumn("executed_rentals_count", stale).select("*", month), path, ["month"])
    io.write_partitioned(dm.build_daily_demand(d, R_FROM, R_TO).select("*", month), path, ["month"])
    return d.spark.read.parquet(path).select(f.columns)


@query("snk_03", with_views("SELECT * FROM forecast_runs", "forecast_runs"))
def snk_03(d):
    """SNK-03: one run (same tenant and run_date) of the stored forecasts is
    replaced.  The stored run is stale (no demand); its partition is
    overwritten and the table read back."""
    runs = forecast_runs(d)
    this = F.col("run_date") == F.lit(P.RUN_DATE)
    stale = F.when(~this, F.col("forecast_demand")).otherwise(0).cast(runs.schema["forecast_demand"].dataType)
    path, keys = io.new_table(d.spark, "forecast_runs"), ["tenant_id", "run_date"]
    io.write_partitioned(runs.withColumn("forecast_demand", stale), path, keys)
    io.write_partitioned(runs.where(this), path, keys)
    return d.spark.read.schema(runs.schema).parquet(path).select(runs.columns)


@query("snk_04", with_views(f"""
    SELECT b.*, b.model_name = m.selected_model AS is_best_model, e.evaluation_date
    FROM backtest b JOIN best_model m ON m.tenant_id = b.tenant_id
    CROSS JOIN (VALUES (DATE '{P.RUN_DATE - dt.timedelta(days=P.HORIZON)}'), (DATE '{P.RUN_DATE}')) e(evaluation_date)""",
                            "backtest", "best_model"))
def snk_04(d):
    """SNK-04 / FCT-12: evaluation metrics with the best-model flag, appended
    to the stored evaluations; the whole table is returned."""
    m = fc.backtest(fc.total_demand(_fact_split(d)), P.SPLIT_CUTOFF, P.HORIZON)
    best = fc.select_best(m)
    flagged = io.materialize(m.join(best.select("tenant_id", F.col("selected_model").alias("model_name"),
                                                F.lit(True).alias("is_best_model")), ["tenant_id", "model_name"], "left")
                             .withColumn("is_best_model", F.coalesce("is_best_model", F.lit(False))), "evaluation")
    path = io.new_table(d.spark, "evaluations")
    for day in (P.RUN_DATE - dt.timedelta(days=P.HORIZON), P.RUN_DATE):
        io.append(flagged.withColumn("evaluation_date", F.lit(day)), path)
    return d.spark.read.parquet(path)


@query("snk_04_best", with_views(f"""
    SELECT m.tenant_id, selected_model, 'mae' AS selection_metric, metric_value, selection_date
    FROM best_model m CROSS JOIN (VALUES (DATE '{P.RUN_DATE - dt.timedelta(days=P.HORIZON)}'), (DATE '{P.RUN_DATE}')) e(selection_date)""",
                                "best_model"))
def snk_04_best(d):
    """SNK-04: the row of the chosen model, appended by each of two runs."""
    best = io.materialize(fc.select_best(fc.backtest(fc.total_demand(io.materialize(_fact_split(d), "fact")), P.SPLIT_CUTOFF, P.HORIZON)), "best")
    path = io.new_table(d.spark, "selections")
    for day in (P.RUN_DATE - dt.timedelta(days=P.HORIZON), P.RUN_DATE):
        io.append(tr.selection_rows(best, day), path)
    return d.spark.read.parquet(path)


@query("snk_05", with_views("""
    SELECT 'decision' AS action_type, 'recommendation' AS entity_type,
           concat_ws(':', CAST(branch_id AS VARCHAR), CAST(category_id AS VARCHAR), CAST(forecast_date AS VARCHAR),
                     CAST(run_date AS VARCHAR)) AS entity_id,
           CAST(to_json({'status': status}) AS VARCHAR) AS old_value,
           CAST(to_json({'status': CASE WHEN priority = '1-URGENT' THEN 'approved' ELSE 'skipped' END}) AS VARCHAR)
             AS new_value,
           'ops' AS user_name, 'priority ' || priority AS reason, CAST(run_date AS TIMESTAMP) AS created_at
    FROM rec_history WHERE priority IN ('1-URGENT', '5-LOW')""", "rec_history"))
def snk_05(d):
    """SNK-05: audit rows (old / new as JSON, reason, time) of the approvals,
    then of the skips, appended to the audit table, which is read back."""
    path = io.new_table(d.spark, "audit")
    for priority, status in (("1-URGENT", "approved"), ("5-LOW", "skipped")):
        changes = d.rec_history.where(F.col("priority") == priority).withColumn("new_status", F.lit(status))
        io.append(io.audit_rows(changes, ["branch_id", "category_id", "forecast_date", "run_date"], {"status": "status"},
                                {"status": "new_status"}, "decision", "recommendation", "ops",
                                F.concat(F.lit("priority "), F.col("priority")), F.col("run_date").cast("timestamp")), path)
    return d.spark.read.parquet(path)


@query("top_04", with_views("""
    SELECT entity_id, new_value FROM (
      SELECT concat_ws(':', CAST(branch_id AS VARCHAR), CAST(category_id AS VARCHAR), CAST(forecast_date AS VARCHAR),
                       CAST(run_date AS VARCHAR)) AS entity_id,
             CAST(to_json({'status': CASE WHEN priority = '1-URGENT' THEN 'approved' ELSE 'skipped' END}) AS VARCHAR)
               AS new_value, run_date, source_id
      FROM rec_history WHERE priority IN ('1-URGENT', '5-LOW'))
    ORDER BY run_date DESC, source_id DESC LIMIT 10""", "rec_history"))
def top_04(d):
    """TOP-04: the 10 most recent audit entries."""
    h = d.rec_history.where(F.col("priority").isin("1-URGENT", "5-LOW"))
    a = h.select(F.concat_ws(":", *[F.col(k).cast("string") for k in ["branch_id", "category_id", "forecast_date",
                                                                        "run_date"]]).alias("entity_id"),
                 F.to_json(F.struct(F.when(F.col("priority") == "1-URGENT", "approved").otherwise("skipped")
                                    .alias("status"))).alias("new_value"), "run_date", "source_id")
    return a.orderBy(F.col("run_date").desc(), F.col("source_id").desc()).limit(10).select("entity_id", "new_value")


# ---- feeds ------------------------------------------------------------------------

#: Article ids of one page of a list payload.
FEED_PAGE = 1000


def _event_payloads(d):
    """Per city-day feed payloads in the three shapes the provider returns:
    {"artcount": n}, {"count": n}, or a list with one entry per article.
    Lists come in pages by ranges of ids, which are unique, so no array is
    larger than a page; the other shapes are one page and collect nothing."""
    listed = ~F.col("event_type").isin("click", "view", "purchase", "signup")
    ev = d.t.events.select(F.to_date("ts").alias("day"), "event_type",
                           F.when(listed, F.col("event_id")).alias("article"),
                           F.when(listed, F.floor(F.col("event_id") / FEED_PAGE)).alias("page"))
    g = ev.groupBy("day", "event_type", "page").agg(F.count(F.lit(1)).alias("n"),
                                                   F.array_sort(F.collect_list("article")).alias("ids"))
    shape = F.when(F.col("event_type").isin("click", "view"), F.to_json(F.struct(F.col("n").alias("artcount")))) \
        .when(F.col("event_type").isin("purchase", "signup"), F.to_json(F.struct(F.col("n").alias("count")))) \
        .otherwise(F.to_json("ids"))
    return g.select("day", "event_type", "page", shape.alias("payload"))


def feed_count(payload) -> F.Column:
    """SRC-05: count from key ``artcount`` else ``count``, else the list
    length, else 0 (unparseable -> 0)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce(F.get_json_object(p, "$.artcount").try_cast("long"),
                      F.get_json_object(p, "$.count").try_cast("long"),
                      F.json_array_length(p).cast("long"), F.lit(0).cast("long"))


@query("src_05", with_views("""
    SELECT day, event_type, count(*) AS volume, round(ln(1 + count(*)), 4) AS event_score
    FROM (SELECT CAST(ts AS DATE) AS day, event_type FROM events) GROUP BY 1, 2""", ))
def src_05(d):
    """SRC-05: event-count feed payloads (three shapes) -> volume, score."""
    p = _event_payloads(d).groupBy("day", "event_type").agg(F.sum(feed_count("payload")).alias("volume"))
    return p.select("day", "event_type", "volume", cal.event_score(F.col("volume")).alias("event_score"))


@query("src_07", with_views("""
    SELECT holiday_date, holiday_name FROM holidays WHERE year(holiday_date) < 1999
    UNION ALL SELECT holiday_date, holiday_name FROM holidays WHERE year(holiday_date) >= 1999""", "holidays"))
def src_07(d):
    """SRC-07: feed batches of two year ranges unioned by name."""
    h = d.holidays
    a = cal.normalise_holiday_payload(cal.holiday_payload(h.where(F.year("holiday_date") < 1999)),
                                      HOLIDAY_TYPE_PRIORITY)
    b = cal.normalise_holiday_payload(cal.holiday_payload(h.where(F.year("holiday_date") >= 1999)),
                                      HOLIDAY_TYPE_PRIORITY)
    return a.unionByName(b).select("holiday_date", "holiday_name")


@query("cal_05", with_views(f"""
    WITH new AS (SELECT 1 AS tenant_id, make_date(y, h_month, h_day) AS holiday_date, holiday_name, holiday_type
                 FROM (SELECT unnest(range(year(DATE '{P.SPLIT_CUTOFF}'),
                                           year(DATE '{P.SPLIT_CUTOFF}' + 365) + 1)) AS y) ys
                 CROSS JOIN fixed_holidays)
    SELECT coalesce(n.tenant_id, h.tenant_id) AS tenant_id, coalesce(n.holiday_date, h.holiday_date) AS holiday_date,
           coalesce(n.holiday_name, h.holiday_name) AS holiday_name,
           CASE WHEN n.tenant_id IS NOT NULL THEN n.holiday_type ELSE h.holiday_type END AS holiday_type
    FROM (SELECT tenant_id, holiday_date, holiday_name, holiday_type FROM holidays) h
    FULL OUTER JOIN new n ON n.tenant_id = h.tenant_id AND n.holiday_date = h.holiday_date
                         AND n.holiday_name = h.holiday_name""", "holidays", "fixed_holidays"))
def cal_05(d):
    """CAL-05: daily update -- holidays of the years touched by today ..
    today + 365 generated and merged into the holiday table by key."""
    from ratewise.sources.fixed import FIXED_HOLIDAYS
    today = F.lit(P.SPLIT_CUTOFF)
    years = d.contracts.select("tenant_id").distinct().select(
        F.explode(F.sequence(F.year(today), F.year(F.date_add(today, 365)))).alias("year"))
    new = cal.fixed_holidays(years, FIXED_HOLIDAYS, d.tenant_id)
    cur = d.holidays.select("tenant_id", "holiday_date", "holiday_name", "holiday_type")
    return io.merge_by_key(cur, new.select("tenant_id", "holiday_date", "holiday_name", "holiday_type"),
                           ["tenant_id", "holiday_date", "holiday_name"], created_col=None, updated_col=None)


EVENTS_TO = dt.date(2000, 1, 25)


def _calendar_tables(d, folder):
    """Sources of a range: holidays of its years; events counted from their raw rows."""
    from ratewise.sources.domain import EVENT_SHIFT_MONTHS
    from ratewise.sources.fixed import FIXED_HOLIDAYS

    def holidays(first, last):
        years = d.branches.select("tenant_id").distinct().select(F.explode(F.sequence(F.lit(first.year), F.lit(last.year))).alias("year"))
        return cal.fixed_holidays(years, FIXED_HOLIDAYS, d.tenant_id).drop("holiday_name_ar")

    def events(first, last):
        moved = lambda day, days: F.add_months(F.lit(day), -EVENT_SHIFT_MONTHS) + F.make_interval(days=F.lit(days))  # noqa: E731  months' ends differ
        e = d.t.events.where((F.col("ts") >= moved(first, -4)) & (F.col("ts") < moved(last, 5))).select("ts", "event_type")
        e = e.join(F.broadcast(d.fixed("event_city")), "event_type")  # a fixed vocabulary
        e = e.select(F.add_months(F.to_date("ts"), EVENT_SHIFT_MONTHS).alias("event_date"), "city_name")
        return cal.event_signal(e.where(F.col("event_date").between(F.lit(first), F.lit(last))), d.tenant_id)

    return bf.CalendarTables(d.spark, folder, holidays, events)


@query("cal_05_backfill", with_views(f"""
    SELECT 'holidays' AS kind, make_date(y, h_month, h_day) AS day, holiday_name AS name, CAST(NULL AS BIGINT) AS event_volume
    FROM (SELECT unnest(range(1998, 2002)) AS y), fixed_holidays
    UNION ALL SELECT 'events', event_date, city_name, event_volume FROM event_signal WHERE event_date BETWEEN DATE '1998-01-01' AND DATE '{EVENTS_TO}' + 1""",
                                     "fixed_holidays", "event_signal"))
def cal_05_backfill(d):
    """CAL-05: three years backfilled in chunks, then the next day's update."""
    tables = _calendar_tables(d, io.new_table(d.spark, "calendar"))
    tables.backfill(1998, 2000, EVENTS_TO, days=400)
    tables.daily_update(EVENTS_TO + dt.timedelta(days=1))
    h, e = tables.read("holidays"), tables.read("events")
    return (h.select(F.lit("holidays").alias("kind"), F.col("holiday_date").alias("day"), F.col("holiday_name").alias("name"), F.lit(None).cast("long").alias("event_volume"))
            .union(e.select(F.lit("events"), "event_date", "city_name", "event_volume")))


@query("cal_02", with_views(f"""
    SELECT * FROM calendar_features WHERE cal_date BETWEEN DATE '{P.RUN_DATE}' AND DATE '{P.RUN_DATE}' + {P.HORIZON - 1}""",
                            "calendar_features"))
def cal_02(d):
    """CAL-02: calendar features over a date range (set-based, no loop)."""
    from ratewise.plans.calendar_plans import _cal
    end = P.RUN_DATE + dt.timedelta(days=P.HORIZON - 1)
    return _cal(d).where(F.col("cal_date").between(F.lit(P.RUN_DATE), F.lit(end)))


@query("cal_03", with_views("SELECT * FROM holiday_window", "holiday_window"))
def cal_03(d):
    """CAL-03: holiday window features (same operator as WIN-08)."""
    return cal.holiday_window(d.day_spine, d.holidays, P.HOLIDAY_WINDOW_DAYS)


@query("cal_04", with_views("""
    SELECT holiday_date, holiday_name,
           CASE WHEN contains(lower(t1), 'national holiday') OR contains(lower(t2), 'national holiday') THEN 'National holiday'
                WHEN contains(lower(t1), 'religious') OR contains(lower(t2), 'religious') THEN 'Religious'
                WHEN contains(lower(t1), 'muslim') OR contains(lower(t2), 'muslim') THEN 'Muslim'
                WHEN contains(lower(t1), 'observance') OR contains(lower(t2), 'observance') THEN 'Observance'
                ELSE t1 END AS primary_type
    FROM (SELECT holiday_date, holiday_name, holiday_type AS t1,
                 CASE WHEN month(holiday_date) = 9 THEN 'National holiday' ELSE 'Observance' END AS t2 FROM holidays)""",
                            "holidays"))
def cal_04(d):
    """CAL-04: primary holiday type from a type list by priority."""
    h = d.holidays.select("holiday_date", "holiday_name", F.array(
        "holiday_type", F.when(F.month("holiday_date") == 9, F.lit("National holiday")).otherwise(F.lit("Observance")))
        .alias("types"))
    return h.select("holiday_date", "holiday_name",
                    cal.holiday_type_priority(F.col("types"), HOLIDAY_TYPE_PRIORITY).alias("primary_type"))


# ---- competitor reads -------------------------------------------------------------

@query("cmp_08", with_views(f"""
    SELECT branch_id, category_id, index_date, coalesce(competitor_avg_price, 0.0) AS competitor_avg_price,
           competitors_count FROM comp_index
    WHERE index_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""", "comp_index"))
def cmp_08(d):
    """CMP-08: read the index of every branch over a date range."""
    i = comp_index(d).where(F.col("index_date").between(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 12, 31))))
    return i.select("branch_id", "category_id", "index_date",
                    F.coalesce("competitor_avg_price", F.lit(0.0)).alias("competitor_avg_price"), "competitors_count")


@query("cmp_09", with_views("""
    SELECT category, count(*) AS quotes, count(DISTINCT vehicle_name) AS vehicles,
           list_sort(list(DISTINCT brand)) AS brands, min(daily_price) AS min_price, max(daily_price) AS max_price
    FROM quotes GROUP BY category""", "quotes"))
def cmp_09(d):
    """CMP-09: vehicle list per competitor category with aggregate lists."""
    q = _quotes(d)
    brands = q.select("category", "brand").distinct().groupBy("category").agg(
        F.array_sort(F.collect_list("brand")).alias("brands"))
    g = q.groupBy("category").agg(F.count(F.lit(1)).alias("quotes"),
                                  F.countDistinct("vehicle_name").alias("vehicles"),
                                  F.min("daily_price").alias("min_price"), F.max("daily_price").alias("max_price"))
    return g.join(brands, "category")


@query("cmp_10", with_views("""
    SELECT quote_id, CAST(price_date AS TIMESTAMP) AS fetched_at,
           CAST(price_date AS TIMESTAMP) + INTERVAL 24 HOUR AS expires_at FROM quotes""", "quotes"))
def cmp_10(d):
    """CMP-10: expiry stamping (fetched + 24 hours)."""
    q = _quotes(d).withColumn("fetched_at", F.col("price_date").cast("timestamp"))
    return q.select("quote_id", "fetched_at", (F.col("fetched_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))


# ---- weather 24 h --------------------------------------------------------------------

@query("wth_04", with_views(f"""
    WITH h AS (SELECT ec.city_name, date_trunc('hour', ts) AS ts, {cents_avg_sql('value')} AS temperature,
                      max(value) AS wind_speed, min(value) AS visibility
               FROM events JOIN event_city ec ON ec.event_type = events.event_type GROUP BY 1, 2)
    SELECT city_name, ts,
           {R("avg(temperature) OVER (PARTITION BY city_name ORDER BY epoch(ts) RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING)", 4)} AS temp_mean_24h,
           max(temperature) OVER (PARTITION BY city_name ORDER BY epoch(ts) RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) AS temp_max_24h,
           {R("sum(CAST(round(wind_speed * 100.0) AS BIGINT)) OVER (PARTITION BY city_name ORDER BY epoch(ts) RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) / count(wind_speed) OVER (PARTITION BY city_name ORDER BY epoch(ts) RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) / 100.0", 4)} AS wind_mean_24h,
           min(visibility) OVER (PARTITION BY city_name ORDER BY epoch(ts) RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) AS visibility_min_24h
    FROM h""", "event_city"))
def wth_04(d):
    """WTH-04: next-24-hour features from hourly readings (the event feed's
    hourly values per city serve as the readings)."""
    from ratewise.operators.weather import next_24h
    ev = d.t.events.join(F.broadcast(d.fixed("event_city")), "event_type")
    hourly = ev.groupBy("city_name", F.date_trunc("hour", "ts").alias("ts")).agg(
        cents_avg("value").alias("temperature"), F.max("value").alias("wind_speed"), F.min("value").alias("visibility"))
    return next_24h(hourly, ["city_name"], "ts")


# ---- forecasting extras ----------------------------------------------------------

@query("fct_13", with_views("""
    SELECT tenant_id, branch_id, category_id, forecast_date, arg_max(forecast_demand, run_date) AS forecast_demand,
           max(run_date) AS run_date, arg_max(model_name, run_date) AS model_name
    FROM forecast_runs GROUP BY 1, 2, 3, 4""", "forecast_runs"))
def fct_13(d):
    """FCT-13: forecasts of the latest run per series and date."""
    return fc.latest_forecast(forecast_runs(d))


@query("fct_04", with_views(f"""
    WITH t AS (SELECT tenant_id, branch_id, category_id, max(CASE WHEN rn = 1 THEN executed_rentals_count END) AS last_value,
                      max(CASE WHEN rn = 7 THEN executed_rentals_count END) AS value_7_back,
                      avg(CASE WHEN rn <= 7 THEN executed_rentals_count END) AS mean_last_7,
                      avg(executed_rentals_count) AS mean_last_30, arg_max(avg_base_price_paid, demand_date) AS last_price
               FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, branch_id, category_id ORDER BY demand_date DESC) AS rn
                     FROM feature_store WHERE split_flag = 'TRAIN') WHERE rn <= 30 GROUP BY 1, 2, 3),
    e AS (SELECT tenant_id, max(demand_date) AS last_date FROM feature_store WHERE split_flag = 'TRAIN' GROUP BY 1),
    x AS (SELECT t.*, CAST(h AS INTEGER) AS horizon_day, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS feature_date FROM t JOIN e USING (tenant_id), range(1, {P.HORIZON + 1}) r(h))
    SELECT tenant_id, branch_id, category_id, horizon_day, feature_date, day_of_week, day_of_month, week_of_year, month_of_year, quarter,
           CAST(is_weekend AS INTEGER) AS is_weekend, 0 AS is_public_holiday, 0 AS is_religious_holiday, 0 AS has_major_event,
           CAST(last_value AS DOUBLE) AS lag_1d, CAST(coalesce(value_7_back, last_value) AS DOUBLE) AS lag_7d,
           {R('mean_last_7', 4)} AS rolling_7d, {R('mean_last_30', 4)} AS rolling_30d, CAST(30 AS DOUBLE) AS temperature_avg,
           CAST(0 AS DOUBLE) AS precipitation_mm, CAST(0 AS DOUBLE) AS event_score, last_price AS price
    FROM (SELECT *, {calendar_sql('feature_date')} FROM x)""", "feature_store"))
def fct_04(d):
    """FCT-04: future feature rows per series x horizon day from the series'
    tails: every feature of the model, under its names."""
    rows = bo.future_rows(_fact_split(d).where(F.col("split_flag") == "TRAIN"), P.HORIZON)
    return rows.select(*[rnd(c, 4).alias(c) if c.startswith("rolling") else c for c in rows.columns])


STEPS = ["target", "lag_1d", "lag_7d", "rolling_7d", "temperature_avg"]


@query("fct_05", with_views(f"""
    WITH stats AS (SELECT tenant_id, {", ".join(f"avg(x.{c}) AS m_{c}, stddev_pop(x.{c}) AS s_{c}" for c in STEPS)}
                   FROM (SELECT tenant_id, unnest(sequence) AS x FROM sequences) GROUP BY tenant_id)
    SELECT q.tenant_id, branch_id, category_id, demand_date, target,
           list_transform(sequence, lambda x: {{{", ".join(
               f"'{c}': " + R(f"(x.{c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END", 4) for c in STEPS)}}}) AS sequence
    FROM sequences q JOIN stats ON stats.tenant_id = q.tenant_id""", "sequences"))
def fct_05(d):
    """FCT-05: 14-step sequences standardised per feature (population std
    over every step of every sequence, 4 dp); target = next value.  A row's
    weight in the statistics is the number of sequences that hold it, so the
    sequences are not exploded."""
    from ratewise.operators import features as fe
    from ratewise.operators import timeseries as tsx
    length = 14
    mm = io.materialize(fe.model_matrix(_fs(d)), "model_matrix")
    seq = tsx.sliding_sequences(mm, STEPS, "target", CELLK, "demand_date", length)
    # row i of n is in the sequences of rows i + 1 .. i + length, as far as they exist and have a full history
    i, n = F.row_number().over(Window.partitionBy(*CELLK).orderBy("demand_date")), F.count(F.lit(1)).over(Window.partitionBy(*CELLK))
    weight = F.greatest(F.least(n, i + length) - F.greatest(F.lit(length), i), F.lit(0))
    steps = mm.select("tenant_id", *[F.col(f).cast("double").alias(f) for f in STEPS], weight.alias("w"))
    total = F.sum("w")
    sums = steps.groupBy("tenant_id").agg(*[x for f in STEPS for x in (
        (F.sum(F.col("w") * F.col(f)) / total).alias("m_" + f), (F.sum(F.col("w") * F.col(f) * F.col(f)) / total).alias("q_" + f))])
    stats = sums.select("tenant_id", *[F.col("m_" + f) for f in STEPS], *[
        F.sqrt(F.greatest(F.col("q_" + f) - F.col("m_" + f) * F.col("m_" + f), F.lit(0.0))).alias("s_" + f) for f in STEPS])
    j = seq.join(F.broadcast(stats), "tenant_id")  # a row per tenant
    z = F.transform("sequence", lambda s: F.struct(*[
        rnd((s[f] - F.col("m_" + f)) / F.when(F.col("s_" + f) > 0, F.col("s_" + f)).otherwise(F.lit(1.0)), 4).alias(f)
        for f in STEPS]))
    return j.select(*CELLK, "demand_date", "target", z.alias("sequence"))


@query("fct_03")
def fct_03(d):
    """FCT-03: global boosted trees (100 of depth 6, step .1, seed 42) fitted on
    TRAIN, saved, loaded again, and predicting VALIDATION rows."""
    fs = io.materialize(_fs(d), "feature_store")
    path = io.new_table(d.spark, "boosted-model")
    bo.BoostedTrees().fit(fs.where(F.col("split_flag") == "TRAIN")).save(path)
    rows = bo.matrix_rows(fs.where(F.col("split_flag") == "VALIDATION"))
    return bo.FittedTrees.load(path).score(rows).select(*CELLK, "demand_date", "target", rnd("prediction", 4).alias("prediction"))


@query("fct_14_run")
def fct_14_run(d):
    """FCT-14 with every model: fitted, scored, the best one fitted again on all
    rows, its forecasts saved; the evaluations with the best model's flag."""
    folder = io.new_table(d.spark, "training-run")
    run = tr.TrainingRun(folder, horizon=P.HORIZON)
    forecasts = run.run(_fs(d)).groupBy("tenant_id").agg(F.count("*").alias("forecast_rows"), F.max("model_name").alias("forecast_model"))
    return d.spark.read.parquet(f"{folder}/evaluations").drop("training_time_sec").join(forecasts, "tenant_id")


# ---- validation gates -------------------------------------------------------------

@query("val_02", with_views(f"""
    SELECT coalesce(a.branch_id, b.branch_id) AS branch_id, coalesce(a.category_id, b.category_id) AS category_id,
           CASE WHEN a.branch_id IS NULL THEN 'missing_in_service' WHEN b.branch_id IS NULL THEN 'missing_in_check'
                ELSE 'value_mismatch' END AS issue
    FROM utilization a FULL OUTER JOIN (
        SELECT v.branch_id, v.category_id,
               {R("CAST(sum(CASE WHEN v.status_id IN (141, 156) THEN 1 ELSE 0 END) AS DOUBLE) / count(*)", 4)} AS u
        FROM vehicles v WHERE NOT v.is_deleted AND v.status_id IN (140, 141, 156) GROUP BY 1, 2) b
      ON a.branch_id = b.branch_id AND a.category_id = b.category_id
    WHERE a.branch_id IS NULL OR b.branch_id IS NULL OR abs(a.utilization - b.u) > 1e-4""",
                            "utilization", "vehicles"))
def val_02(d):
    """VAL-02: utilization cross-check -- service computation vs an
    independent one; missing keys and differences > 1e-4 (empty = pass)."""
    from ratewise.plans.rate_plans import _util
    a = _util(d).select("branch_id", "category_id", "utilization")
    v = d.vehicles.where(~F.col("is_deleted") & F.col("status_id").isin(140, 141, 156))
    b = v.groupBy("branch_id", "category_id").agg(
        rnd(F.sum(F.when(F.col("status_id").isin(141, 156), 1).otherwise(0)) / F.count(F.lit(1)), 4).alias("u"))
    j = a.join(b, ["branch_id", "category_id"], "full_outer")
    issue = (F.when(F.col("utilization").isNull(), F.lit("missing_in_service"))
             .when(F.col("u").isNull(), F.lit("missing_in_check")).otherwise(F.lit("value_mismatch")))
    bad = F.col("utilization").isNull() | F.col("u").isNull() | (F.abs(F.col("utilization") - F.col("u")) > 1e-4)
    return j.where(bad).select("branch_id", "category_id", issue.alias("issue"))


@query("val_03", with_views("""
    SELECT 'utilization_range' AS check_name, bool_and(utilization BETWEEN 0 AND 1) AS passed FROM utilization
    UNION ALL SELECT 'utilization_variance', count(DISTINCT utilization) > 1 FROM utilization
    UNION ALL SELECT 'weather_score_range', bool_and(bad_weather_score BETWEEN 0 AND 1) FROM weather_scored""",
                            "utilization", "weather_scored"))
def val_03(d):
    """VAL-03: utilization within [0,1] and not constant; weather score in [0,1]."""
    from ratewise.operators.weather import score_weather
    from ratewise.plans.rate_plans import _util
    u = _util(d)
    a = u.agg(F.bool_and(F.col("utilization").between(0, 1)).alias("passed")).select(
        F.lit("utilization_range").alias("check_name"), "passed")
    b = u.agg((F.countDistinct("utilization") > 1).alias("passed")).select(
        F.lit("utilization_variance").alias("check_name"), "passed")
    c = score_weather(d.weather).agg(F.bool_and(F.col("bad_weather_score").between(0, 1)).alias("passed")).select(
        F.lit("weather_score_range").alias("check_name"), "passed")
    return a.unionByName(b).unionByName(c)


@query("val_04", with_views(f"""
    SELECT m.tenant_id, unnest(['models_evaluated', 'best_vs_naive', 'forecast_variance', 'horizon_30']) AS check_name,
           unnest([m.models >= 2, b.metric_value <= 1.5 * m.naive_mae, r.sd > 0.1, r.h = {P.HORIZON}]) AS passed
    FROM (SELECT tenant_id, count(*) AS models, max(CASE WHEN model_name = 'seasonal_naive' THEN mae END) AS naive_mae
          FROM backtest GROUP BY 1) m JOIN best_model b ON b.tenant_id = m.tenant_id
    JOIN (SELECT tenant_id, stddev_samp(forecast_demand) AS sd, count(DISTINCT horizon_day) AS h
          FROM naive_alloc GROUP BY 1) r ON r.tenant_id = m.tenant_id""", "backtest", "best_model", "naive_alloc"))
def val_04(d):
    """VAL-04: forecast gate -- >= 2 models evaluated, best MAE <= 1.5 x
    naive, forecast stddev > .1, 30-day horizon."""
    fact = io.materialize(_fact_split(d), "fact")
    m = io.materialize(fc.backtest(fc.total_demand(fact), P.SPLIT_CUTOFF, P.HORIZON), "evaluation")
    best = fc.select_best(m)
    naive = m.where(F.col("model_name") == "seasonal_naive").select("tenant_id", F.col("mae").alias("naive_mae"))
    runs = fc.forecast_run(fact, P.RUN_DATE, P.HORIZON, "seasonal_naive")
    fstats = runs.groupBy("tenant_id").agg(F.stddev_samp("forecast_demand").alias("sd"),
                                           F.countDistinct("horizon_day").alias("h"))
    n = m.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("models"))
    j = n.join(best, "tenant_id").join(naive, "tenant_id").join(fstats, "tenant_id")
    checks = F.array(
        F.struct(F.lit("models_evaluated").alias("check_name"), (F.col("models") >= 2).alias("passed")),
        F.struct(F.lit("best_vs_naive").alias("check_name"),
                 (F.col("metric_value") <= 1.5 * F.col("naive_mae")).alias("passed")),
        F.struct(F.lit("forecast_variance").alias("check_name"), (F.col("sd") > 0.1).alias("passed")),
        F.struct(F.lit("horizon_30").alias("check_name"), (F.col("h") == P.HORIZON).alias("passed")))
    return j.select("tenant_id", F.explode(checks).alias("c")).select("tenant_id", "c.*")


@query("val_05", with_views("""
    SELECT category_id FROM (SELECT DISTINCT category_id FROM vehicles)
    WHERE category_id NOT IN (SELECT category_id FROM category_prices WHERE daily_rate > 0)""",
                            "vehicles", "category_prices"))
def val_05(d):
    """VAL-05: coverage gate -- fleet categories without a price (empty = pass)."""
    from ratewise.plans.rate_plans import _cat_prices
    priced = _cat_prices(d).where(F.col("daily_rate") > 0).select("category_id")
    return d.vehicles.select("category_id").distinct().join(priced, "category_id", "left_anti")


# ---- seasonal factor ------------------------------------------------------------------

@query("sig_s", with_views("""
    SELECT tenant_id, branch_id, category_id, demand_date,
           CAST(CASE WHEN month(demand_date) IN (6, 7, 8) THEN 1.15 WHEN month(demand_date) IN (12, 1) THEN 1.10
                WHEN month(demand_date) IN (3, 4) THEN 1.20 ELSE 1.0 END AS DOUBLE) AS seasonal_factor FROM fact""", "fact"))
def sig_s(d):
    """SIG-S: seasonal price factor by month (documented rule)."""
    m = F.month("demand_date")
    f = (F.when(m.isin(6, 7, 8), F.lit(1.15)).when(m.isin(12, 1), F.lit(1.10)).when(m.isin(3, 4), F.lit(1.20))
         .otherwise(F.lit(1.0)))
    return dm.build_daily_demand(d).select(*CELLK, "demand_date", f.alias("seasonal_factor"))


# ---- scalar functions ---------------------------------------------------------------

@query("str_01", with_views("""
    SELECT branch_id, coalesce(CASE WHEN json_valid(branch_name) THEN json_extract_string(branch_name, '$.ar') END,
                               CASE WHEN json_valid(branch_name) THEN json_extract_string(branch_name, '$.en') END,
                               branch_name) AS name_ar,
           coalesce(CASE WHEN json_valid(branch_name) THEN json_extract_string(branch_name, '$.en') END,
                    branch_name) AS name_en
    FROM branches WHERE branch_id IN (SELECT branch_id FROM contracts)""", "branches", "contracts"))
def str_01(d):
    """STR-01: localized JSON names (ar, else en, else the raw text)."""
    b = d.branches.join(d.contracts.select("branch_id").distinct(), "branch_id", "left_semi")
    return b.select("branch_id", localized_name("branch_name", "ar").alias("name_ar"),
                    localized_name("branch_name", "en").alias("name_en"))


@query("str_02", with_views("""
    SELECT vehicle_name, lower(vehicle_name) AS lowered, starts_with(lower(vehicle_name), 'toyota') AS is_toyota,
           contains(lower(vehicle_name), 'plate') AS has_plate,
           CAST(strpos(vehicle_name, ' ') AS INTEGER) AS first_space,
           substr(vehicle_name, 1, 5) AS head5, trim(vehicle_name) AS stripped,
           split_part(vehicle_name, ' ', 1) AS first_word
    FROM (SELECT DISTINCT vehicle_name FROM listings)""", "listings"))
def str_02(d):
    """STR-02: lower / startswith / contains / find / slice / strip / split once."""
    n = d.listings.select("vehicle_name").distinct()
    v, lo = F.col("vehicle_name"), F.lower("vehicle_name")
    return n.select("vehicle_name", lo.alias("lowered"), lo.startswith("toyota").alias("is_toyota"),
                    lo.contains("plate").alias("has_plate"), F.locate(" ", v).alias("first_space"),
                    F.substring(v, 1, 5).alias("head5"), F.trim(v).alias("stripped"),
                    F.substring_index(v, " ", 1).alias("first_word"))


@query("str_03", with_views("""
    SELECT DISTINCT s_name, regexp_replace(s_name, '^Supplier#0+', '') AS supplier_no
    FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""", ))
def str_03(d):
    """STR-03: regex replace of a leading pattern."""
    s = d.t.supplier.join(d.t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct(), "s_suppkey",
                          "left_semi")
    return s.select("s_name", F.regexp_replace("s_name", r"^Supplier#0+", "").alias("supplier_no")).distinct()


@query("str_04", with_views("""
    SELECT left(p_name, 4) AS prefix4, count(*) AS parts,
           CAST(sum(CASE WHEN p_name LIKE '%blue%' THEN 1 ELSE 0 END) AS BIGINT) AS blue
    FROM part GROUP BY 1"""))
def str_04(d):
    """STR-04: LEFT(s, n) and LIKE '%x%'."""
    p = d.t.part
    return p.groupBy(F.left("p_name", F.lit(4)).alias("prefix4")).agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("p_name").like("%blue%"), 1).otherwise(0)).alias("blue"))


@query("str_05", with_views(f"""
    SELECT branch_id, category_id, printf('%.2f SAR', {R('daily_rate', 2)}) AS price_text
    FROM category_prices""", "category_prices"))
def str_05(d):
    """STR-05: fixed-decimal price text ('123.45 SAR')."""
    from ratewise.plans.rate_plans import _cat_prices
    c = _cat_prices(d)
    return c.select("branch_id", "category_id", F.format_string("%.2f SAR", rnd("daily_rate", 2)).alias("price_text"))


@query("dt_01", with_views("""
    SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1"""))
def dt_01(d):
    """DT-01: CAST timestamp AS DATE (then a daily count)."""
    return d.t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("dt_03", with_views("""
    SELECT contract_id, CAST(start_date + 1 AS DATE) AS next_day, end_date - start_date AS rental_days
    FROM contracts""", "contracts"))
def dt_03(d):
    """DT-03: DATEADD day and date difference in days."""
    c = d.contracts
    return c.select("contract_id", F.date_add("start_date", 1).alias("next_day"),
                    F.datediff("end_date", "start_date").cast("long").alias("rental_days"))


@query("dt_04", with_views("""
    SELECT DISTINCT start_date AS d, CAST(weekofyear(start_date) AS INTEGER) AS iso_week,
           CAST(isodow(start_date) - 1 AS INTEGER) AS weekday_mon0 FROM contracts""", "contracts"))
def dt_04(d):
    """DT-04: ISO week and weekday (0 = Monday)."""
    x = d.contracts.select(F.col("start_date").alias("d")).distinct()
    return x.select("d", F.weekofyear("d").alias("iso_week"), F.weekday("d").alias("weekday_mon0"))


@query("dt_05", with_views("""
    SELECT branch_id, CAST(unnest(generate_series(min(weather_date), max(weather_date), INTERVAL 1 DAY)) AS DATE) AS d
    FROM weather GROUP BY branch_id""", "weather"))
def dt_05(d):
    """DT-05: date range generation (every day of each branch's weather)."""
    g = d.weather.groupBy("branch_id").agg(F.min("weather_date").alias("lo"), F.max("weather_date").alias("hi"))
    return g.select("branch_id", F.explode(F.sequence("lo", "hi")).alias("d"))


@query("dt_06", with_views("""
    SELECT DISTINCT strftime(start_date, '%Y-%m-%d') AS iso_text,
           CAST(strptime(strftime(start_date, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS parsed FROM contracts""",
                           "contracts"))
def dt_06(d):
    """DT-06: ISO date format and parse round trip."""
    t = d.contracts.select(F.date_format("start_date", "yyyy-MM-dd").alias("iso_text")).distinct()
    return t.select("iso_text", F.to_date("iso_text", "yyyy-MM-dd").alias("parsed"))


@query("mth_01", with_views(f"""
    SELECT contract_id, {money_sql('daily_rate')} AS rate_2dp, round(ln(1 + l_quantity), 4) AS log1p_qty,
           abs(l_discount - 0.05) AS abs_gap, {R('sqrt(l_extendedprice)', 4)} AS sqrt_price,
           least(greatest(l_discount, 0.02), 0.08) AS capped
    FROM (SELECT l_orderkey * 10 + l_linenumber AS contract_id, l_extendedprice / l_quantity AS daily_rate,
                 l_quantity, l_discount, l_extendedprice FROM lineitem)"""))
def mth_01(d):
    """MTH-01: rounding (half up for money), ln(1+x), abs, sqrt, min/max caps."""
    li = d.t.lineitem
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contract_id"),
                     money(F.col("l_extendedprice") / F.col("l_quantity")).alias("rate_2dp"),
                     F.round(F.log1p("l_quantity"), 4).alias("log1p_qty"),
                     F.abs(F.col("l_discount") - 0.05).alias("abs_gap"),
                     rnd(F.sqrt("l_extendedprice"), 4).alias("sqrt_price"),
                     F.least(F.greatest(F.col("l_discount"), F.lit(0.02)), F.lit(0.08)).alias("capped"))


@query("mth_02", with_views(f"""
    SELECT tenant_id, branch_id, category_id, {R('CAST(rented_count AS DOUBLE) / nullif(available_count, 0)', 4)} AS ratio,
           coalesce({R('CAST(rented_count AS DOUBLE) / nullif(available_count, 0)', 4)}, -1.0) AS ratio_or_default
    FROM utilization""", "utilization"))
def mth_02(d):
    """MTH-02: safe divide (0 / NULL denominator -> NULL or a default)."""
    from ratewise.plans.rate_plans import _util
    u = _util(d)
    return u.select(*CELLK, rnd(safe_div("rented_count", "available_count"), 4).alias("ratio"),
                    F.coalesce(rnd(safe_div("rented_count", "available_count"), 4), F.lit(-1.0))
                    .alias("ratio_or_default"))


@query("nul_01", with_views(f"""
    SELECT tenant_id, branch_id, category_id, demand_date, coalesce(rentals_lag_1d, 0) AS lag_1d,
           coalesce(temperature_avg, 30.0) AS temperature_avg,
           coalesce(event_score, 0.0) AS event_score FROM feature_store""", "feature_store"))
def nul_01(d):
    """NUL-01: coalesce / or-default fills."""
    from ratewise.operators import features as fe
    from ratewise.operators import timeseries as tsx
    f = tsx.calendar_lags(dm.build_daily_demand(d))
    f = fe.enrich_events(fe.enrich_weather(f, d.weather), d.event_signal, d.branches)
    return f.select(*CELLK, "demand_date", F.coalesce("rentals_lag_1d", F.lit(0)).alias("lag_1d"),
                    F.coalesce("temperature_avg", F.lit(30.0)).alias("temperature_avg"),
                    F.coalesce("event_score", F.lit(0.0)).alias("event_score"))


@query("arr_01", with_views("""
    SELECT branch_id, list_sort(list(DISTINCT category)) AS categories,
           list_slice(list_sort(list(DISTINCT category)), 1, 2) AS first_two,
           len(list_filter(list_sort(list(DISTINCT category)), lambda c: c LIKE 'SUV%')) > 0 AS any_suv
    FROM quotes GROUP BY branch_id""", "quotes"))
def arr_01(d):
    """ARR-01: sorted unique list, slice, any() over a list."""
    q = _quotes(d).select("branch_id", "category").distinct()
    g = q.groupBy("branch_id").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    return g.select("branch_id", "categories", F.slice("categories", 1, 2).alias("first_two"),
                    F.exists("categories", lambda c: c.startswith("SUV")).alias("any_suv"))


@query("map_01", with_views("""
    SELECT vehicle_id, coalesce(s.status_name, 'Status ' || CAST(v.status_id AS VARCHAR)) AS status_label
    FROM vehicles v LEFT JOIN status_config s ON s.status_id = v.status_id""", "vehicles", "status_config"))
def map_01(d):
    """MAP-01: dictionary lookup with default (literal map + element_at)."""
    from ratewise.sources.fixed import STATUS_CONFIG
    m = F.create_map(*[x for sid, name, _t in STATUS_CONFIG for x in (F.lit(sid), F.lit(name))])
    v = d.vehicles
    return v.select("vehicle_id", F.coalesce(F.try_element_at(m, F.col("status_id")),
                                             F.concat(F.lit("Status "), F.col("status_id").cast("string")))
                    .alias("status_label"))


@query("jsn_01", with_views("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CAST(to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR)
             AS doc
    FROM events"""))
def jsn_01(d):
    """JSN-01: nested JSON field access and JSON serialisation."""
    e = d.t.events.select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"),
                    F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("doc"))


@query("cst_01", with_views("""
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int,
           CAST(value AS DECIMAL(18, 4)) AS value_dec, CAST(value > 10 AS INTEGER) AS big_flag FROM events"""))
def cst_01(d):
    """CST-01: typed casts (try_cast text -> int, double -> decimal, flag -> int)."""
    e = d.t.events
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k_int"),
                    F.col("value").cast("decimal(18,4)").alias("value_dec"),
                    (F.col("value") > 10).cast("int").alias("big_flag"))


# ---- locations and date parts ---------------------------------------------------

@query("cmp_07", with_views("""
    WITH loc AS (SELECT r_regionkey AS rank_no, r_name AS location_name, CAST(r_regionkey * 10 AS DOUBLE) AS latitude,
                        CAST(r_regionkey * 20 AS DOUBLE) AS longitude FROM region),
         br AS (SELECT branch_id, upper(city_name) AS k FROM branches
                WHERE branch_id IN (SELECT branch_id FROM contracts)),
         m AS (SELECT br.branch_id, loc.*, CASE WHEN br.k = upper(loc.location_name) THEN 0 ELSE 1 END AS how
               FROM br JOIN loc ON br.k = upper(loc.location_name) OR contains(br.k, upper(loc.location_name))
                                OR contains(upper(loc.location_name), br.k)),
         best AS (SELECT branch_id, arg_min(location_name, how * 1000 + rank_no) AS location_name,
                         arg_min(latitude, how * 1000 + rank_no) AS latitude,
                         arg_min(longitude, how * 1000 + rank_no) AS longitude FROM m GROUP BY branch_id),
         dflt AS (SELECT location_name, latitude, longitude FROM loc ORDER BY rank_no LIMIT 1)
    SELECT br.branch_id, coalesce(b.location_name, (SELECT location_name FROM dflt)) AS location_name,
           coalesce(b.latitude, (SELECT latitude FROM dflt)) AS latitude,
           coalesce(b.longitude, (SELECT longitude FROM dflt)) AS longitude
    FROM br LEFT JOIN best b ON b.branch_id = br.branch_id""", "branches", "contracts"))
def cmp_07(d):
    """CMP-07: branch -> location -> coordinates.  Exact name match first,
    then a substring match in either direction in list order, else the
    default (first) location.  The location list is small and broadcast."""
    loc = d.t.region.select(F.col("r_regionkey").alias("rank_no"), F.col("r_name").alias("location_name"),
                            (F.col("r_regionkey") * 10).cast("double").alias("latitude"),
                            (F.col("r_regionkey") * 20).cast("double").alias("longitude"))
    br = d.branches.join(d.contracts.select("branch_id").distinct(), "branch_id", "left_semi").select(
        "tenant_id", "branch_id", F.upper("city_name").alias("k"))
    ln = F.upper("location_name")
    m = br.join(F.broadcast(loc), (F.col("k") == ln) | F.col("k").contains(ln) | ln.contains(F.col("k")))
    order = F.when(F.col("k") == ln, 0).otherwise(1) * 1000 + F.col("rank_no")
    best = m.groupBy("branch_id").agg(F.min_by(F.struct("location_name", "latitude", "longitude"), order).alias("b"))
    first = loc.agg(F.min_by(F.struct("location_name", "latitude", "longitude"), "rank_no").alias("x"))
    dflt = first.select(F.lit(d.tenant_id).alias("tenant_id"), F.col("x.location_name").alias("d_name"),
                        F.col("x.latitude").alias("d_lat"), F.col("x.longitude").alias("d_lon"))
    j = br.join(best, "branch_id", "left").join(F.broadcast(dflt), "tenant_id")
    return j.select("branch_id", F.coalesce("b.location_name", "d_name").alias("location_name"),
                    F.coalesce("b.latitude", "d_lat").alias("latitude"),
                    F.coalesce("b.longitude", "d_lon").alias("longitude"))


@query("dt_02", with_views("""
    SELECT DISTINCT start_date AS d, CAST(dayofweek(start_date) AS INTEGER) AS weekday0,
           CAST(day(start_date) AS INTEGER) AS day_of_month,
           CAST(floor((dayofyear(start_date) + dayofweek(date_trunc('year', start_date)) - 1) / 7) AS INTEGER) + 1
             AS us_week,
           CAST(month(start_date) AS INTEGER) AS month_of_year, CAST(quarter(start_date) AS INTEGER) AS quarter,
           CAST(year(start_date) AS INTEGER) AS yr FROM contracts""", "contracts"))
def dt_02(d):
    """DT-02: DATEPART weekday (0 = Sunday) / day / US week / month /
    quarter and YEAR of every contract start day."""
    x = d.contracts.select(F.col("start_date").alias("d")).distinct()
    return x.select("d", cf.day_of_week0("d").cast("int").alias("weekday0"), F.dayofmonth("d").alias("day_of_month"),
                    cf.us_week("d").alias("us_week"), F.month("d").alias("month_of_year"),
                    F.quarter("d").alias("quarter"), F.year("d").alias("yr"))
