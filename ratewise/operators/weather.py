"""Weather operators (SRC-02, SIG-W1, SIG-W2, WTH-01..04, AGG-12)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.mathx import rnd
from ratewise.functions.signals import bad_weather_score, extreme_heat

WEATHER_VALUES = ["t_max", "t_min", "t_mean", "precipitation_sum", "wind_max"]


def score_weather(weather: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Add SIG-W1 bad-weather score, SIG-W2 heat flag and the forecast flag
    (rows on or after ``as_of`` are forecasts)."""
    out = weather.select(
        "*",
        bad_weather_score("precipitation_sum", "wind_max", "weather_code").alias("bad_weather_score"),
        extreme_heat("t_max").alias("extreme_heat_flag"),
    )
    flag = F.lit(False) if as_of is None else F.col("weather_date") >= F.lit(as_of)
    return out.withColumn("is_forecast", flag)


def weather_range(weather: DataFrame, start: dt.date, end: dt.date, branch_id: int | None = None) -> DataFrame:
    """WTH-01: weather for a branch (or all) and date range, NULL -> 0."""
    cond = F.col("weather_date").between(F.lit(start), F.lit(end))
    if branch_id is not None:
        cond &= F.col("branch_id") == branch_id
    w = weather.where(cond)
    return w.select("tenant_id", "branch_id", "weather_date",
                    *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in WEATHER_VALUES],
                    F.coalesce("weather_code", F.lit(0)).alias("weather_code"))


def chunk_ranges(ranges: DataFrame, days: int = 100) -> DataFrame:
    """WTH-02: split each [start_date, end_date] into chunks of <= ``days``."""
    starts = F.sequence(F.col("start_date"), F.col("end_date"), F.expr(f"INTERVAL {days} DAYS"))
    x = ranges.select("*", F.posexplode(starts).alias("chunk_no", "chunk_start"))
    return x.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("end_date")))


def weather_payload(weather: DataFrame) -> DataFrame:
    """Build the provider's daily payload (parallel arrays) per branch.

    The arrays of one branch hold one entry per day of the branch's
    history; they are sorted by date through ``array_sort`` on structs.
    """
    s = F.array_sort(F.collect_list(F.struct(
        F.date_format("weather_date", "yyyy-MM-dd").alias("time"),
        "t_max", "t_min", "t_mean", "precipitation_sum", "wind_max", "weather_code")))
    g = weather.groupBy("tenant_id", "branch_id").agg(s.alias("d"))
    daily = F.struct(
        F.col("d.time").alias("time"),
        F.col("d.t_max").alias("temperature_2m_max"),
        F.col("d.t_min").alias("temperature_2m_min"),
        F.col("d.t_mean").alias("temperature_2m_mean"),
        F.col("d.precipitation_sum").alias("precipitation_sum"),
        F.col("d.wind_max").alias("wind_speed_10m_max"),
        F.col("d.weather_code").alias("weather_code"),
    )
    return g.select("tenant_id", "branch_id", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


PAYLOAD_SCHEMA = ("daily struct<time:array<string>, temperature_2m_max:array<double>, "
                  "temperature_2m_min:array<double>, temperature_2m_mean:array<double>, "
                  "precipitation_sum:array<double>, wind_speed_10m_max:array<double>, "
                  "weather_code:array<int>>")


def normalise_payload(payloads: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """SRC-02: provider payload -> one row per day; missing values -> 0,
    then score and heat flag (SIG-W1 / SIG-W2)."""
    p = payloads.select("tenant_id", "branch_id", F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    z = p.select("tenant_id", "branch_id", F.explode(F.arrays_zip(
        F.col("p.daily.time").alias("time"),
        F.col("p.daily.temperature_2m_max").alias("t_max"),
        F.col("p.daily.temperature_2m_min").alias("t_min"),
        F.col("p.daily.temperature_2m_mean").alias("t_mean"),
        F.col("p.daily.precipitation_sum").alias("precipitation_sum"),
        F.col("p.daily.wind_speed_10m_max").alias("wind_max"),
        F.col("p.daily.weather_code").alias("weather_code"),
    )).alias("z"))
    rows = z.select(
        "tenant_id", "branch_id", F.to_date("z.time").alias("weather_date"),
        *[F.coalesce(F.col(f"z.{c}"), F.lit(0.0)).alias(c) for c in WEATHER_VALUES],
        F.coalesce(F.col("z.weather_code"), F.lit(0)).alias("weather_code"),
    )
    return score_weather(rows, as_of)


def weather_summary(weather: DataFrame) -> DataFrame:
    """AGG-12: rows, branches, date range, forecast vs historical rows."""
    return weather.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("branch_id").alias("branches"),
        F.min("weather_date").alias("min_date"),
        F.max("weather_date").alias("max_date"),
        F.sum(F.when(F.col("is_forecast"), 1).otherwise(0)).alias("forecast_rows"),
        F.sum(F.when(~F.col("is_forecast"), 1).otherwise(0)).alias("historical_rows"),
    )


def next_24h(hourly: DataFrame, keys: list[str], ts_col: str = "ts") -> DataFrame:
    """WTH-04: for every hourly reading, mean and max temperature, mean
    wind and min visibility over the following 24 hours (RANGE frame on
    epoch seconds, current reading excluded)."""
    w = (Window.partitionBy(*keys).orderBy(F.col(ts_col).cast("long"))
         .rangeBetween(1, 24 * 3600))
    return hourly.select(
        *keys, ts_col,
        rnd(F.avg("temperature").over(w), 4).alias("temp_mean_24h"),
        F.max("temperature").over(w).alias("temp_max_24h"),
        rnd(F.sum(F.round(F.col("wind_speed") * 100.0).cast("long")).over(w)
            / F.count("wind_speed").over(w) / 100.0, 4).alias("wind_mean_24h"),
        F.min("visibility").over(w).alias("visibility_min_24h"),
    )
