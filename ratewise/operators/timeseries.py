"""Series windows (WIN-02..05, WIN-13, WIN-14, FST-05, FST-06).

The reference computes lags with self-joins (each row joins up to 30
rows).  Here they are RANGE frames over a numeric day key: one sort per
series, one pass.  A RANGE frame counts calendar days, so a missing day
yields NULL for a lag, as the self-join does (a ``lag(1)`` would not).

Windows partition by the series key (tenant, branch, category) of the
*aggregated* fact: one partition holds at most one row per day of one
series, so a partition stays bounded however large the raw data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.calendar import day_number
from ratewise.functions.mathx import rnd

SERIES_KEYS = ["tenant_id", "branch_id", "category_id"]


def _series_window(keys, date_col):
    return Window.partitionBy(*keys).orderBy(day_number(date_col))


def calendar_lags(fact: DataFrame, value: str = "executed_rentals_count",
                  keys=SERIES_KEYS, date_col: str = "demand_date") -> DataFrame:
    """FST-05: lag 1 day, lag 7 days, trailing 7- and 30-day means
    (today excluded, existing rows only, 4 dp)."""
    w = _series_window(keys, date_col)
    return fact.select(
        "*",
        F.max(value).over(w.rangeBetween(-1, -1)).alias("rentals_lag_1d"),
        F.max(value).over(w.rangeBetween(-7, -7)).alias("rentals_lag_7d"),
        rnd(F.avg(value).over(w.rangeBetween(-7, -1)), 4).alias("rentals_rolling_7d_avg"),
        rnd(F.avg(value).over(w.rangeBetween(-30, -1)), 4).alias("rentals_rolling_30d_avg"),
    )


def split_flag(date_col, cutoff) -> F.Column:
    """FST-06: TRAIN before the cutoff date, VALIDATION from it on."""
    return F.when(F.col(date_col) < F.lit(cutoff), F.lit("TRAIN")).otherwise(F.lit("VALIDATION"))


def tail_stats(series: DataFrame, value: str, keys, date_col: str) -> DataFrame:
    """WIN-13: per series, last value, 7th from last, mean of last 7 and
    last 30 rows (row based), from one descending row-number pass.

    Only the last 30 rows of each series survive the ``rn <= 30`` filter;
    Spark applies that limit per group before the shuffle (group limit).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    ranked = series.select(*keys, date_col, value, F.row_number().over(w).alias("rn")).where("rn <= 30")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("last_value"),
        F.max(F.when(F.col("rn") == 7, F.col(value))).alias("value_7_back"),
        rnd(F.avg(F.when(F.col("rn") <= 7, F.col(value))), 4).alias("mean_last_7"),
        rnd(F.avg(F.col(value)), 4).alias("mean_last_30"),
        F.max(date_col).alias("last_date"),
    )


def sliding_sequences(series: DataFrame, features: list[str], target: str, keys,
                      date_col: str, length: int = 14) -> DataFrame:
    """WIN-14: each row with the ``length`` preceding rows' features as an
    ordered array; rows without a full history are dropped."""
    w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(-length, -1)
    seq = F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).over(w)
    out = series.select(*keys, date_col, F.col(target).cast("double").alias("target"), seq.alias("sequence"))
    return out.where(F.size("sequence") == length)
