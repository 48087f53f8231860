"""The global boosted model: matrix, fit, forecasts (FST-07, FCT-03, FCT-04).

One model learns all series.  Everything that a row needs besides its own
columns -- the codes of branches and categories, the fills of missing values,
the order of the features, the trees -- is one fitted Spark ML pipeline, which
is saved and loaded as a whole.  So training rows and future rows cannot be
prepared differently, and an id that training has not seen has a code of its own.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.calendar import FACT_WEEKEND, calendar_parts
from ratewise.functions.mathx import rnd
from ratewise.sinks.io import materialize

SERIES = ["tenant_id", "branch_id", "category_id"]
CALENDAR = ["day_of_week", "day_of_month", "week_of_year", "month_of_year", "quarter", "is_weekend"]
FLAGS = ["is_public_holiday", "is_religious_holiday", "has_major_event"]
#: Numeric features and what stands for a missing value; the price's is the
#: median of the training rows, or this if there is none.
FILLS = {"lag_1d": 0.0, "lag_7d": 0.0, "rolling_7d": 0.0, "rolling_30d": 0.0, "temperature_avg": 30.0,
         "precipitation_mm": 0.0, "event_score": 0.0, "price": 200.0}
FEATURES = ["branch_code", "category_code", *CALENDAR, *FLAGS, *FILLS]
#: Values of a series that its next day's features look back on.
TAIL = 30
#: Days of a recursive forecast between two cuts of its lineage.
CUT_DAYS = 5


def matrix_rows(fs: DataFrame) -> DataFrame:
    """FST-07: the feature store's rows under the model's names, flags as 0 / 1,
    missing values still NULL."""
    number = lambda c: F.col(c).cast("double")
    return fs.select(
        *SERIES, "demand_date", "split_flag", number("executed_rentals_count").alias("target"), *[F.col(c).cast("int").alias(c) for c in (*CALENDAR, *FLAGS)],
        number("rentals_lag_1d").alias("lag_1d"), number("rentals_lag_7d").alias("lag_7d"), number("rentals_rolling_7d_avg").alias("rolling_7d"),
        number("rentals_rolling_30d_avg").alias("rolling_30d"), number("temperature_avg").alias("temperature_avg"),
        number("precipitation_mm").alias("precipitation_mm"), number("event_score").alias("event_score"), number("avg_base_price_paid").alias("price"))


def preparation(rows: DataFrame) -> Pipeline:
    """The stages before the trees: fills, codes in the order of the ids (one
    more for ids and NULLs that are not in ``rows``), features in one vector."""
    median = rows.agg(F.percentile("price", 0.5)).first()[0]
    fills = FILLS if median is None else {**FILLS, "price": median}
    keys = {c: f"CASE WHEN {c}_id >= 0 THEN lpad(CAST({c}_id AS STRING), 20, '0') ELSE CAST({c}_id AS STRING) END" for c in ("branch", "category")}
    filled = SQLTransformer(statement="SELECT *, " + ", ".join(
        [f"{sql} AS {c}_key" for c, sql in keys.items()] + [f"coalesce({c}, {float(v)!r}D) AS {c}_filled" for c, v in fills.items()]) + " FROM __THIS__")
    codes = StringIndexer(inputCols=[f"{c}_key" for c in keys], outputCols=[f"{c}_code" for c in keys], stringOrderType="alphabetAsc", handleInvalid="keep")
    vector = VectorAssembler(inputCols=[f"{c}_filled" if c in fills else c for c in FEATURES], outputCol="features")
    return Pipeline(stages=[filled, codes, vector])


def model_matrix(fs: DataFrame) -> DataFrame:
    """FST-07: the features of every row as columns, prepared as the model's are."""
    rows = matrix_rows(fs)
    out = preparation(rows).fit(rows).transform(rows)
    return out.select(*SERIES, "demand_date", "split_flag", "target", F.col("branch_code").cast("int"), F.col("category_code").cast("int"), *CALENDAR, *FLAGS,
                      *[rnd(f"{c}_filled", 4).alias(c) if c == "price" else F.col(f"{c}_filled").alias(c) for c in FILLS])


def series_tails(context: DataFrame) -> DataFrame:
    """Each series' last values (oldest first, at most ``TAIL``) and last price,
    and its tenant's last day."""
    latest = Window.partitionBy(*SERIES).orderBy(F.desc("demand_date"))
    last = context.select(*SERIES, "demand_date", F.col("executed_rentals_count").cast("double").alias("v"), F.col("avg_base_price_paid").cast("double").alias("p"),
                          F.row_number().over(latest).alias("n")).where(F.col("n") <= TAIL)
    tails = last.groupBy(*SERIES).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "v")))).alias("x"), F.max(F.when(F.col("n") == 1, F.col("p"))).alias("price"))
    ends = context.groupBy("tenant_id").agg(F.max("demand_date").alias("last_date"))
    return tails.join(F.broadcast(ends), "tenant_id").select(*SERIES, F.col("x.v").alias("tail"), "price", "last_date")  # broadcast: a row per tenant


def _future(tails: DataFrame) -> DataFrame:
    """Feature rows of the days ``horizon_day`` after the last one, from the tails."""
    day = F.date_add("last_date", F.col("horizon_day"))
    mean = lambda n: F.aggregate(F.slice("tail", F.greatest(F.size("tail") - n + 1, F.lit(1)), n), F.lit(0.0), lambda s, x: s + x) / F.least(F.size("tail"), F.lit(n))
    week_ago = F.when(F.size("tail") >= 7, F.try_element_at("tail", F.lit(-7))).otherwise(F.element_at("tail", -1))
    values = {"lag_1d": F.element_at("tail", -1), "lag_7d": week_ago, "rolling_7d": mean(7), "rolling_30d": mean(TAIL),
              "temperature_avg": F.lit(30.0), "precipitation_mm": F.lit(0.0), "event_score": F.lit(0.0), "price": F.col("price")}
    parts = [F.when(F.lit(True), c).cast("int").alias(n) for c, n in zip(calendar_parts(day, FACT_WEEKEND), CALENDAR, strict=True)]
    return tails.select("*", day.alias("feature_date"), *parts, *[F.lit(0).alias(c) for c in FLAGS], *[v.alias(c) for c, v in values.items() if c != "price"])


def future_rows(context: DataFrame, horizon: int) -> DataFrame:
    """FCT-04: a feature row per series and horizon day after the context's last
    day: all calendar parts, the last known lags, means over the last 7 and 30
    values, constants for weather, events and holidays, the last price."""
    days = series_tails(context).withColumn("horizon_day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return _future(days).drop("tail", "last_date")


class BoostedTrees:
    """FCT-03.  ``lags`` says what future days look back on: the ``last_known``
    values, or, ``recursive``, also the forecasts of the days between."""

    name, version = "boosted_trees", "1.0"

    def __init__(self, trees: int = 100, depth: int = 6, step: float = 0.1, seed: int = 42, lags: str = "last_known"):
        if lags not in ("last_known", "recursive"):
            raise ValueError(f"unknown lags {lags!r}")
        self.trees, self.depth, self.step, self.seed, self.lags = trees, depth, step, seed, lags

    def fit(self, train: DataFrame) -> FittedTrees:
        """Of feature-store rows.  The fit reads its input once per tree, so the
        prepared matrix is written first."""
        rows = matrix_rows(train)
        prepared = preparation(rows).fit(rows)
        ready = materialize(prepared.transform(rows).select("features", "target"), "training_matrix")
        trees = GBTRegressor(maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, seed=self.seed, labelCol="target", cacheNodeIds=True).fit(ready)
        return FittedTrees(PipelineModel([*prepared.stages, trees]), self.lags)


class FittedTrees:
    def __init__(self, pipeline: PipelineModel, lags: str = "last_known"):
        self.pipeline, self.lags = pipeline, lags

    def save(self, path: str) -> None:
        self.pipeline.write().save(path)

    @classmethod
    def load(cls, path: str, lags: str = "last_known") -> FittedTrees:
        return cls(PipelineModel.load(path), lags)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``, at least 0."""
        out = self.pipeline.transform(rows)
        return out.select(*rows.columns, F.greatest("prediction", F.lit(0.0)).alias("prediction"))

    def predict(self, horizon: int, context: DataFrame) -> DataFrame:
        """A forecast per series and day of the horizon after the context's last day."""
        if self.lags == "last_known":
            out = self.score(future_rows(context, horizon)).withColumnRenamed("feature_date", "forecast_date")
        else:
            out = self._recursive(horizon, context)
        return out.select(*SERIES, "horizon_day", "forecast_date", rnd("prediction", 4).alias("forecast_demand"))

    def _recursive(self, horizon: int, context: DataFrame) -> DataFrame:
        """Day by day: a day's forecast is the last value of the next day's tail.
        A series is one narrow row throughout."""
        state = series_tails(context).withColumn("path", F.array().cast("array<double>"))
        keep = [*SERIES, "price", "last_date"]
        for day in range(1, horizon + 1):
            if (day - 1) % CUT_DAYS == 0:
                state = materialize(state, "forecast_state")
            scored = self.score(_future(state.withColumn("horizon_day", F.lit(day))))
            value = F.array("prediction")
            state = scored.select(*keep, F.slice(F.concat("tail", value), F.greatest(F.size("tail") + 2 - TAIL, F.lit(1)), TAIL).alias("tail"),
                                  F.concat("path", value).alias("path"))
        days = state.select(*SERIES, "last_date", F.posexplode("path").alias("i", "prediction"))
        return days.select(*SERIES, (F.col("i") + 1).alias("horizon_day"), F.date_add("last_date", F.col("i") + 1).alias("forecast_date"), "prediction")
