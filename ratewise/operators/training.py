"""Training, evaluation, selection and saved forecasts (FCT-07, FCT-09, FCT-12,
FCT-14, SNK-04).

Every model is fitted on feature-store rows and then predicts series; the
registry holds them by name.  A training run fits all on TRAIN, scores them on
the first validation days, picks the best per tenant, fits that one again on
all rows up to ``as_of`` and saves metrics, selection and forecasts.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.operators import forecast as fc
from ratewise.operators.boosted import BoostedTrees
from ratewise.sinks import io


class Fitted(Protocol):
    def predict(self, horizon: int, context: DataFrame) -> DataFrame:
        """tenant_id, branch_id, category_id, horizon_day, forecast_date, forecast_demand."""


class Model(Protocol):
    name: str
    version: str

    def fit(self, train: DataFrame) -> Fitted: ...


class TopDown:
    """A model of the total demand, handed out to series by their share of the
    context's mean demand."""

    version = "1.0"

    def __init__(self, name: str, forecast: Callable[..., DataFrame]):
        self.name, self.forecast = name, forecast

    def fit(self, train: DataFrame) -> FittedTotal:
        return FittedTotal(self.forecast, fc.total_demand(train))


class FittedTotal:
    def __init__(self, forecast: Callable[..., DataFrame], total: DataFrame):
        self.forecast, self.total = forecast, total

    def predict_total(self, horizon: int, context: DataFrame) -> DataFrame:
        return self.forecast(self.total, horizon, ["tenant_id"]).select("tenant_id", "forecast_date", "forecast_demand")

    def predict(self, horizon: int, context: DataFrame) -> DataFrame:
        return fc.allocate(self.forecast(self.total, horizon, ["tenant_id"]), fc.series_share(context))


MODELS: dict[str, Model] = {**{name: TopDown(name, f) for name, f in fc.MODELS.items()}, BoostedTrees.name: BoostedTrees()}


def predicted_total(fitted: Fitted, horizon: int, context: DataFrame) -> DataFrame:
    """Total demand per day: a total model's own, else the sum over series."""
    if isinstance(fitted, FittedTotal):
        return fitted.predict_total(horizon, context)
    return fitted.predict(horizon, context).groupBy("tenant_id", "forecast_date").agg(F.sum("forecast_demand").alias("forecast_demand"))


def evaluate(models: Mapping[str, Model], fs: DataFrame, horizon: int) -> DataFrame:
    """FCT-07: each model, fitted on TRAIN, against the total demand of the first
    ``horizon`` validation days.  A model that cannot be fitted has a row
    without metrics and the reason in ``error``."""
    train = fs.where(F.col("split_flag") == "TRAIN")
    total = fc.total_demand(fs.where(F.col("split_flag") == "VALIDATION"))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("demand_date"))
    actual = total.withColumn("n", place).where(F.col("n") <= horizon).select("tenant_id", F.col("demand_date").alias("forecast_date"), "y")
    samples = fs.groupBy("tenant_id").agg(F.count_if(F.col("split_flag") == "TRAIN").alias("training_samples"),
                                          F.count_if(F.col("split_flag") == "VALIDATION").alias("validation_samples"))
    out = None
    for name, model in models.items():
        begun, error = time.monotonic(), None
        try:
            p = io.materialize(predicted_total(model.fit(train), horizon, train).withColumnRenamed("forecast_demand", "p"), "predicted")
            scored = fc.metrics(actual.join(p, ["tenant_id", "forecast_date"]), ["tenant_id"])
        except (PySparkException, ValueError) as e:
            error, scored = str(e)[:500], fc.metrics(actual.limit(0).withColumn("p", F.lit(0.0)), ["tenant_id"])
        row = (samples.join(scored, "tenant_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))
               .withColumn("model_name", F.lit(name)).withColumn("model_version", F.lit(model.version))
               .withColumn("training_time_sec", F.lit(time.monotonic() - begun)).withColumn("error", F.lit(error).cast("string")))
        out = row if out is None else out.unionByName(row)
    return out


class TrainingRun:
    """FCT-14 and its tables under ``folder``: evaluations and selections are
    appended, forecasts replace those of the same run date.

    ``as_of`` (default: the last day of ``fs``) is the run's date: rows after it
    are not seen.  With ``refit`` the chosen model learns from all rows up to it
    before it predicts, else from TRAIN alone."""

    def __init__(self, folder: str, models: Mapping[str, Model] = MODELS, horizon: int = 30, refit: bool = True):
        self.folder, self.models, self.horizon, self.refit = folder.rstrip("/"), models, horizon, refit

    def run(self, fs: DataFrame, as_of: dt.date | None = None) -> DataFrame:
        """The forecasts that were saved."""
        spark = fs.sparkSession
        seen = io.materialize(fs if as_of is None else fs.where(F.col("demand_date") <= F.lit(as_of)), "training_context")
        run_date = as_of or seen.agg(F.max("demand_date")).first()[0]
        if run_date is None:
            raise ValueError("no training data")
        scored = io.materialize(evaluate(self.models, seen, self.horizon), "evaluation")
        best = fc.select_best(scored)
        chosen = best.select("tenant_id", F.col("selected_model").alias("model_name"), F.lit(True).alias("is_best_model"))
        flagged = scored.join(F.broadcast(chosen), ["tenant_id", "model_name"], "left").withColumn("is_best_model", F.coalesce("is_best_model", F.lit(False)))
        io.append(flagged.withColumn("evaluation_date", F.lit(run_date)), f"{self.folder}/evaluations")
        io.append(selection_rows(best, run_date), f"{self.folder}/selections")
        names = sorted(r.model_name for r in chosen.select("model_name").distinct().collect())  # as many as models
        out = None
        for name in names:
            model = self.models[name]
            fitted = model.fit(seen if self.refit else seen.where(F.col("split_flag") == "TRAIN"))
            if hasattr(fitted, "save"):
                fitted.save(f"{self.folder}/models/{name}-{run_date}-{time.time_ns()}")
            own = chosen.where(F.col("model_name") == name).select("tenant_id")
            rows = fitted.predict(self.horizon, seen).join(F.broadcast(own), "tenant_id", "left_semi").select(
                "*", F.lit(run_date).alias("run_date"), F.lit(name).alias("model_name"), F.lit(model.version).alias("model_version"))
            out = rows if out is None else out.unionByName(rows)
        io.write_partitioned(out, f"{self.folder}/forecasts", ["run_date"])
        saved = spark.read.schema(out.schema).parquet(f"{self.folder}/forecasts")
        return saved.where(F.col("run_date") == F.lit(run_date))


def selection_rows(best: DataFrame, day: dt.date, metric: str = "mae") -> DataFrame:
    """SNK-04: the row that says which model a tenant's run has chosen, and why."""
    return best.select("tenant_id", "selected_model", F.lit(metric).alias("selection_metric"), "metric_value", F.lit(day).alias("selection_date"))
