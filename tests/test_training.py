"""The boosted model as a forecaster, evaluation, selection and saved runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratewise.operators import boosted as bo
from ratewise.operators import forecast as fc
from ratewise.operators import training as tr

START = dt.date(2000, 1, 3)
DAYS, TRAIN_DAYS = 90, 60


def _value(branch, category, i):
    return 20 + 5 * branch + 3 * category + (8 if i % 7 in (4, 5) else 0)


@pytest.fixture(scope="module")
def fs(spark):
    """A small feature store: two branches, two categories, one of them with few
    days, and gaps in what may be missing."""
    rows = []
    for b, c in ((2, 1), (2, 3), (11, 1), (11, 3)):
        for i in range(DAYS if (b, c) != (11, 3) else TRAIN_DAYS + 3):
            if (b, c) == (11, 3) and i < TRAIN_DAYS - 4:
                continue
            day = START + dt.timedelta(days=i)
            rows.append((1, b, c, day, _value(b, c, i), "TRAIN" if i < TRAIN_DAYS else "VALIDATION", None if i % 10 == 0 else 100.0 + b))
    df = spark.createDataFrame(rows, "tenant_id int, branch_id int, category_id int, demand_date date, executed_rentals_count long, split_flag string, "
                                     "avg_base_price_paid double")
    from pyspark.sql import Window
    w = Window.partitionBy("branch_id", "category_id").orderBy(F.unix_date("demand_date"))
    at = lambda n: F.max("executed_rentals_count").over(w.rangeBetween(-n, -n))
    mean = lambda n: F.avg("executed_rentals_count").over(w.rangeBetween(-n, -1))
    no = F.lit(False)
    df = df.select("*", *bo.calendar_parts("demand_date"), no.alias("is_public_holiday"), no.alias("is_religious_holiday"), no.alias("has_major_event"),
                   at(1).alias("rentals_lag_1d"), at(7).alias("rentals_lag_7d"), mean(7).alias("rentals_rolling_7d_avg"), mean(30).alias("rentals_rolling_30d_avg"),
                   F.lit(None).cast("double").alias("temperature_avg"), F.lit(None).cast("double").alias("precipitation_mm"), F.lit(None).cast("double").alias("event_score"))
    return df.cache()


TRAIN, HELD_OUT = "split_flag = 'TRAIN'", "split_flag <> 'TRAIN'"
SMALL = {"trees": 8, "depth": 3, "step": 0.3}


def test_codes_are_shared_and_unseen_ids_have_their_own(spark, fs):
    rows = bo.matrix_rows(fs)
    fitted = bo.preparation(rows).fit(rows)
    codes = {(r.branch_id, r.category_id): (r.branch_code, r.category_code) for r in fitted.transform(rows).collect()}
    assert codes == {(2, 1): (0, 0), (2, 3): (0, 1), (11, 1): (1, 0), (11, 3): (1, 1)}  # in the order of ids, not of their texts
    odd = rows.limit(1).drop("branch_id", "category_id").crossJoin(spark.createDataFrame([(7, 3), (None, -1), (11, None)], "branch_id int, category_id int"))
    assert {(r.branch_id, r.category_id): (r.branch_code, r.category_code) for r in fitted.transform(odd).collect()} == {
        (7, 3): (2, 1), (None, -1): (2, 2), (11, None): (1, 2)}
    one = fitted.transform(rows.where("demand_date = '2000-01-03' and branch_id = 2 and category_id = 1")).first()
    assert (one.price_filled, one.temperature_avg_filled, one.lag_1d_filled) == (102.0, 30.0, 0.0)  # the price is the median


def test_future_rows_look_back_on_the_tail(fs):
    rows = {(r.branch_id, r.category_id, r.horizon_day): r for r in bo.future_rows(fs.where(TRAIN), 3).collect()}
    assert len(rows) == 12
    r, last = rows[2, 1, 2], TRAIN_DAYS - 1
    v = [_value(2, 1, i) for i in range(TRAIN_DAYS)]
    assert r.feature_date == START + dt.timedelta(days=last + 2)
    assert (r.lag_1d, r.lag_7d, r.rolling_7d) == (v[-1], v[-7], sum(v[-7:]) / 7) and abs(r.rolling_30d - sum(v[-30:]) / 30) < 1e-9
    short = rows[11, 3, 1]  # four days only
    w = [_value(11, 3, i) for i in range(TRAIN_DAYS - 4, TRAIN_DAYS)]
    assert (short.lag_1d, short.lag_7d, short.rolling_7d, short.rolling_30d) == (w[-1], w[-1], sum(w) / 4, sum(w) / 4)
    assert (r.day_of_week, r.day_of_month, r.quarter) == ((r.feature_date.weekday() + 1) % 7, r.feature_date.day, 1)


def test_saved_model_predicts_the_same(fs, tmp_path):
    fitted = bo.BoostedTrees(**SMALL).fit(fs.where(TRAIN))
    fitted.save(f"{tmp_path}/m")
    key = lambda r: tuple(r)
    a = sorted(map(key, fitted.predict(5, fs.where(TRAIN)).collect()))
    assert a == sorted(map(key, bo.FittedTrees.load(f"{tmp_path}/m").predict(5, fs.where(TRAIN)).collect())) and len(a) == 20


def test_fit_beats_the_mean(fs):
    """Held out: the squared error is well under that of the training mean."""
    fitted = bo.BoostedTrees(**SMALL).fit(fs.where(TRAIN))
    held = fitted.score(bo.matrix_rows(fs.where(HELD_OUT)))
    mean = fs.where(TRAIN).agg(F.avg("executed_rentals_count")).first()[0]
    e = held.agg(F.avg(F.pow(F.col("target") - F.col("prediction"), 2)), F.avg(F.pow(F.col("target") - F.lit(mean), 2)), F.min("prediction")).first()
    assert e[0] < 0.3 * e[1] and e[2] >= 0


def test_recursive_forecast_equals_a_day_by_day_loop(fs):
    fitted = bo.BoostedTrees(**SMALL, lags="recursive").fit(fs.where(TRAIN))
    horizon = bo.CUT_DAYS + 2
    got = {(r.branch_id, r.category_id, r.horizon_day): r.forecast_demand for r in fitted.predict(horizon, fs.where(TRAIN)).collect()}
    assert len(got) == 4 * horizon
    state = bo.series_tails(fs.where(TRAIN)).collect()
    schema = bo.series_tails(fs.where(TRAIN)).schema
    tails = {(r.branch_id, r.category_id): r.asDict() for r in state}
    spark = fs.sparkSession
    for day in range(1, horizon + 1):
        now = spark.createDataFrame([tuple(t[c] for c in schema.names) for t in tails.values()], schema).withColumn("horizon_day", F.lit(day))
        for r in fitted.score(bo._future(now)).collect():
            assert abs(got[r.branch_id, r.category_id, day] - r.prediction) < 1e-3
            t = tails[r.branch_id, r.category_id]
            t["tail"] = (t["tail"] + [r.prediction])[-bo.TAIL:]


class Broken:
    name, version = "broken", "0"

    def fit(self, train):
        raise ValueError("cannot be fitted")


def test_training_run_scores_selects_refits_and_saves(spark, fs, tmp_path):
    models = {**{n: m for n, m in tr.MODELS.items() if n != "boosted_trees"}, "boosted_trees": bo.BoostedTrees(**SMALL), "broken": Broken()}
    as_of = START + dt.timedelta(days=DAYS - 6)
    run = tr.TrainingRun(f"{tmp_path}/run", models, horizon=7)
    saved = run.run(fs, as_of).collect()
    scores = {r.model_name: r for r in spark.read.parquet(f"{tmp_path}/run/evaluations").collect()}
    assert set(scores) == set(models) and scores["broken"].mae is None and "cannot" in scores["broken"].error
    assert {n for n, r in scores.items() if r.is_best_model} == {min((r.mae, n) for n, r in scores.items() if r.mae is not None)[1]}
    assert scores["broken"].training_samples == fs.where(TRAIN).count()
    # the baselines' scores are those of the two-model backtest
    known = {r.model_name: r.mae for r in fc.backtest(fc.total_demand(fs.where(F.col("demand_date") <= F.lit(as_of))), START + dt.timedelta(days=TRAIN_DAYS), 7).collect()}
    assert {n: scores[n].mae for n in known} == known
    chosen = next(n for n, r in scores.items() if r.is_best_model)
    picked = spark.read.parquet(f"{tmp_path}/run/selections").collect()
    assert [(r.selected_model, r.metric_value, r.selection_date) for r in picked] == [(chosen, scores[chosen].mae, as_of)]
    # forecasts begin the day after as_of: the model has learnt from all rows up to it
    assert {r.model_name for r in saved} == {chosen} and len(saved) == 4 * 7
    assert {r.forecast_date for r in saved} == {as_of + dt.timedelta(days=i) for i in range(1, 8)}
    again = tr.TrainingRun(f"{tmp_path}/run", {"seasonal_naive": tr.MODELS["seasonal_naive"]}, horizon=7, refit=False)
    assert {r.forecast_date for r in again.run(fs, as_of).collect()} == {START + dt.timedelta(days=TRAIN_DAYS - 1 + i) for i in range(1, 8)}
    assert spark.read.parquet(f"{tmp_path}/run/forecasts").count() == 4 * 7  # replaced
    assert spark.read.parquet(f"{tmp_path}/run/selections").count() == 2  # appended
    with pytest.raises(ValueError):
        run.run(fs.limit(0))
