"""Broken units are set aside with their reasons; the others are saved."""

from pyspark.sql import functions as F

from ratewise.operators import quarantine as q

SHAPE = "run string, branch_id int, category_id int, day int, rate string"
UNIT = ["branch_id", "category_id"]


def _rules():
    rate = F.col("rate").try_cast("double")
    return {"missing": F.col("rate").isNull(), "no number": F.col("rate").isNotNull() & rate.isNull(), "not positive": rate <= 0}


ROWS = [("a", 1, 1, 1, "10"), ("a", 1, 1, 2, "12.5"), ("a", 1, 2, 1, "10"), ("a", 1, 2, 2, "x"), ("a", 1, 2, 3, "-1"), ("a", 2, 1, 1, None),
        ("a", None, 1, 1, "5"), ("a", None, 2, 1, "0"), ("a", 1, 1, 1, "10")]


def test_units_with_a_broken_row_are_set_aside_whole(spark):
    good, bad = q.split(spark.createDataFrame(ROWS, SHAPE), UNIT, _rules())
    assert sorted((r.branch_id or 0, r.category_id, r.day) for r in good.collect()) == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 2)]
    assert sorted((r.branch_id or 0, r.category_id, r.day, tuple(r.reasons)) for r in bad.collect()) == [
        (0, 2, 1, ("not positive",)), (1, 2, 1, ("no number", "not positive")), (1, 2, 2, ("no number", "not positive")),
        (1, 2, 3, ("no number", "not positive")), (2, 1, 1, ("missing",))]


def test_statistics_are_counted_from_what_was_written(spark, tmp_path):
    folder = str(tmp_path)
    stats = lambda saved, aside: {r.run: r for r in q.run_statistics(saved, aside, UNIT, ["run"], {"branch_id": "B", "category_id": "C"}).collect()}
    fine = stats(*q.save_run(spark.createDataFrame(ROWS[:2], SHAPE), f"{folder}/fine", UNIT, _rules(), ["run"]))["a"]
    assert (fine.recommendations_saved, fine.units_failed, fine.errors) == (2, 0, [])
    assert stats(*q.save_run(spark.createDataFrame([], SHAPE), f"{folder}/none", UNIT, _rules(), ["run"])) == {}
    q.save_run(spark.createDataFrame(ROWS, SHAPE), folder, UNIT, _rules(), ["run"])
    q.save_run(spark.createDataFrame([("b", 1, 1, 1, "3")], SHAPE), folder, UNIT, _rules(), ["run"])
    got = stats(*q.save_run(spark.createDataFrame(ROWS, SHAPE), folder, UNIT, _rules(), ["run"]))  # saved again: replaced
    a, b = got["a"], got["b"]
    assert (a.units_processed, a.units_failed, a.recommendations_generated, a.recommendations_saved, a.recommendations_quarantined) == (2, 3, 9, 4, 5)
    assert a.errors == ["B-/C2: not positive", "B1/C2: no number, not positive", "B2/C1: missing"]
    assert (b.units_processed, b.units_failed, b.recommendations_saved, b.errors) == (1, 0, 1, [])
