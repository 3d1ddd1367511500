"""Empty, null and NaN columns, large keys, directions of metrics, periods, roles."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelark.functions.multiclass import multiclass_metrics
from tidelark.operators import level_steps, periods, resample, rows
from tidelark.operators import series_steps as SS
from tidelark.operators import steps as S
from tidelark.plans import ranking
from tidelark.plans.recipe import Recipe


@pytest.mark.parametrize("step", [S.step_discretize, S.step_winsorizer, S.step_outlier_trimmer, S.step_filter_missing, S.step_normalize, S.step_nzv, S.step_percentile])
def test_nothing_to_learn_from(spark, step):
    nulls = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    for t in (nulls, nulls.where("false")):
        assert Recipe().add(step(["x"])).prep(t).bake(t).count() == t.count()


def test_nan_is_missing(spark):
    t = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "`x` double")
    got = [r[0] for r in Recipe().add(S.step_normalize(["x"])).prep(t).bake(t).collect()]
    assert got == [-1.0, None, 1.0]


def test_large_and_text_keys(spark):
    t = spark.createDataFrame([(2**62 + i, f"k{i}") for i in range(300)] + [(None, None)], "a long, b string")
    for key in "ab":
        folds = resample.vfold_cv(t, key, 5)
        assert {r[0] for r in folds.groupBy("fold").count().collect()} == {1, 2, 3, 4, 5}
        assert Recipe().add(rows.step_sample(key, 0.5), rows.step_shuffle(key)).prep(t).bake(t).count() in range(90, 210)
    assert resample.vfold_cv(t, "a", 5, repeats=2).groupBy("repeat").count().count() == 2


def test_directions(spark):
    rows_ = [(m, n, 1, v) for n, v in (("good", 0.1), ("bad", -50.0)) for m in ("mpe", "msd")] + [("huber_loss", "good", 1, 0.5), ("huber_loss", "bad", 1, 9.0), ("rsq", "good", 1, 0.9), ("rsq", "bad", 1, 0.1)]
    t = spark.createDataFrame(rows_, "metric string, model string, fold int, value double")
    for m in ("mpe", "msd", "huber_loss", "rsq"):
        assert ranking.rank_results(t, ["model"], m, 1).first()["model"] == "good"
        assert ranking.select_by_one_std_err(t, ["model"], m, ["model"]).first()["model"] == "good"
    with pytest.raises(ValueError):
        ranking.rank_results(t, ["model"], "unheard_of")


def test_periods(spark):
    assert periods.parse_period("3 months") == timedelta(days=90) and periods.parse_period("1 year") == timedelta(days=365) and periods.parse_period(5) == 5
    with pytest.raises(ValueError):
        periods.parse_period("soon")
    a, b = datetime(2020, 1, 1), datetime(2020, 12, 31)
    assert periods.parse_date("start + 1 week", a, b) == datetime(2020, 1, 8) and periods.parse_date("end", a, b) == b
    t = spark.range(100).select(F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"))
    with pytest.raises(ValueError):
        periods.split_by_ranges(t, "ts", ("start", "end"), ("2020-02-01", "end"))
    with pytest.raises(ValueError):
        periods.period_folds(t, "ts", "1 year", "1 month")
    folds = periods.period_folds(t, "ts", "30 days", "10 days", cumulative=False)
    assert {(r.role, r["count"]) for r in folds.groupBy("fold", "role").count().collect()} == {("train", 30), ("test", 10)}
    assert resample.time_series_cv(100, 50, 10, slice_limit=2) == [(0, 50, 50, 60), (0, 60, 60, 70)]


def test_check_class_and_levels(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    fitted = Recipe().add(level_steps.check_class()).prep(t)
    with pytest.raises(TypeError):
        fitted.bake(t.withColumn("n", F.col("n").cast("double")))
    with pytest.raises(ValueError):
        level_steps.levels(t, ["s"], most=1)


def test_best_lag_adds_the_lag(spark):
    t = spark.createDataFrame([("g", i, float((i * 37) % 11), float(((i - 2) * 37) % 11)) for i in range(2, 60)], "g string, i int, x double, y double")
    out = Recipe().add(SS.step_best_lag("y", ["x"], ["g"], ["i"])).prep(t).bake(t)
    assert out.columns[-1] == "x_lag_2" and out.where("i > 4 and x_lag_2 <> y").count() == 0


def test_two_classes_and_nothing(spark):
    t = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b")], "y string, p string")
    got = {r.metric: r.value for r in multiclass_metrics(t, "y", "p").collect()}
    assert got["accuracy"] == pytest.approx(2 / 3) and got["recall"] == pytest.approx(0.75)
    assert multiclass_metrics(t.where("false"), "y", "p").where("value is not null").count() == 0
