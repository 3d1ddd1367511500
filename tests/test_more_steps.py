"""Checks stop a bake; edge cases of further steps and metrics."""

import pytest
from pyspark.sql import functions as F

from tidelark.functions import class_metrics as CM
from tidelark.functions import metrics as M
from tidelark.operators import more_steps as S
from tidelark.plans.recipe import Recipe


def _prep(step, df):
    return Recipe().add(step).prep(df)


def test_checks(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, k string")
    for step, bad in ((S.check_missing(["x"]), df.withColumn("x", F.lit(None).cast("double"))), (S.check_range(["x"]), df.withColumn("x", F.lit(9.0))), (S.check_new_values(["k"]), df.withColumn("k", F.lit("z")))):
        fitted = _prep(step, df)
        assert fitted.bake(df).collect() == df.collect()
        with pytest.raises(Exception):  # noqa: B017
            fitted.bake(bad).collect()
    with pytest.raises(ValueError):
        _prep(S.check_cols(["x", "y"]), df)


def test_one_row_steps(spark):
    df = spark.createDataFrame([("a, b, a", 0.0, 0.0, 2), (None, 3.0, 4.0, 9)], "f string, x double, y double, n int")
    bake = lambda step: [tuple(r) for r in _prep(step, df).bake(df).collect()]
    assert [r[3:] for r in bake(S.step_dummy_extract("f"))] == [(2, 1), (0, 0)]
    assert [r[1:3] for r in bake(S.step_spatialsign(["x", "y"]))] == [(0.0, 0.0), (0.6, 0.8)]
    assert [r[3] for r in bake(S.step_num2factor(["n"], ["one", "two"]))] == ["two", None]
    assert [r[4] for r in bake(S.step_regex("f", "b", "has"))] == [1, None]
    assert _prep(S.step_rename_at(["x"], str.upper), df).bake(df).columns == ["f", "X", "y", "n"]
    paris_to_london = spark.createDataFrame([(48.8566, 2.3522)], "lat double, lon double")
    assert abs(_prep(S.step_geodist("lat", "lon", 51.5074, -0.1278), paris_to_london).bake(paris_to_london).first()["geo_dist"] - 343.6e3) < 1e3


def test_metrics_of_one_class_are_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "y int, p int")
    got = {r.metric: r.value for r in CM.class_metrics(df, "y", "p").collect()}
    assert got["sens"] == 0.5 and got["spec"] is None and got["mcc"] is None
    counts = spark.createDataFrame([(2, 1.5), (0, 0.5)], "y int, p double")
    value = M.metric_set(counts, "y", "p", ["poisson_log_loss"]).first().value
    import math

    assert abs(value - (1.5 - 2 * math.log(1.5) + math.log(2) + 0.5) / 2) < 1e-12


def test_perfect_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert all(abs(r.value - 1) < 1e-12 for r in CM.curve_areas(df, "y", "s").collect())
