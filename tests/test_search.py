"""Searches against all subsets or known structure; tests of series against plain regressions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelark.operators import series_tests as ST
from tidelark.plans import search
from tidelark.plans.recipe import Recipe


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5))
    y = 2 * x[:, 0] - x[:, 3] + rng.normal(size=200)
    return spark.createDataFrame(pd.DataFrame({**{c: x[:, i] for i, c in enumerate("abcde")}, "y": y, "fold": np.arange(200) % 8}))


def _kept(df, step):
    return set(Recipe().add(step).prep(df).bake(df).columns) & set("abcde")


def test_genetic_search_finds_the_best_of_all_subsets(df):
    loss = search.fold_losses(df, "y", list("abcde"), "fold")
    every = [list(c) for k in range(1, 6) for c in itertools.combinations("abcde", k)]
    assert _kept(df, search.step_select_genetic_algorithm("y", "fold", list("abcde"), population_size=30, generations=20)) == set(min(every, key=loss))
    assert _kept(df, search.step_select_genetic_algorithm("y", "fold", list("abcde"), top_n=1)) == {"a"}
    assert _kept(df, search.step_select_stability("y", "fold", list("abcde"), 0.15)) == {"a", "d"}


def test_searches_come_near_the_grid(df):
    loss = search.fold_losses(df, "y", list("abcde"), "fold")
    best = min(loss(list("abcde"), 10.0**p, m) for p in np.linspace(-3, 3, 25) for m in (0, 0.5, 1))
    for tuned in (search.tune_sim_anneal, search.tune_bayes):
        got = tuned(df, "y", list("abcde"), "fold").toPandas()
        assert got["mean"].min() < best * 1.02 and got["mean"].tolist() == tuned(df, "y", list("abcde"), "fold").toPandas()["mean"].tolist()
    with pytest.raises(ValueError):
        search.fold_losses(df, "y", ["a"], F.lit(1))


def test_ica_separates_mixed_uniforms(spark):
    s = np.random.default_rng(2).uniform(-1, 1, size=(4000, 2))
    m = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    got = Recipe().add(search.step_ica(["p", "q"])).prep(d := spark.createDataFrame(pd.DataFrame({"i": np.arange(4000), "p": m[:, 0], "q": m[:, 1]}))).bake(d).orderBy("i").toPandas()
    r = np.abs(np.corrcoef(np.column_stack((got.IC1, got.IC2, s)).T)[:2, 2:])
    assert (r.max(1) > 0.99).all() and (r.max(0) > 0.99).all()


def test_series_tests(spark):
    rng = np.random.default_rng(4)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    df = spark.createDataFrame([(g, i, float(v[i])) for g, v in (("noise", noise), ("walk", walk)) for i in range(300)], "g string, t int, v double")
    got = {r.g: r for r in ST.adf_test(df, "v", ["g"], ["t"]).collect()}
    x, d = walk[:-1], np.diff(walk)
    a = np.column_stack((np.ones(299), x))
    b, sse = np.linalg.lstsq(a, d, rcond=None)[:2]
    assert abs(got["walk"].statistic - b[1] / np.sqrt(sse[0] / 297 * np.linalg.inv(a.T @ a)[1, 1])) < 1e-6
    assert got["noise"].stationary and not got["walk"].stationary
    assert ST.adf_test(ST.stationary(df, "v", ["g"], ["t"]), "v", ["g"], ["t"]).where("stationary").count() == 2
    led = spark.createDataFrame([("g", i, float(noise[i]), float(noise[i + 1])) for i in range(299)], "g string, t int, y double, x double")
    assert ST.granger(led, "y", "x", ["g"], ["t"]).first().p_value is None or ST.granger(led, "y", "x", ["g"], ["t"]).first().p_value < 1e-6
    assert ST.granger(led.withColumn("z", F.sin(F.col("t") * 7.0)), "y", "z", ["g"], ["t"]).first().p_value > 0.001
