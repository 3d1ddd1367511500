"""Workflows, grids, stacks, selection and forecasts against plain numpy on small data."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelark.functions import distributions as P
from tidelark.operators import choice as C
from tidelark.operators import forecast as FC
from tidelark.operators import rows as R
from tidelark.plans import tuning as T
from tidelark.plans.recipe import Recipe


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.2 * x[:, 2] + rng.normal(size=120)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3], "y": y + 5, "fold": np.arange(120) % 4, "g": np.where(np.arange(120) % 3 == 0, "u", "v"), "t": np.arange(120)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def _ols(x, y, ridge=0.0):
    m = x.mean(0)
    b = np.linalg.solve((x - m).T @ (x - m) + ridge * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    return y.mean() - m @ b, b


def _kept(df, step):
    return set(Recipe().add(step).prep(df).bake(df).columns) & set("abcd")


def test_distributions():
    assert abs(P.t_tail(2.228138852, 10) - 0.05) < 1e-9 and abs(P.chi2_tail(7.814727903, 3) - 0.05) < 1e-9
    assert abs(P.f_tail(4.0, 1, 20) - P.t_tail(2.0, 20)) < 1e-12 and abs(P.t_quantile(0.95, 1e7) - 1.644854) < 1e-5


def test_grid_against_each_fold(df, pdf):
    got = T.tune_grid(df, "y", {"ab": ["a", "b"]}, [{".config": "p", "penalty": 5.0}], "fold").where("metric = 'rmse'").toPandas()
    for f, value in zip(got["fold"], got["value"], strict=True):
        rest, held = pdf[pdf.fold != int(f)], pdf[pdf.fold == int(f)]
        c, b = _ols(rest[["a", "b"]].to_numpy(), rest.y.to_numpy(), 5.0)
        assert abs(value - np.sqrt(((held.y - c - held[["a", "b"]].to_numpy() @ b) ** 2).mean())) < 1e-9
    assert len(got) == 4


def test_lasso_meets_its_conditions(df, pdf):
    g = T.square(T.fold_matrices(df, "y", list("abcd"), F.lit(0)).first()["gram"])
    beta = T.solve(g, [1, 2, 3, 4], 30.0, 1.0)
    slope = pdf[list("abcd")].to_numpy().T @ (pdf.y - beta[0] - pdf[list("abcd")].to_numpy() @ beta[1:]).to_numpy()
    assert all(abs(s - 30 * np.sign(b)) < 1e-6 if b else abs(s) <= 30 + 1e-6 for s, b in zip(slope, beta[1:], strict=True))
    assert beta[4] == 0


def test_stack_equals_out_of_fold_predictions(df, pdf):
    out = np.zeros((120, 2))
    for f, (k, cs) in itertools.product(range(4), enumerate((["a"], ["b", "c"]))):
        rest, held = pdf[pdf.fold != f], (pdf.fold == f).to_numpy()
        c, b = _ols(rest[cs].to_numpy(), rest.y.to_numpy())
        out[held, k] = c + pdf.loc[held, cs].to_numpy() @ b
    c, b = _ols(out, pdf.y.to_numpy())
    assert (b > 0).all()
    got = T.blend_predictions(df, "y", {"one": (["a"], {}), "two": (["b", "c"], {})}, "fold").toPandas()
    assert np.allclose(got.weight, [c, *b], atol=1e-6)


def test_races_drop_the_worse(df):
    results = T.tune_grid(df, "y", {"good": ["a", "b"], "bad": ["d"]}, [{".config": "p"}], F.col("t") % 10)
    for race in (T.tune_race_anova, T.tune_race_win_loss):
        got = {r.wflow_id: r for r in race(results).collect()}
        assert got["good"]["pass"] and got["good"].n == 10 and not got["bad"]["pass"] and got["bad"].n < 10


def test_workflow(df, pdf):
    flow = T.Workflow().add_formula("y ~ a + b").add_model(T.LinearSpec(T.tune()))
    for again in (lambda: flow.add_formula("y ~ ."), lambda: flow.add_model(T.LinearSpec()), lambda: flow.fit(df), lambda: T.Workflow().fit(df)):
        with pytest.raises(ValueError):
            again()
    fitted = flow.finalize({"penalty": 2.0}).fit_nested(df, ["g"])
    outputs, coefficients, stats = fitted.extract_outputs(df)
    for g in "uv":
        part = pdf[pdf.g == g]
        c, b = _ols(part[["a", "b"]].to_numpy(), part.y.to_numpy(), 2.0)
        assert np.allclose([r.coefficient for r in coefficients.where(F.col("g") == g).collect()], [c, *b])
    o = outputs.toPandas()
    assert len(o) == 120 and np.allclose(o.residuals, o.actuals - o[".pred"]) and stats.agg(F.sum("n")).first()[0] == 120
    unseen = df.limit(1).withColumn("g", F.lit("w"))
    assert fitted.predict(unseen).first()[".pred"] is None
    single = flow.finalize({"penalty": 0.0}).fit(df).predict(df).toPandas()
    c, b = _ols(pdf[["a", "b"]].to_numpy(), pdf.y.to_numpy())
    assert np.allclose(single[".pred"], c + single[["a", "b"]].to_numpy() @ b)
    assert flow.finalize({"penalty": 0.0}).fit(df.limit(0)).predict(df).first()[".pred"] is None
    with pytest.raises(ValueError):
        T.WorkflowSet.from_cross({"a": ["a"]}, {"m": T.LinearSpec()}, "y").workflow_map("nothing", df, "fold")
    assert len(T.grid_regular({"penalty": (0.01, 1, "log"), "mixture": (0, 1)}, 3)) == 9 and T.grid_random({"penalty": (0, 1)}, 4) == T.grid_random({"penalty": (0, 1)}, 4)


def test_selection(df, pdf):
    x, y, n = pdf[list("abcd")].to_numpy(), pdf.y.to_numpy(), 120
    sse = lambda at: ((y - (f := _ols(x[:, at], y))[0] - x[:, at] @ f[1]) ** 2).sum() if at else ((y - y.mean()) ** 2).sum()
    every = [list(c) for k in range(5) for c in itertools.combinations(range(4), k)]
    best = min(every, key=lambda at: n * np.log(sse(at) / n) + 2 * (len(at) + 1))
    for direction in ("forward", "backward"):
        assert _kept(df, C.step_select_stepwise("y", list("abcd"), direction=direction)) == {"abcd"[i] for i in best}
    f = [(sse([j for j in range(4) if j != i]) - sse([0, 1, 2, 3])) / (sse([0, 1, 2, 3]) / (n - 5)) for i in range(4)]
    assert _kept(df, C.step_pvalue("y", list("abcd"))) == {"abcd"[i] for i in range(4) if P.f_tail(f[i], 1, n - 5) < 0.05}
    lift = [(np.sqrt(sse([j for j in range(4) if j != i]) / n) - np.sqrt(sse([0, 1, 2, 3]) / n)) / y.std() for i in range(4)]
    assert _kept(df, C.step_select_lofo("y", list("abcd"), 0.05)) == {"abcd"[i] for i in range(4) if lift[i] > 0.05}
    for step in (C.step_select_permutation, C.step_select_shap, C.step_select_univariate):
        assert _kept(df, step("y", list("abcd"), 2)) == {"a", "b"}
    assert _kept(df, C.step_vip("y", list("abcd"))) == {"a", "b"} and _kept(df, C.step_select_ridge("y", list("abcd"), top_n=2)) == {"a", "b"}
    assert {"a", "b"} <= _kept(df, C.step_select_elastic_net("y", list("abcd"), 0.2)) <= {"a", "b", "c"}
    two = df.withColumn("k", F.when(F.col("a") > 0, "hi").otherwise("lo")).withColumn("l", F.when(F.col("a") > 1, "p").otherwise("q")).withColumn("m", F.lit("x"))
    assert _kept(two, C.step_filter_anova("k", list("abcd"), 0.001)) == {"a"}
    for step in (C.step_filter_chisq("k", ["l", "m"]), C.step_filter_mutual_info("k", ["l", "m"])):
        assert {"l", "m"} & set(Recipe().add(step).prep(two).bake(two).columns) == {"l"}


def test_pls_scores_are_orthogonal_and_fit(df, pdf):
    got = Recipe().add(C.step_pls("y", list("abcd"), 4)).prep(df).bake(df).orderBy("t").toPandas()
    s = got[["PLS1", "PLS2", "PLS3", "PLS4"]].to_numpy()
    r = np.corrcoef(s.T) - np.eye(4)
    c, b = _ols(s, pdf.y.to_numpy())
    e, k = _ols(pdf[list("abcd")].to_numpy(), pdf.y.to_numpy())
    assert np.abs(r).max() < 1e-8 and np.allclose(c + s @ b, e + pdf[list("abcd")].to_numpy() @ k)  # all components are the whole regression


def test_splines(df):
    got = Recipe().add(C.step_bs(["a"], 5)).prep(df).bake(df).toPandas()
    b = got[[c for c in got.columns if c.startswith("a_bs_")]].to_numpy()
    assert b.shape[1] == 5 and (b >= -1e-12).all() and (b.sum(1) <= 1 + 1e-9).all() and abs(b.max() - 1) < 1e-9


def _series(spark, v, name="s"):
    return spark.createDataFrame([(name, i, float(x)) for i, x in enumerate(v)], "g string, t int, v double")


def _ahead(spark, v, model, h):
    return FC.forecast(_series(spark, v), "v", ["g"], ["t"], h, model).orderBy("step").toPandas()[".pred"].to_numpy()


def test_forecasts(spark):
    cycle = np.array([3.0, -1.0, 0.0, -2.0])
    v = 10 + 0.5 * np.arange(40) + np.tile(cycle, 10)
    for model in (FC.seasonal(4, FC.exp_smoothing("additive", alpha=0.8, beta=0.8)), FC.additive_trend((4.0,), 2, 5, 1e3)):
        assert np.abs(_ahead(spark, v, model, 8) - (10 + 0.5 * np.arange(40, 48) + np.tile(cycle, 2))).max() < 0.3
    assert np.allclose(_ahead(spark, 10 + np.tile(cycle, 10), FC.exp_smoothing(None, "additive", 4), 6), 10 + np.r_[cycle, cycle[:2]])
    line = 2.0 * np.arange(20)
    assert np.allclose(_ahead(spark, line, FC.exp_smoothing("additive"), 3), [40, 42, 44]) and np.allclose(_ahead(spark, line, FC.arima(0, 1, 0), 3), [40, 42, 44])
    assert np.allclose(_ahead(spark, line**2, FC.arima(0, 2, 0), 3), np.array([40, 42, 44]) ** 2)
    rng = np.random.default_rng(1)
    w = [0.0]
    for e in rng.normal(size=3000):
        w.append(0.7 * w[-1] + e)
    assert abs(_ahead(spark, w, FC.arima(1, 0, 0), 1)[0] / w[-1] - 0.7) < 0.1
    e = rng.normal(size=4000)
    ma = e[1:] + 0.6 * e[:-1]
    f = FC.arima(0, 0, 1)(ma)[0]
    assert np.var(ma[50:] - f[50:]) < 1.1 < np.var(ma)
    assert np.allclose(_ahead(spark, [0, 4, 0, 4, 0, 4], FC.croston(), 2), 2) and np.allclose(_ahead(spark, np.zeros(5), FC.croston(), 2), 0)
    assert np.allclose(_ahead(spark, line, FC.ensemble(FC.arima(0, 1, 0), FC.arima(0, 1, 0)), 2), [40, 42])
    assert np.isfinite(_ahead(spark, rng.normal(size=60), FC.auto_arima(), 3)).all() and np.isfinite(_ahead(spark, [1.0], FC.theta(), 2)).all()


def test_fitted_keeps_rows_and_nulls(spark):
    df = _series(spark, range(6)).withColumn("v", F.when(F.col("t") != 2, F.col("v")))
    got = FC.fitted(df, "v", ["g"], ["t"], FC.exp_smoothing(alpha=0.5)).orderBy("t").collect()
    assert len(got) == 6 and got[2].fitted is None and got[1].fitted == 0.0 and got[3].fitted == 0.5


def test_vector_autoregression_of_a_linear_system(spark):
    v, w = [1.0], [0.0]
    for _ in range(30):
        v, w = v + [0.9 * v[-1] - 0.3 * w[-1]], w + [0.3 * v[-1] + 0.9 * w[-1]]
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))], "g string, t int, v double, w double")
    got = FC.vector_autoregression(df, ["v", "w"], ["g"], ["t"], 1).first()
    assert abs(got[".pred_v"] - (0.9 * v[-1] - 0.3 * w[-1])) < 1e-9 and abs(got[".pred_w"] - (0.3 * v[-1] + 0.9 * w[-1])) < 1e-9


def test_best_lag(spark):
    x = np.random.default_rng(3).normal(size=80)
    df = spark.createDataFrame([("s", i, float(x[i]), float(x[i - 2]) if i > 1 else 0.0) for i in range(80)], "g string, t int, x double, y double")
    got = R.best_lag(df, "y", ["x"], ["g"], ["t"]).first()
    assert got.lag == 2 and got.corr > 0.95


def test_autoregression_keeps_the_digits_of_large_values():
    """sums of many rows lie far from 0; the slope then came from products that had lost its digits."""
    rng = np.random.default_rng(1)
    v = rng.normal(0, 40.0, 31)
    near, far = (FC.autoregression(1)(v + level)[1](3) - level for level in (0.0, 2e6))
    assert np.allclose(near, far, rtol=0, atol=1e-6)  # apart by 74 before
    assert FC.autoregression(2)(np.full(12, 5.0))[1](2).tolist() == [5.0, 5.0]
    assert FC.arima(0, 1, 0)(np.arange(12.0))[1](2).tolist() == [12.0, 13.0]
