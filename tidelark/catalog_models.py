"""Queries of workflows, grids, races and stacks, forecasts, outcome-based selection and row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import KEY, _daily, _day, _g, _o, _query, _r, _series, _w
from .operators import choice as C
from .operators import forecast as FC
from .operators import learners as L
from .operators import rows as R
from .plans import ranking, tuning
from .plans.recipe import Recipe
from .sources.tables import load

_Y = "l_extendedprice"
_GRID = [{".config": f"config_{i:03d}", "penalty": p} for i, p in enumerate((0.0, 1000.0, 100000.0), 1)]
_FOLDS = "(l_orderkey * 7919 + 1) % 1000003 % 5 + 1"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", _Y, "l_returnflag", F.expr(_FOLDS).alias("fold"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return tuning.tune_grid(_lines(spark, d), _Y, {"quantity": ["l_quantity"]}, _GRID, "fold")


_grid_sql = f"""WITH t AS (SELECT {_FOLDS} AS fold, l_quantity AS x, {_Y} AS y FROM lineitem),
s AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM t GROUP BY 1),
o AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s),
r AS (SELECT fold, o.n - s.n AS n, o.sx - s.sx AS sx, o.sy - s.sy AS sy, o.sxx - s.sxx AS sxx, o.sxy - s.sxy AS sxy FROM s CROSS JOIN o),
c AS (SELECT fold, config, p, (sxy - sx * sy / n) / (sxx - sx * sx / n + p) AS b, sx / n AS mx, sy / n AS my FROM r CROSS JOIN (VALUES ('config_001', 0.0::DOUBLE), ('config_002', 1000.0::DOUBLE), ('config_003', 100000.0::DOUBLE)) AS g(config, p)),
m AS (SELECT t.fold, config, p, sqrt(avg((y - my - b * (x - mx)) ** 2)) AS rmse, 1 - sum((y - my - b * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r_squared FROM t JOIN c USING (fold) GROUP BY 1, 2, 3),
l AS (SELECT config, p, fold, 'rmse' AS metric, rmse AS value FROM m UNION ALL SELECT config, p, fold, 'r_squared', r_squared FROM m) """
_query("tune_grid", lambda spark, d: _grid(spark, d).withColumnRenamed(".config", "config").withColumn("value", F.round("value", 3)).select("wflow_id", "config", "penalty", "fold", "metric", "value"), _grid_sql + "SELECT 'quantity' AS wflow_id, config, p AS penalty, fold::VARCHAR AS fold, metric, round(value, 3) AS value FROM l")
_query("show_best", lambda spark, d: tuning.show_best(_grid(spark, d), "rmse", 2).select(F.col("`.config`").alias("config"), F.round("mean", 3).alias("mean"), "rank"), _grid_sql + "SELECT config, round(avg(value), 3) AS mean, (row_number() OVER (ORDER BY avg(value), config))::INT AS rank FROM l WHERE metric = 'rmse' GROUP BY 1 QUALIFY rank <= 2")
_query("select_by_one_std_err", lambda spark, d: ranking.select_by_one_std_err(_grid(spark, d).withColumnsRenamed({".config": "config"}).withColumn("neg", -F.col("penalty")), ["config", "neg"], "rmse", ["neg"]).select("config", F.round("mean", 3).alias("mean")), _grid_sql + ", a AS (SELECT config, p, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se FROM l WHERE metric = 'rmse' GROUP BY 1, 2) SELECT config, round(mean, 3) AS mean FROM a WHERE mean <= (SELECT mean + se FROM a ORDER BY mean, config LIMIT 1) ORDER BY p DESC LIMIT 1")
_query("tune_race_anova", lambda spark, d: tuning.tune_race_anova(_grid(spark, d)).withColumnsRenamed({".config": "config"}).withColumn("mean", F.round("mean", 3)))
_query("tune_race_win_loss", lambda spark, d: tuning.tune_race_win_loss(_grid(spark, d)).withColumnsRenamed({".config": "config"}).withColumn("mean", F.round("mean", 3)))
_SET = tuning.WorkflowSet.from_cross({"quantity": ["l_quantity"], "tax": ["l_tax"]}, {"linear_reg_1": tuning.LinearSpec()}, _Y)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d)
    train = None
    for name, cs in _SET.formulas.items():
        s = tuning.Workflow().add_formula(f"{_Y} ~ {' + '.join(cs)}").add_model(tuning.LinearSpec()).fit(t).stats()
        rows = s.select(F.lit(f"{name}_linear_reg_1").alias("wflow_id"), F.expr("stack(2, 'rmse', rmse, 'r_squared', r_squared) AS (metric, value)"))
        train = rows if train is None else train.unionByName(rows)
    out = ranking.compare_train_cv(train, _SET.workflow_map("fit_resamples", t, "fold"), ["wflow_id"])
    return out.select("wflow_id", *[F.round(c, 3).alias(c) for c in ("rmse_train", "rmse_cv", "rmse_overfit_ratio", "r_squared_generalization_drop")], "fit_quality")


_cmp = lambda x: f"""SELECT '{x[2:]}_linear_reg_1' AS wflow_id, fold, y, {x} AS x, (sum({x} * y) OVER () - sum({x} * y) OVER f) AS sxy, (sum({x}) OVER () - sum({x}) OVER f) AS sx, (sum(y) OVER () - sum(y) OVER f) AS sy, (sum({x} * {x}) OVER () - sum({x} * {x}) OVER f) AS sxx, (count(*) OVER () - count(*) OVER f)::DOUBLE AS n, regr_slope(y, {x}) OVER () AS b0, regr_intercept(y, {x}) OVER () AS a0 FROM t WINDOW f AS (PARTITION BY fold)"""
_query("compare_train_cv", _compared, f"""WITH t AS (SELECT {_FOLDS} AS fold, l_quantity, l_tax, {_Y} AS y FROM lineitem), u AS ({_cmp('l_quantity')} UNION ALL {_cmp('l_tax')}),
v AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM u), w AS (SELECT *, y - (sy / n + b * (x - sx / n)) AS e, y - a0 - b0 * x AS e0 FROM v),
f AS (SELECT wflow_id, fold, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM w GROUP BY 1, 2), c AS (SELECT wflow_id, avg(rmse) AS rmse_cv, avg(r2) AS r2_cv FROM f GROUP BY 1),
z AS (SELECT wflow_id, sqrt(avg(e0 * e0)) AS rmse_train, 1 - sum(e0 * e0) / (var_pop(y) * count(*)) AS r2_train FROM w GROUP BY 1)
SELECT wflow_id, round(rmse_train, 3) AS rmse_train, round(rmse_cv, 3) AS rmse_cv, round(rmse_cv / rmse_train, 3) AS rmse_overfit_ratio, round(r2_train - r2_cv, 3) AS r_squared_generalization_drop, CASE WHEN rmse_cv / rmse_train < 1.1 THEN 'good' WHEN rmse_cv / rmse_train < 1.5 THEN 'moderate_overfit' ELSE 'overfit' END AS fit_quality FROM z JOIN c USING (wflow_id)""")
_flow = tuning.Workflow().add_formula(f"{_Y} ~ l_quantity").add_model(tuning.LinearSpec())
_query("workflow_fit_nested", lambda spark, d: _flow.fit_nested(_lines(spark, d), ["l_returnflag"]).coefficients().withColumn("coefficient", F.round("coefficient", 3)), f"SELECT l_returnflag, 'Intercept' AS variable, round(regr_intercept({_Y}, l_quantity), 3) AS coefficient FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', round(regr_slope({_Y}, l_quantity), 3) FROM lineitem GROUP BY 1")
_query("workflow_evaluate", lambda spark, d: (lambda t: _flow.fit(t.where("fold > 1")).evaluate(t.where("fold = 1"), ["rmse", "mae"]).withColumn("value", F.round("value", 3)))(_lines(spark, d)), f"WITH t AS (SELECT {_FOLDS} AS fold, l_quantity AS x, {_Y} AS y FROM lineitem), c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE fold > 1), e AS (SELECT y - a - b * x AS e FROM t CROSS JOIN c WHERE fold = 1) SELECT 'rmse' AS metric, round(sqrt(avg(e * e)), 3) AS value FROM e UNION ALL SELECT 'mae', round(avg(abs(e)), 3) FROM e")
_query("workflow_fit_global", lambda spark, d: (lambda c: c.where("variable = 'l_quantity'").select("variable", F.round("coefficient", 3).alias("coefficient")))(_flow.fit_global(_lines(spark, d), "l_returnflag").coefficients()), f"WITH t AS (SELECT l_quantity - avg(l_quantity) OVER g AS x, {_Y} - avg({_Y}) OVER g AS y FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)) SELECT 'l_quantity' AS variable, round(sum(x * y) / sum(x * x), 3) AS coefficient FROM t")
_query("stacking", lambda spark, d: tuning.blend_predictions(_lines(spark, d).withColumn("charge", F.expr(f"{_Y} * (1 - l_discount) * (1 + l_tax)")), "charge", {"price": ([_Y], {}), "rates": (["l_discount", "l_tax"], {"penalty": 10.0})}, "fold").withColumn("weight", F.round("weight", 4)))


# trained classifiers
def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(*KEY, "l_discount", "l_tax", (F.col(_Y) / 1e5).alias("price"), F.expr("l_extendedprice * (1 - l_discount) > 40000").cast("int").alias("dear"))


def _classified(fit):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t, x = _flagged(spark, d), ["price", "l_discount", "l_tax"]
        return L.predict(fit(t, "dear", x), t, x).select(*KEY, F.col("`.pred`").cast("int").alias("pred"))

    return build


for _name, _fit in (("logistic_reg", L.logistic_reg), ("svm_linear", L.svm_linear), ("mlp", lambda t, y, x: L.mlp(t, y, x, epochs=20))):
    _query(_name, _classified(_fit))


# forecasts
def _ahead(model, h: int = 3):
    return lambda spark, d: FC.forecast(_daily(spark, d), "v", _g, _o, h, model).withColumnRenamed(".pred", "pred").withColumn("pred", F.round("pred", 4))


_num = _day + ", i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM s)"
_smooth = lambda a, v: f"sum({v} * CASE WHEN i = 1 THEN pow({1 - a}, n - 1) ELSE {a} * pow({1 - a}, n - i) END)"
_steps = " CROSS JOIN (SELECT unnest([1, 2, 3])::INT AS step) k"
_query("exp_smoothing_ses", _ahead(FC.exp_smoothing(alpha=0.3)), _num + f", f AS (SELECT event_type, {_smooth(0.3, 'v')} AS p FROM i GROUP BY 1) SELECT event_type, step, round(p, 4) AS pred FROM f" + _steps)
_query("theta", _ahead(FC.theta(0.3)), _num + f", r AS (SELECT event_type, regr_slope(v, i - 1) AS b, regr_intercept(v, i - 1) AS a FROM i GROUP BY 1), f AS (SELECT event_type, {_smooth(0.3, '(2 * v - a - b * (i - 1))')} AS p, max(n) AS n, max(a) AS a, max(b) AS b FROM i JOIN r USING (event_type) GROUP BY 1) SELECT event_type, step, round((p + a + b * (n + step - 1)) / 2, 4) AS pred FROM f" + _steps)
_query("recursive_reg", _ahead(FC.autoregression(1)), _num + f", l AS (SELECT *, lag(v) {_w} AS x FROM i), c AS (SELECT event_type, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, max_by(v, ts) AS y FROM l GROUP BY 1) SELECT event_type, step, round(CASE step WHEN 1 THEN a + b * y WHEN 2 THEN a + b * (a + b * y) ELSE a + b * (a + b * (a + b * y)) END, 4) AS pred FROM c" + _steps)
_query("arima_reg_random_walk", _ahead(FC.arima(0, 1, 0)), _num + ", c AS (SELECT event_type, max_by(v, ts) AS y, (max_by(v, ts) - min_by(v, ts)) / (max(n) - 1) AS m FROM i GROUP BY 1) SELECT event_type, step, round(y + step * m, 4) AS pred FROM c" + _steps)
for _name, _model in (("exp_smoothing_holt_winters", FC.exp_smoothing("additive", "additive", 7)), ("arima_reg", FC.arima(2, 1, 1)), ("auto_arima", FC.auto_arima()), ("croston", FC.croston()), ("seasonal_reg", FC.seasonal(7)), ("prophet_reg", FC.additive_trend()), ("arima_boost", FC.hybrid(FC.arima(1, 0, 0), FC.seasonal(7))), ("hybrid_model", FC.hybrid(FC.additive_trend(), FC.autoregression(2))), ("forecast_ensemble", FC.ensemble(FC.theta(), FC.seasonal(7)))):
    _query(_name, _ahead(_model))
_query("varmax_reg", lambda spark, d: FC.vector_autoregression(_daily(spark, d).withColumn("w", F.sin(F.col("v"))), ["v", "w"], _g, _o, 3).withColumnsRenamed({".pred_v": "pred_v", ".pred_w": "pred_w"}))


# selection by an outcome
_XS = ["l_quantity", "l_discount", _Y]
_OUT = "charge"
_CHARGE = f"{_Y} * (1 - l_discount) * (1 + l_tax)"


def _chosen(step, cols: list[str] | None = None):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select(*_XS, "l_tax", "l_returnflag", "l_linestatus", F.expr(_CHARGE).alias(_OUT))
        out = Recipe().add(step).prep(t).bake(t).columns
        return spark.createDataFrame([(c, c in out) for c in (cols or _XS)], "column_name string, kept boolean")

    return build


_corr = f"WITH r AS (SELECT 'l_quantity' AS column_name, abs(corr(l_quantity, {_CHARGE})) AS r FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, {_CHARGE})) FROM lineitem UNION ALL SELECT '{_Y}', abs(corr({_Y}, {_CHARGE})) FROM lineitem) "
_query("step_select_univariate", _chosen(C.step_select_univariate(_OUT, _XS, top_n=2)), _corr + "SELECT column_name, row_number() OVER (ORDER BY r DESC, column_name) <= 2 AS kept FROM r")
_query("step_select_lasso", _chosen(C.step_select_lasso(_OUT, _XS, 0.5)), _corr + "SELECT column_name, r > 0.5 AS kept FROM r")
for _name, _step in (
    ("step_select_ridge", C.step_select_ridge(_OUT, _XS, top_n=1)), ("step_select_elastic_net", C.step_select_elastic_net(_OUT, _XS, 0.1)), ("step_pvalue", C.step_pvalue(_OUT, _XS)), ("step_select_stepwise", C.step_select_stepwise(_OUT, _XS)),
    ("step_select_lofo", C.step_select_lofo(_OUT, _XS, 0.01)), ("step_select_permutation", C.step_select_permutation(_OUT, _XS, 1)), ("step_select_shap", C.step_select_shap(_OUT, _XS, 1)), ("step_vip", C.step_vip(_OUT, _XS)),
    ("step_filter_anova", C.step_filter_anova("l_returnflag", _XS)),
):
    _query(_name, _chosen(_step))
_query("step_filter_chisq", _chosen(C.step_filter_chisq("l_returnflag", ["l_linestatus"], 0.001), ["l_linestatus"]))
_query("step_filter_mutual_info", _chosen(C.step_filter_mutual_info("l_returnflag", ["l_linestatus"], 0.01), ["l_linestatus"]), "WITH p AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1, 2), q AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM p) SELECT 'l_linestatus' AS column_name, sum(p * ln(p / pa / pb)) > 0.01 AS kept FROM q")
_query("step_select_smart_corr", _chosen(C.step_select_smart_corr(["l_quantity", "l_discount", "l_tax", _Y], 0.5), ["l_quantity", "l_discount", "l_tax", _Y]), f"WITH c AS (SELECT abs(corr(l_quantity, {_Y})) AS q, abs(corr(l_discount, {_Y})) AS d, abs(corr(l_tax, {_Y})) AS t FROM lineitem) SELECT column_name, CASE column_name WHEN 'l_quantity' THEN q <= 0.5 WHEN 'l_discount' THEN d <= 0.5 WHEN 'l_tax' THEN t <= 0.5 ELSE true END AS kept FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax'), ('{_Y}')) AS n(column_name) CROSS JOIN c")


def _baked(step, keep: list[str], digits: int = 6):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select(*KEY, *_XS, "l_tax")
        return Recipe().add(step).prep(t).bake(t).select(*KEY, *[F.round(c, digits).alias(c) for c in keep])

    return build


_key = ", ".join(KEY)
_query("step_pls", _baked(C.step_pls(_Y, ["l_quantity", "l_tax"], 1), ["PLS1"], 4), f"WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS mt, stddev_samp(l_tax) AS st, corr(l_quantity, {_Y}) AS cq, corr(l_tax, {_Y}) AS ct FROM lineitem) SELECT {_key}, round(((l_quantity - mq) / sq * cq + (l_tax - mt) / st * ct) / sqrt(cq * cq + ct * ct), 4) AS \"PLS1\" FROM lineitem CROSS JOIN s")
_query("step_ns", _baked(C.step_ns(["l_quantity"], 2), ["l_quantity_ns_1", "l_quantity_ns_2"], 4), f"WITH k AS (SELECT min(l_quantity) AS a, quantile_cont(l_quantity, 0.5) AS b, max(l_quantity) AS c FROM lineitem) SELECT {_key}, round(l_quantity, 4) AS l_quantity_ns_1, round((greatest(l_quantity - a, 0) ** 3 - greatest(l_quantity - c, 0) ** 3) / (c - a) - (greatest(l_quantity - b, 0) ** 3 - greatest(l_quantity - c, 0) ** 3) / (c - b), 4) AS l_quantity_ns_2 FROM lineitem CROSS JOIN k")
_bs = "((l_quantity - a) / (c - a))"
_query("step_bs", _baked(C.step_bs(["l_quantity"], 3), ["l_quantity_bs_1", "l_quantity_bs_2", "l_quantity_bs_3"]), f"WITH k AS (SELECT min(l_quantity) AS a, max(l_quantity) AS c FROM lineitem) SELECT {_key}, round(3 * {_bs} * (1 - {_bs}) ** 2, 6) AS l_quantity_bs_1, round(3 * {_bs} ** 2 * (1 - {_bs}), 6) AS l_quantity_bs_2, round({_bs} ** 3, 6) AS l_quantity_bs_3 FROM lineitem CROSS JOIN k")

# rows and calendars
_query("step_filter", _baked(R.step_filter("l_quantity > 25"), ["l_quantity"]), f"SELECT {_key}, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_quantity > 25")
_query("step_bin", _baked(R.step_bin(["l_quantity"], 5), ["l_quantity"]), f"WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT {_key}, greatest(least(floor((l_quantity - a) / (b - a) * 5)::INT + 1, 5), 1) AS l_quantity FROM lineitem CROSS JOIN s")
_ord = lambda step, *keep: lambda spark, d: (lambda t: Recipe().add(step).prep(t).bake(t).select(*keep))(load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"))
_query("step_sample", _ord(R.step_sample("o_orderkey", 0.3), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE (o_orderkey * 7919 + 1) % 1000003 < 300000")
_query("step_slice", _ord(R.step_slice(["o_orderdate", "o_orderkey"], 50), "o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
_query("step_holiday", _ord(R.step_holiday("o_orderdate"), "o_orderkey", "o_orderdate_NewYear", "o_orderdate_IndependenceDay", "o_orderdate_Christmas"), "SELECT o_orderkey, (month(o_orderdate) = 1 AND day(o_orderdate) = 1)::INT AS \"o_orderdate_NewYear\", (month(o_orderdate) = 7 AND day(o_orderdate) = 4)::INT AS \"o_orderdate_IndependenceDay\", (month(o_orderdate) = 12 AND day(o_orderdate) = 25)::INT AS \"o_orderdate_Christmas\" FROM orders")
_query("step_harmonic", _baked(R.step_harmonic("l_quantity", 1.0, 12.0), ["l_quantity_sin_1", "l_quantity_cos_1"]), f"SELECT {_key}, round(sin(2 * pi() * l_quantity / 12), 6) AS l_quantity_sin_1, round(cos(2 * pi() * l_quantity / 12), 6) AS l_quantity_cos_1 FROM lineitem")
_query("filter_by_time", lambda spark, d: R.filter_by_time(load(spark, d, "events"), "ts", "2024-01-05", "2024-01-10").select("event_id", "ts"), "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
_query("future_frame", lambda spark, d: R.future_frame(_daily(spark, d), "ts", "day", _g, 3), _day + "SELECT event_type, ts + to_days(step) AS ts FROM (SELECT event_type, max(ts) AS ts FROM s GROUP BY 1)" + _steps)
_an = _day + ", a AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM s), q AS (SELECT event_type, quantile_cont(v - m, 0.25) AS lo, quantile_cont(v - m, 0.75) AS hi FROM a GROUP BY 1), z AS (SELECT a.*, v - m < lo - 0.5 * (hi - lo) OR v - m > hi + 0.5 * (hi - lo) AS odd FROM a JOIN q USING (event_type)) "
_query("anomalize", lambda spark, d: R.anomalize(_daily(spark, d), "v", _g, _o, 7, 0.5).select("event_type", "ts", "v_anomaly"), _an + "SELECT event_type, ts, odd AS v_anomaly FROM z")
_query("step_clean_anomalies", _series(lambda s: R.clean_anomalies(s, "v", _g, _o, 7, 0.5), ["v"]), _an + "SELECT event_type, ts, round(CASE WHEN odd THEN m ELSE v END, 6) AS v FROM z")
_query("ts_summary", lambda spark, d: _r(R.ts_summary(_daily(spark, d), "ts", _g), "gap_mean"), _day + f", g AS (SELECT event_type, ts, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) {_w} AS g FROM s) SELECT event_type, count(*) AS n, min(ts) AS start, max(ts) AS \"end\", min(g) AS gap_min, median(g)::DOUBLE AS gap_median, round(avg(g), 6) AS gap_mean, max(g) AS gap_max FROM g GROUP BY 1")
_query("ts_features", lambda spark, d: _r(R.ts_features(_daily(spark, d), "v", _g, _o), "mean", "variance", "acf1", "diff_acf1", "rises", "entropy"), _day + f", m AS (SELECT event_type, median(v) AS med, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1), a AS (SELECT s.*, med, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 10), 0), 9) AS bin, lag(v) {_w} AS b FROM s JOIN m USING (event_type)), e AS (SELECT *, lag(v - b) {_w} AS e FROM a), h AS (SELECT event_type, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM (SELECT event_type, bin, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1), f AS (SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance, round(corr(v, b), 6) AS acf1, round(corr(v - b, e), 6) AS diff_acf1, round(avg((v - b > 0)::INT), 6) AS rises, sum(((v > med) <> (b > med))::INT)::BIGINT AS crossings FROM e GROUP BY 1) SELECT f.*, round(entropy, 6) AS entropy FROM f JOIN h USING (event_type)")
_query("step_permutation_entropy", lambda spark, d: _r(R.permutation_entropy(_daily(spark, d), "v", _g, _o), "entropy"), _day + f", a AS (SELECT event_type, lag(v, 2) {_w} AS a, lag(v) {_w} AS b, v AS c FROM s), p AS (SELECT event_type, (b < a)::INT + (c < a)::INT AS x, (a <= b)::INT + (c < b)::INT AS y, count(*) AS n FROM a WHERE a IS NOT NULL GROUP BY 1, 2, 3) SELECT event_type, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(6), 6) AS entropy FROM p GROUP BY 1")
_query("step_best_lag", lambda spark, d: _r(R.best_lag(_daily(spark, d).withColumn("z", F.pow("v", F.lit(2))), "v", ["z"], _g, _o), "corr"), _day + "SELECT 'z' AS column_name, 0 AS lag, round(corr(v, v ** 2), 6) AS corr FROM s")
_query("augment_atr", _series(lambda s: R.atr(s.withColumns({"hi": F.col("v") + 1, "lo": F.col("v") - 1}), "hi", "lo", "v", _g, _o, 5), ["atr_5"]), _day + f", a AS (SELECT *, lag(v) {_w} AS b FROM s), t AS (SELECT *, greatest(2.0, abs(v + 1 - b), abs(v - 1 - b)) AS tr FROM a) SELECT event_type, ts, CASE WHEN row_number() {_w} >= 5 THEN round(avg(tr) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS atr_5 FROM t")
_query("augment_cmo", _series(lambda s: R.cmo(s, "v", _g, _o, 5), ["v_cmo_5"]), _day + f", a AS (SELECT *, v - lag(v) {_w} AS d FROM s) SELECT event_type, ts, CASE WHEN count(d) OVER f >= 5 THEN round(100 * sum(d) OVER f / nullif(sum(abs(d)) OVER f, 0), 6) END AS v_cmo_5 FROM a WINDOW f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
_query("step_volatility_ewm", _series(lambda s: R.volatility_ewm(s.withColumn("v", F.abs("v") + 1), "v", _g, _o, 0.5, 0.1), ["v_volatility"]), _day + f", a AS (SELECT *, ln((abs(v) + 1) / lag(abs(v) + 1) {_w}) AS r FROM s) SELECT event_type, ts, round(sqrt((coalesce(r * r, 0) + coalesce(lag(r * r, 1) {_w}, 0) * 0.5 + coalesce(lag(r * r, 2) {_w}, 0) * 0.25 + coalesce(lag(r * r, 3) {_w}, 0) * 0.125) / nullif((r IS NOT NULL)::INT + (lag(r, 1) {_w} IS NOT NULL)::INT * 0.5 + (lag(r, 2) {_w} IS NOT NULL)::INT * 0.25 + (lag(r, 3) {_w} IS NOT NULL)::INT * 0.125, 0)), 6) AS v_volatility FROM a")
