"""Queries of further steps and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import KEY, _daily, _day, _fit_sql, _fitted, _g, _o, _query, _r, _w
from .functions import class_metrics as CM
from .functions import metrics as M
from .operators import more_steps as S
from .operators import series_tests as ST
from .plans import search
from .plans.recipe import Recipe
from .sources.tables import load

_key = ", ".join(KEY)


def _line(step, keep: list[str]):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", (F.col("l_linenumber") % 2).alias("odd"), F.when(F.col("l_quantity") > 9, F.col("l_quantity")).alias("gap"))
        return Recipe().add(step).prep(t).bake(t).select(*KEY, *[F.round(c, 6).alias(c) if dict(t.dtypes).get(c) != "string" and c not in ("odd",) else F.col(c) for c in keep])

    return build


def _sql(*exprs: str, stats: str = "") -> str:
    return f"SELECT {_key}, {', '.join(exprs)} FROM lineitem" + (f" CROSS JOIN (SELECT {stats} FROM lineitem) s" if stats else "")


_query("step_logit", _line(S.step_logit(["l_discount"], 0.01), ["l_discount"]), _sql("round(ln(greatest(least(l_discount, 0.99), 0.01)) - ln(1 - greatest(least(l_discount, 0.99), 0.01)), 6) AS l_discount"))
_query("step_invlogit", _line(S.step_invlogit(["l_discount"]), ["l_discount"]), _sql("round(1 / (1 + exp(-l_discount)), 6) AS l_discount"))
_query("step_hyperbolic", _line(S.step_hyperbolic(["l_tax"], "tanh", False), ["l_tax"]), _sql("round((exp(l_tax) - exp(-l_tax)) / (exp(l_tax) + exp(-l_tax)), 6) AS l_tax"))
_query("step_relu", _line(S.step_relu(["l_quantity"], 20.0), ["right_relu_l_quantity"]), _sql("round(greatest(l_quantity - 20, 0), 6) AS right_relu_l_quantity"))
_query("step_spatialsign", _line(S.step_spatialsign(["l_quantity", "l_tax"]), ["l_quantity", "l_tax"]), _sql(*[f"round({c} / sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS {c}" for c in ("l_quantity", "l_tax")]))
_query("step_geodist", _line(S.step_geodist("l_quantity", "l_tax", 10.0, 1.0, is_lat_lon=False), ["geo_dist"]), _sql("round(sqrt((l_quantity - 10) ** 2 + (l_tax - 1) ** 2), 6) AS geo_dist"))
_query("step_bin2factor", lambda spark, d: _line(S.step_bin2factor(["odd"]), ["odd"])(spark, d), _sql("CASE WHEN l_linenumber % 2 = 1 THEN 'yes' ELSE 'no' END AS odd"))
_query("step_relevel", _line(S.step_relevel("l_returnflag", "R"), ["l_returnflag"]), _sql("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END AS l_returnflag"))
_query("step_intercept", _line(S.step_intercept(), ["intercept"]), _sql("1.0::DOUBLE AS intercept"))
_query("step_rename", _line(S.step_rename(quantity="l_quantity"), ["quantity"]), _sql("round(l_quantity, 6) AS quantity"))
_query("step_mutate_at", _line(S.step_mutate_at(["l_quantity", "l_tax"], lambda x: x * 2), ["l_quantity", "l_tax"]), _sql("round(l_quantity * 2, 6) AS l_quantity", "round(l_tax * 2, 6) AS l_tax"))
_query("step_impute_lower", _line(S.step_impute_lower(["gap"]), ["gap"]), _sql("round(CASE WHEN l_quantity > 9 THEN l_quantity ELSE m END, 6) AS gap", stats="min(l_quantity) FILTER (WHERE l_quantity > 9) AS m"))
_x = "((l_quantity - lo) / (hi - lo))"
_query("step_poly_bernstein", _line(S.step_poly_bernstein("l_quantity", 2), ["l_quantity_bern_1", "l_quantity_bern_2"]), _sql(f"round(2 * {_x} * (1 - {_x}), 6) AS l_quantity_bern_1", f"round({_x} ** 2, 6) AS l_quantity_bern_2", stats="min(l_quantity) AS lo, max(l_quantity) AS hi"))
_query("step_classdist", _line(S.step_classdist("l_returnflag", ["l_quantity", "l_tax"]), [f"classdist_{v}" for v in "ANR"]), _sql(*[f'round(ln((l_quantity - q_{v}) ** 2 + (l_tax - t_{v}) ** 2), 6) AS "classdist_{v}"' for v in "ANR"], stats=", ".join(f"avg(l_quantity) FILTER (WHERE l_returnflag = '{v}') AS q_{v}, avg(l_tax) FILTER (WHERE l_returnflag = '{v}') AS t_{v}" for v in "ANR")))
_query("check_range", _line(S.check_range(["l_quantity"]), ["l_quantity"]), _sql("round(l_quantity, 6) AS l_quantity"))
_query("check_missing", _line(S.check_missing(["l_quantity"]), ["l_quantity"]), _sql("round(l_quantity, 6) AS l_quantity"))
_part = lambda step, *keep: lambda spark, d: (lambda t: Recipe().add(step).prep(t).bake(t).select("p_partkey", *keep))(load(spark, d, "part").select("p_partkey", "p_name", "p_type"))
_query("step_regex", _part(S.step_regex("p_name", "1", "has_one"), "has_one"), "SELECT p_partkey, regexp_matches(p_name, '1')::INT AS has_one FROM part")
_query("step_count", _part(S.step_count("p_name", "[0-9]", "digits"), "digits"), "SELECT p_partkey, len(regexp_extract_all(p_name, '[0-9]'))::INT AS digits FROM part")
_query("check_new_values", _part(S.check_new_values(["p_type"]), "p_type"), "SELECT p_partkey, p_type FROM part")
_query("step_dummy_extract", lambda spark, d: (lambda t: Recipe().add(S.step_dummy_extract("f", ",")).prep(t).bake(t))(load(spark, d, "events").select("event_id", F.concat_ws(",", "event_type", F.lit("any"), "event_type").alias("f"))).select("event_id", "f_any", "f_click"), "SELECT event_id, 1 AS f_any, CASE event_type WHEN 'click' THEN 2 ELSE 0 END AS f_click FROM events")
_query("step_time", lambda spark, d: (lambda t: Recipe().add(S.step_time("ts")).prep(t).bake(t).drop("ts"))(load(spark, d, "events").select("event_id", "ts")), "SELECT event_id, hour(ts)::INT AS ts_hour, minute(ts)::INT AS ts_minute, second(ts)::INT AS ts_second, (hour(ts) < 12)::INT AS ts_am FROM events")
_query("step_impute_roll", lambda spark, d: _r(S.impute_roll(_daily(spark, d).withColumn("v", F.when(F.dayofmonth("ts") % 4 != 0, F.col("v"))), "v", _g, _o), "v"), _day + ", g AS (SELECT event_type, ts, CASE WHEN day(ts) % 4 <> 0 THEN v END AS v FROM s) SELECT event_type, ts, round(coalesce(v, median(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS v FROM g")

# metrics
_more = {"huber_loss": "avg(CASE WHEN abs(v - f) <= 1 THEN (v - f) ** 2 / 2 ELSE abs(v - f) - 0.5 END)", "huber_loss_pseudo": "avg(sqrt(1 + (v - f) ** 2) - 1)", "rpd": "stddev_samp(v) / sqrt(avg((v - f) ** 2))", "rpiq": "(quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / sqrt(avg((v - f) ** 2))", "iic": "corr(v, f) * least(sum(greatest(f - v, 0)), sum(greatest(v - f, 0))) / greatest(sum(greatest(f - v, 0)), sum(greatest(v - f, 0)))"}
_query("metric_set_more", lambda spark, d: _r(M.metric_set(_fitted(spark, d), "v", "fitted", list(_more), _g), "value"), _fit_sql + " UNION ALL ".join(f"SELECT event_type, '{k}' AS metric, round({q}, 6) AS value FROM p GROUP BY 1" for k, q in _more.items()))
_lab = lambda spark, d: load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select((F.col("quality") == 1).cast("int").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), "lang", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))
_lab_sql = "WITH l AS (SELECT (quality = 1)::INT AS y, (n_chars > 1000)::INT AS p, lang, least(n_chars / 20000.0::DOUBLE, 1.0) AS score FROM labels JOIN documents USING (doc_id))"
_cells = ", c AS (SELECT {g}sum((y = 1 AND p = 1)::INT)::DOUBLE AS a, sum((y = 0 AND p = 1)::INT)::DOUBLE AS b, sum((y = 1 AND p = 0)::INT)::DOUBLE AS c, sum((y = 0 AND p = 0)::INT)::DOUBLE AS d FROM l{h}) "
_class = {"accuracy": "(a + d) / (a + b + c + d)", "sens": "a / nullif(a + c, 0)", "spec": "d / nullif(b + d, 0)", "ppv": "a / nullif(a + b, 0)", "npv": "d / nullif(c + d, 0)", "bal_accuracy": "(a / nullif(a + c, 0) + d / nullif(b + d, 0)) / 2", "j_index": "a / nullif(a + c, 0) + d / nullif(b + d, 0) - 1", "detection_prevalence": "(a + b) / (a + b + c + d)", "f_meas": "2 * a / nullif(2 * a + b + c, 0)", "kap": "((a + d) / (a + b + c + d) - ((a + b) * (a + c) + (c + d) * (b + d)) / (a + b + c + d) ** 2) / nullif(1 - ((a + b) * (a + c) + (c + d) * (b + d)) / (a + b + c + d) ** 2, 0)", "mcc": "(a * d - b * c) / nullif(sqrt((a + b) * (a + c) * (b + d) * (c + d)), 0)"}
_query("class_metrics", lambda spark, d: _r(CM.class_metrics(_lab(spark, d), "y", "p"), "value"), _lab_sql + _cells.format(g="", h="") + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({q}, 6) AS value FROM c" for k, q in _class.items()))
_query("fairness_metrics", lambda spark, d: _r(CM.fairness(_lab(spark, d), "y", "p", "lang"), "value"), _lab_sql + _cells.format(g="lang, ", h=" GROUP BY 1") + ", r AS (SELECT (a + b) / (a + b + c + d) AS s, a / nullif(a + c, 0) AS t, d / nullif(b + d, 0) AS u FROM c) SELECT 'demographic_parity' AS metric, round(max(s) - min(s), 6) AS value FROM r UNION ALL SELECT 'equal_opportunity', round(max(t) - min(t), 6) FROM r UNION ALL SELECT 'equalized_odds', round(greatest(max(t) - min(t), max(u) - min(u)), 6) FROM r")
_query("probability_metrics", lambda spark, d: _r(CM.probability_metrics(_lab(spark, d), "y", "score"), "value"), _lab_sql + ", k AS (SELECT *, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS s FROM l) SELECT 'mn_log_loss' AS metric, round(avg(-ln(CASE WHEN y = 1 THEN s ELSE 1 - s END)), 6) AS value FROM k UNION ALL SELECT 'brier_class', round(avg((y - score) ** 2), 6) FROM k")
_curve_sql = _lab_sql + ", a AS (SELECT score AS threshold, sum(y) AS p, count(*) AS n FROM l GROUP BY 1), k AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS n, sum(p) OVER () AS allp, sum(n) OVER () AS rows FROM a WINDOW w AS (ORDER BY threshold DESC)), v AS (SELECT threshold, tp, n, tp / nullif(allp, 0) AS sensitivity, 1 - (n - tp) / nullif(rows - allp, 0) AS specificity, tp / n AS precision, 100 * n / rows AS percent_tested, 100 * tp / nullif(allp, 0) AS percent_found, (tp * rows) / nullif(n * allp, 0) AS lift FROM k) "
_curve_cols = ["sensitivity", "specificity", "precision", "percent_tested", "percent_found", "lift"]
_query("roc_pr_gain_lift_curve", lambda spark, d: _r(CM.curve(_lab(spark, d), "y", "score"), "threshold", *_curve_cols), _curve_sql + "SELECT round(threshold, 6) AS threshold, tp, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _curve_cols) + " FROM v")
_query("curve_areas", lambda spark, d: _r(CM.curve_areas(_lab(spark, d), "y", "score"), "value"), _curve_sql + ", b AS (SELECT *, coalesce(lag(sensitivity) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, 1) AS p0, coalesce(lag(percent_tested) OVER w, 0) AS t0, coalesce(lag(percent_found) OVER w, 0) AS f0 FROM v WINDOW w AS (ORDER BY threshold DESC)) SELECT 'average_precision' AS metric, round(sum((sensitivity - r0) * precision), 6) AS value FROM b UNION ALL SELECT 'pr_auc', round(sum((sensitivity - r0) * (precision + p0) / 2), 6) FROM b UNION ALL SELECT 'gain_capture', round((sum((percent_tested - t0) * (percent_found + f0) / 2) / 1e4 - 0.5) / ((1 - (SELECT avg(y) FROM l)) / 2), 6) FROM b")


# searches, tests of series, hierarchies
_FOLD = "(l_orderkey * 7919 + 1) % 1000003 % 5"
_charge = lambda spark, d: load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", F.expr("l_extendedprice * (1 - l_discount)").alias("net"), F.expr(_FOLD).alias("fold"))
_XS = ["l_quantity", "l_discount", "l_extendedprice"]
_query("tune_sim_anneal", lambda spark, d: search.tune_sim_anneal(_charge(spark, d), "net", _XS, "fold").withColumnRenamed(".config", "config"))
_query("tune_bayes", lambda spark, d: search.tune_bayes(_charge(spark, d), "net", _XS, "fold").withColumnRenamed(".config", "config"))


def _selected(make):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = _charge(spark, d)
        out = Recipe().add(make()).prep(t).bake(t).columns
        return spark.createDataFrame([(c, c in out) for c in _XS], "column_name string, kept boolean")

    return build


_query("step_select_genetic_algorithm", _selected(lambda: search.step_select_genetic_algorithm("net", "fold", _XS, 2)))
_query("step_select_stability", _selected(lambda: search.step_select_stability("net", "fold", _XS, 0.1)))
_query("step_ica", lambda spark, d: (lambda t: _r(Recipe().add(search.step_ica(["l_quantity", "l_tax"])).prep(t).bake(t), "IC1", "IC2"))(load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_tax")))
_query("adf_test", lambda spark, d: _r(ST.adf_test(_daily(spark, d), "v", _g, _o), "statistic"), _day + f", l AS (SELECT event_type, lag(v) {_w} AS x, v - lag(v) {_w} AS d FROM s), r AS (SELECT event_type, regr_slope(d, x) AS b, regr_count(d, x) AS n, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy FROM l GROUP BY 1), t AS (SELECT event_type, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t FROM r) SELECT event_type, round(t, 6) AS statistic, t < -2.86 AS stationary FROM t")
_query("breusch_pagan", lambda spark, d: _r(ST.breusch_pagan(_fitted(spark, d), "e", "fitted", _g), "statistic"), _fit_sql + "SELECT event_type, round(count(*) * corr((v - f) ** 2, f) ** 2, 6) AS statistic FROM p GROUP BY 1")
_query("granger", lambda spark, d: ST.granger(_daily(spark, d).withColumn("w", F.sin("v")), "v", "w", _g, _o, 2))
_query("step_stationary", lambda spark, d: _r(ST.stationary(_daily(spark, d), "v", _g, _o, 1).select("event_type", "ts", "v"), "v"), _day + f", l AS (SELECT event_type, ts, v, lag(v) {_w} AS x FROM s), r AS (SELECT event_type, regr_slope(v - x, x) AS b, regr_count(v - x, x) AS n, regr_sxx(v - x, x) AS sxx, regr_syy(v - x, x) AS syy FROM l GROUP BY 1), a AS (SELECT bool_and(coalesce(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86, true)) AS every FROM r) SELECT event_type, ts, round(CASE WHEN every THEN v ELSE v - x END, 6) AS v FROM l CROSS JOIN a")
_query("step_stationary_diff", lambda spark, d: _r(ST.stationary(_daily(spark, d).withColumn("v", F.sum("v").over(Window.partitionBy("event_type").orderBy("ts"))), "v", _g, _o, 1).select("event_type", "ts", "v"), "v"), _day + f"SELECT event_type, ts, round(CASE WHEN lag(v) {_w} IS NOT NULL THEN v END, 6) AS v FROM s")
_past = lambda spark, d: load(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
_query("reconcile_bottom_up", lambda spark, d: ST.reconcile_bottom_up(_past(spark, d).groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias(".pred")).withColumn("step", F.lit(1)), ["o_orderpriority", "o_orderstatus"], ["step"]).select("o_orderpriority", "o_orderstatus", "step", F.round("`.pred`", 3).alias("pred")), "WITH b AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, 1 AS step, round(sum(p), 3) AS pred FROM b GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
_query("reconcile_top_down", lambda spark, d: ST.reconcile_top_down(_past(spark, d).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias(".pred")), _past(spark, d), "o_totalprice", ["o_orderpriority"], ["o_orderstatus"]).select("o_orderpriority", "o_orderstatus", F.round("`.pred`", 3).alias("pred")), "WITH p AS (SELECT o_orderpriority, avg(o_totalprice) AS p, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT o.o_orderpriority, o_orderstatus, round(max(p) * sum(o_totalprice) / max(t), 3) AS pred FROM orders o JOIN p USING (o_orderpriority) GROUP BY 1, 2")
