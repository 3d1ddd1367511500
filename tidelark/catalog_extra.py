"""Queries of series steps in recipes, metrics of many classes, periods, levels, acquisition functions, plot data and user functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _daily, _day, _fit_sql, _fitted, _g, _o, _query, _r, _w
from .functions import metrics as M
from .functions import multiclass as MC
from .operators import applied as A
from .operators import level_steps as LS
from .operators import periods as P
from .operators import series_steps as SS
from .operators import steps as S
from .plans import acquisition as Q
from .plans import plots, ranking
from .plans.recipe import Recipe
from .plans.selectors import all_numeric_predictors, has_role, where
from .sources.tables import load


def _baked(*steps, keep: list[str]):
    return lambda spark, d: _r(Recipe().add(*steps).prep(t := _daily(spark, d)).bake(t).select("event_type", "ts", *keep), *keep)


# series steps in recipes
_query("recipe_lag_rolling_normalize", _baked(SS.step_lag(["v"], [1], _g, _o), SS.step_rolling(["v_lag_1"], 3, _g, _o), S.step_na_omit(["v_lag_1_rolling_mean_3"]), S.step_normalize(["v_lag_1_rolling_mean_3"]), keep=["v_lag_1_rolling_mean_3"]),
       _day + f", l AS (SELECT event_type, ts, lag(v) {_w} AS l FROM s), r AS (SELECT event_type, ts, avg(l) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, row_number() {_w} AS n FROM l), k AS (SELECT * FROM r WHERE n >= 3 AND m IS NOT NULL) SELECT event_type, ts, round((m - (SELECT avg(m) FROM k)) / (SELECT stddev_pop(m) FROM k), 6) AS v_lag_1_rolling_mean_3 FROM k")
_query("recipe_lead_diff_pct", _baked(SS.step_lead(["v"], [2], _g, _o), SS.step_diff(["v"], _g, _o), SS.step_pct_change(["v"], _g, _o), keep=["v_lead_2", "v_diff_1", "v_pctdiff_1"]),
       _day + f"SELECT event_type, ts, round(lead(v, 2) {_w}, 6) AS v_lead_2, round(v - lag(v) {_w}, 6) AS v_diff_1, round(v / nullif(lag(v) {_w}, 0) - 1, 6) AS v_pctdiff_1 FROM s")
_query("recipe_expanding_window", _baked(SS.step_expanding(["v"], _g, _o, ("max", "sum")), SS.step_window(["v"], 3, _g, _o), keep=["v", "v_expanding_max", "v_expanding_sum"]),
       _day + "SELECT event_type, ts, round(avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v, round(max(v) OVER e, 6) AS v_expanding_max, round(sum(v) OVER e, 6) AS v_expanding_sum FROM s WINDOW e AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)")
_query("recipe_date", _baked(SS.step_date("ts", ("year", "quarter", "month", "wday")), keep=["ts_year", "ts_quarter", "ts_month", "ts_wday"]),
       _day + "SELECT event_type, ts, year(ts)::DOUBLE AS ts_year, quarter(ts)::DOUBLE AS ts_quarter, month(ts)::DOUBLE AS ts_month, (dayofweek(ts) + 1)::DOUBLE AS ts_wday FROM s")
_query("recipe_permutation_entropy", _baked(SS.step_permutation_entropy("v", _g, _o), keep=["v_entropy"]),
       _day + f", x AS (SELECT event_type, lag(v, 2) {_w} AS a, lag(v) {_w} AS b, v AS c FROM s), p AS (SELECT event_type, (a > b)::INT || (a > c)::INT || (b > c)::INT AS p, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY 1, 2), h AS (SELECT event_type, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(6) AS h FROM p GROUP BY 1) SELECT event_type, ts, round(h, 6) AS v_entropy FROM s JOIN h USING (event_type)")
_query("recipe_roles", lambda spark, d: _r(Recipe().update_role("l_tax", role="outcome").update_role("l_orderkey", "l_linenumber", role="id").add(S.step_center(all_numeric_predictors())).prep(t := load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")).bake(t), "l_quantity", "l_discount", "l_tax"),
       "SELECT l_orderkey, l_linenumber, round(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 6) AS l_quantity, round(l_discount - (SELECT avg(l_discount) FROM lineitem), 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem")
_query("recipe_where_selector", lambda spark, d: _r(Recipe().update_role("o_custkey", role="id").add(S.step_rm(has_role("id")), S.step_sqrt(where(lambda f: f.dataType.typeName() == "double"))).prep(t := load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).bake(t), "o_totalprice"),
       "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS o_totalprice FROM orders")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """Three classes, a guess and chances of each."""
    t = load(spark, d, "lineitem").where("l_returnflag IS NOT NULL")
    a, n, r = F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, F.lit(0.05)
    guess = F.when(F.col("l_quantity") % 3 == 0, "A").when(F.col("l_linenumber") % 2 == 0, "N").otherwise(F.col("l_returnflag"))
    return t.select(F.col("l_returnflag").alias("y"), guess.alias("p"), (a / (a + n + r)).alias("pa"), (n / (a + n + r)).alias("pn"), (r / (a + n + r)).alias("pr"))


_class_sql = "WITH x AS (SELECT l_returnflag AS y, CASE WHEN l_quantity % 3 = 0 THEN 'A' WHEN l_linenumber % 2 = 0 THEN 'N' ELSE l_returnflag END AS p, l_discount + 0.01 AS a, l_tax + 0.01 AS n, 0.05 AS r FROM lineitem), z AS (SELECT y, p, a / (a + n + r) AS pa, n / (a + n + r) AS pn, r / (a + n + r) AS pr FROM x)"
_each_sql = _class_sql + ", k AS (SELECT c, (SELECT count(*) FROM z WHERE y = c)::DOUBLE AS t, (SELECT count(*) FROM z WHERE p = c)::DOUBLE AS e, (SELECT count(*) FROM z WHERE y = c AND p = c)::DOUBLE AS tp, (SELECT count(*) FROM z)::DOUBLE AS n FROM (VALUES ('A'), ('N'), ('R')) v(c))"
_parts = {"precision": ("tp", "e"), "ppv": ("tp", "e"), "recall": ("tp", "t"), "sens": ("tp", "t"), "spec": ("n - t - e + tp", "n - t"), "npv": ("n - t - e + tp", "n - e"), "f_meas": ("2 * tp", "t + e"), "detection_prevalence": ("e", "n")}
for _est, _avg in (("macro", "avg(({a}) / ({b}))"), ("macro_weighted", "sum(({a}) / ({b}) * t) / sum(t)"), ("micro", "sum({a}) / sum({b})")):
    _e = {k: _avg.format(a=a, b=b) for k, (a, b) in _parts.items()}
    _e |= {"j_index": f"{_e['sens']} + {_e['spec']} - 1", "bal_accuracy": f"({_e['sens']} + {_e['spec']}) / 2", "accuracy": "sum(tp) / max(n)", "kap": "(sum(tp) / max(n) - sum(t * e) / max(n * n)) / (1 - sum(t * e) / max(n * n))", "mcc": "(max(n) * sum(tp) - sum(t * e)) / sqrt((max(n * n) - sum(e * e)) * (max(n * n) - sum(t * t)))"}
    _query(f"class_metrics_{_est}", lambda spark, d, est=_est: _r(MC.multiclass_metrics(_classes(spark, d), "y", "p", est), "value"), _each_sql + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({q}, 6) AS value FROM k" for k, q in _e.items()))
_query("conf_mat", lambda spark, d: MC.conf_mat(_classes(spark, d), "y", "p"), _class_sql + " SELECT y AS truth, p AS estimate, count(*) AS n FROM z GROUP BY 1, 2")
_chances = {"A": "pa", "N": "pn", "R": "pr"}
_query("roc_auc_classes", lambda spark, d: _r(MC.roc_areas(_classes(spark, d).withColumns({c: F.round(c, 9) for c in _chances.values()}), "y", _chances), "value"),
       _class_sql + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, round({p}, 9) AS s, (y = '{c}')::INT AS h FROM z" for c, p in _chances.items()) + "), g AS (SELECT c, s, sum(h) AS p, count(*) - sum(h) AS n FROM l GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS (SELECT c, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS a, sum(p) AS p FROM b GROUP BY 1) SELECT 'roc_aunu' AS metric, round(avg(a), 6) AS value FROM a UNION ALL SELECT 'roc_aunp', round(sum(a * p) / sum(p), 6) FROM a")
_query("probability_scores", lambda spark, d: _r(MC.probability_scores(_classes(spark, d), "y", _chances, {("A", "R"): 2.0}), "value"),
       _class_sql + ", q AS (SELECT *, (y = 'A')::INT AS a, (y = 'N')::INT AS n, (y = 'R')::INT AS r FROM z), m AS (SELECT avg(-ln(a * pa + n * pn + r * pr)) AS mn_log_loss, avg((pa - a) ** 2 + (pn - n) ** 2 + (pr - r) ** 2) / 2 AS brier_class, avg(a * (pn + 2 * pr) + n * (pa + pr) + r * (pa + pn)) AS classification_cost, avg((pa - a) ** 2 + (pa + pn - a - n) ** 2) / 2 AS ranked_prob_score FROM q) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON * INTO NAME metric VALUE value)")

# periods
_orders = lambda spark, d: load(spark, d, "orders").select("o_orderkey", "o_orderdate")
_query("split_by_ranges", lambda spark, d: P.split_by_ranges(_orders(spark, d), "o_orderdate", ("start", "start + 2 years"), ("1998-01-01", "end - 3 months")).drop("o_orderdate"),
       "SELECT o_orderkey, CASE WHEN o_orderdate <= a + INTERVAL 730 DAY THEN 'train' ELSE 'test' END AS split FROM orders, (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders) WHERE o_orderdate <= a + INTERVAL 730 DAY OR o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= b - INTERVAL 90 DAY")
_query("split_training", lambda spark, d: P.training(P.split_by_ranges(_orders(spark, d), "o_orderdate", ("start", "1996-12-31"), ("1997-01-01", "end"))).drop("o_orderdate"), "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-12-31'")
_query("split_testing", lambda spark, d: P.testing(P.split_by_ranges(_orders(spark, d), "o_orderdate", ("start", "1996-12-31"), ("1997-01-01", "end"))).drop("o_orderdate"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
for _name, _cum in (("period_folds_expanding", True), ("period_folds_rolling", False)):
    _start = "0" if _cum else "k * 365 * 86400"
    _query(_name, lambda spark, d, cum=_cum: P.period_folds(_orders(spark, d), "o_orderdate", "2 years", "6 months", "185 days", "1 week", cum).drop("o_orderdate"),
           f"WITH t AS (SELECT o_orderkey, epoch(o_orderdate) - (SELECT epoch(min(o_orderdate)) FROM orders) AS s FROM orders), f AS (SELECT k::INT AS k FROM generate_series(0, 50) AS g(k) WHERE (730 + 7 + 180 + k * 365) * 86400 <= (SELECT max(s) FROM t)), j AS (SELECT o_orderkey, k + 1 AS fold, CASE WHEN s >= {_start} AND s < (730 + 365 * k) * 86400 THEN 'train' WHEN s >= (737 + 365 * k) * 86400 AND s < (917 + 365 * k) * 86400 THEN 'test' END AS role FROM t CROSS JOIN f) SELECT * FROM j WHERE role IS NOT NULL")
_query("fold_analysis", lambda spark, d: P.analysis(P.period_folds(_orders(spark, d), "o_orderdate", "2 years", "1 year"), 2).drop("o_orderdate"), "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) FROM orders) + INTERVAL 1095 DAY")
_query("fold_assessment", lambda spark, d: P.assessment(P.period_folds(_orders(spark, d), "o_orderdate", "2 years", "1 year"), 1).drop("o_orderdate"), "SELECT o_orderkey FROM orders, (SELECT min(o_orderdate) AS a FROM orders) WHERE o_orderdate >= a + INTERVAL 730 DAY AND o_orderdate < a + INTERVAL 1095 DAY")

# levels
_parts_of = lambda spark, d: load(spark, d, "part").select("p_partkey", "p_type", "p_brand")
_query("step_string2factor", lambda spark, d: Recipe().add(LS.step_string2factor(["p_brand"], ["Brand#11", "Brand#12"]), LS.step_factor2string(["p_type"]), LS.step_unorder(["p_type"]), LS.check_class()).prep(t := _parts_of(spark, d)).bake(t), "SELECT p_partkey, p_type, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_brand END AS p_brand FROM part")
_query("step_dummy_multi_choice", lambda spark, d: (lambda t: Recipe().add(LS.step_dummy_multi_choice(["first", "second"], "has")).prep(t).bake(t))(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("first"), F.col("l_linestatus").alias("second"))).select("l_orderkey", "l_linenumber", "has_A", "has_N", "has_O"),
       "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS \"has_A\", (l_returnflag = 'N')::INT AS \"has_N\", (l_linestatus = 'O')::INT AS \"has_O\" FROM lineitem")
_auc_cols = ["l_quantity", "l_discount", "l_tax"]
_query("filter_roc_auc", lambda spark, d: _r(LS.roc_auc_of(load(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "A").cast("int")), "y", _auc_cols), "auc"),
       "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS s, (l_returnflag = 'A')::INT AS h FROM lineitem" for c in _auc_cols) + "), g AS (SELECT c, s, sum(h) AS p, count(*) - sum(h) AS n FROM l GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS (SELECT c, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS a FROM b GROUP BY 1) SELECT c AS column_name, round(greatest(a, 1 - a), 6) AS auc FROM a")

# selection and search
_long = lambda spark, d, names: M.metric_set(_fitted(spark, d), "v", "fitted", names, _g).withColumn("fold", F.lit(1))
_named = {"huber_loss": "avg(CASE WHEN abs(v - f) <= 1 THEN (v - f) ** 2 / 2 ELSE abs(v - f) - 0.5 END)", "mpe": "abs(avg((v - f) / v))"}
_query("rank_results_huber", lambda spark, d: ranking.rank_results(_long(spark, d, ["huber_loss"]), _g, "huber_loss").select("event_type", "rank"), _fit_sql + f"SELECT event_type, row_number() OVER (ORDER BY {_named['huber_loss']}, event_type)::INT AS rank FROM p GROUP BY 1")
_query("select_by_pct_loss", lambda spark, d: ranking.select_by_pct_loss(_long(spark, d, ["rmse"]), _g, "rmse", ["event_type"], 1000.0).select("event_type"), _fit_sql + ", m AS (SELECT event_type, sqrt(avg((v - f) ** 2)) AS m FROM p GROUP BY 1) SELECT min(event_type) AS event_type FROM m WHERE (m - (SELECT min(m) FROM m)) / (SELECT min(m) FROM m) * 100 <= 1000")
_cand = lambda spark, d: load(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("m"), ((F.col("s_suppkey") % 7) / 2.0).alias("sd"))
_erf_sql = "(sign(z) * (1 - ((((1.061405429 / (1 + 0.3275911 * abs(z)) - 1.453152027) / (1 + 0.3275911 * abs(z)) + 1.421413741) / (1 + 0.3275911 * abs(z)) - 0.284496736) / (1 + 0.3275911 * abs(z)) + 0.254829592) / (1 + 0.3275911 * abs(z)) * exp(-z * z)))"
_query("acquisition", lambda spark, d: _r(_cand(spark, d).select("s_suppkey", Q.prob_improve(F.col("m"), F.col("sd"), 3.0).alias("prob_improve"), Q.exp_improve(F.col("m"), F.col("sd"), 3.0).alias("exp_improve"), Q.conf_bound(F.col("m"), F.col("sd")).alias("conf_bound")), "prob_improve", "exp_improve", "conf_bound"),
       f"WITH c AS (SELECT s_suppkey, s_acctbal / 1000 AS m, (s_suppkey % 7) / 2.0 AS sd FROM supplier), z AS (SELECT *, (3 - m) / nullif(sd, 0) / sqrt(2) AS z FROM c), p AS (SELECT *, (1 + {_erf_sql}) / 2 AS p FROM z) SELECT s_suppkey, round(CASE WHEN sd > 0 THEN p ELSE (3 > m)::INT END, 6) AS prob_improve, round(CASE WHEN sd > 0 THEN (3 - m) * p + sd * exp(-z * z) / sqrt(2 * pi()) ELSE greatest(3 - m, 0) END, 6) AS exp_improve, round(-(m - 0.1 * sd), 6) AS conf_bound FROM p")
_decay = Q.expo_decay(0.5, 0.1, 0.25, 3)
_query("expo_decay", lambda spark, d: _r(load(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(_decay(i)) for i in range(25)]), F.col("n_nationkey") + 1).alias("value")), "value"), "SELECT n_nationkey, round(CASE WHEN n_nationkey <= 3 THEN 0.5 ELSE 0.4 * exp(-0.25 * (n_nationkey - 3)) + 0.1 END, 6) AS value FROM nation")

# plot data
_query("plot_forecast", lambda spark, d: _r(plots.plot_forecast(_daily(spark, d), _fitted(spark, d), "ts", "v", "fitted", _g), "value"), _fit_sql + "SELECT event_type, ts, 'actual' AS series, round(v, 6) AS value FROM p UNION ALL SELECT event_type, ts, 'forecast', round(f, 6) FROM p")
_query("plot_residuals", lambda spark, d: _r(plots.plot_residuals(_fitted(spark, d), "v", "fitted", 10), "middle"), _fit_sql + ", e AS (SELECT v - f AS e FROM p WHERE v - f IS NOT NULL), k AS (SELECT min(e) AS lo, max(e) AS hi FROM e) SELECT least(floor((e - lo) / ((hi - lo) / 10)) + 1, 10)::INT AS bin, round(any_value(lo) + (bin - 0.5) * any_value((hi - lo) / 10), 6) AS middle, count(*) AS n FROM e, k GROUP BY 1")
_query("plot_model_comparison", lambda spark, d: _r(plots.plot_model_comparison(_long(spark, d, ["rmse", "mae"]), _g, ["rmse", "mae"]), "mean", "relative").drop("std_err"),
       _fit_sql + ", m AS (SELECT event_type, 'rmse' AS metric, sqrt(avg((v - f) ** 2)) AS m FROM p GROUP BY 1 UNION ALL SELECT event_type, 'mae', avg(abs(v - f)) FROM p GROUP BY 1) SELECT event_type, metric, round(m, 6) AS mean, rank() OVER (PARTITION BY metric ORDER BY m)::INT AS rank, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w), 6) AS relative FROM m WINDOW w AS (PARTITION BY metric)")
_query("plot_tune_results", lambda spark, d: _r(plots.plot_tune_results(load(spark, d, "orders").select(F.lit("rmse").alias("metric"), (F.col("o_orderkey") % 3).alias("penalty"), (F.col("o_orderkey") % 2).alias("mixture"), F.col("o_totalprice").alias("value")), ["penalty", "mixture"], "rmse"), "value", "mean", "std_err").withColumns({c: F.round(c, 4) for c in ("mean", "std_err")}),
       " UNION ALL ".join(f"SELECT '{p}' AS parameter, (o_orderkey % {k})::DOUBLE AS value, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS std_err FROM orders GROUP BY 2" for p, k in (("penalty", 3), ("mixture", 2))))

# user functions
_query("rolling_apply", lambda spark, d: _r(A.rolling_apply(_daily(spark, d), "v", 4, lambda x: float(np.max(x) - np.min(x)), _g, _o).select("event_type", "ts", "v_rolling_apply_4"), "v_rolling_apply_4"), _day + "SELECT event_type, ts, CASE WHEN count(*) OVER w >= 4 THEN round(max(v) OVER w - min(v) OVER w, 6) END AS v_rolling_apply_4 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 3 PRECEDING)")
_query("expanding_apply", lambda spark, d: _r(A.expanding_apply(_daily(spark, d), "v", lambda x: float(np.sum(x)), _g, _o).select("event_type", "ts", "v_expanding_apply"), "v_expanding_apply"), _day + "SELECT event_type, ts, round(sum(v) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS v_expanding_apply FROM s")
_query("hilbert_real", lambda spark, d: _r(A.hilbert(_daily(spark, d), "v", _g, _o).select("event_type", "ts", "v_hilbert_real"), "v_hilbert_real"), _day + "SELECT event_type, ts, round(v, 6) AS v_hilbert_real FROM s")
_cot = f"CASE WHEN n % 2 = 0 THEN CASE WHEN (a.r - b.r) % 2 <> 0 THEN 2.0 / n / tan({math.pi!r} * (a.r - b.r) / n) ELSE 0 END ELSE CASE WHEN a.r <> b.r THEN (1 / tan({math.pi!r} * (a.r - b.r) / n) - (CASE WHEN (a.r - b.r) % 2 = 0 THEN 1 ELSE -1 END) / sin({math.pi!r} * (a.r - b.r) / n)) / n ELSE 0 END END"
_query("hilbert_imag", lambda spark, d: _r(A.hilbert(_daily(spark, d), "v", _g, _o).select("event_type", "ts", "v_hilbert_imag"), "v_hilbert_imag"), _day + f", x AS (SELECT *, row_number() {_w} AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s) SELECT a.event_type, a.ts, round(sum(b.v * {_cot.replace('CASE WHEN n ', 'CASE WHEN a.n ').replace('/ n', '/ a.n')}), 6) AS v_hilbert_imag FROM x a JOIN x b ON a.event_type = b.event_type GROUP BY 1, 2")
_query("weekday_sequence", lambda spark, d: A.weekday_sequence(spark, "2024-12-20", "2025-01-10", ["2024-12-25", "2025-01-01"]).select(F.col("date").cast("string").alias("date")), "SELECT d::DATE::VARCHAR AS date FROM generate_series(DATE '2024-12-20', DATE '2025-01-10', INTERVAL 1 DAY) AS g(d) WHERE isodow(d) <= 5 AND d NOT IN (DATE '2024-12-25', DATE '2025-01-01')")
_query("drop_zero_variance", lambda spark, d: A.drop_zero_variance(load(spark, d, "region").withColumn("same", F.lit(3))), "SELECT r_regionkey, r_name FROM region")
