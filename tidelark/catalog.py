"""Queries over the driver's tables and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .operators import models, resample
from .operators import steps as S
from .operators import timeseries as T
from .plans.recipe import Recipe
from .sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def _r(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded to 6 digits, as the engines' last digits differ."""
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), 6) for c in cols})


LINE = ["l_quantity", "l_extendedprice"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _line(*steps, keep=LINE):
    return lambda spark, d: _r(Recipe().add(*steps).prep(t := load(spark, d, "lineitem").select(*KEY, *LINE, "l_discount", "l_tax")).bake(t).select(*KEY, *keep), *keep)


def _line_sql(exprs: list[str], stats: str = "") -> str:
    cte = f"WITH s AS (SELECT {stats} FROM lineitem) " if stats else ""
    return f"{cte}SELECT {', '.join(KEY)}, {', '.join(exprs)} FROM lineitem" + (" CROSS JOIN s" if stats else "")


_both = lambda f: [f.format(c=c) for c in LINE]
_stats = lambda f: ", ".join(f.format(c=c) for c in LINE)
_query("step_normalize_zscore", _line(S.step_normalize(LINE)), _line_sql(_both("round(({c} - m_{c}) / d_{c}, 6) AS {c}"), _stats("avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}")))
_query("step_normalize_minmax", _line(S.step_normalize(LINE, "minmax")), _line_sql(_both("round(({c} - m_{c}) / (d_{c} - m_{c}), 6) AS {c}"), _stats("min({c}) AS m_{c}, max({c}) AS d_{c}")))
_query("step_center", _line(S.step_center(LINE)), _line_sql(_both("round({c} - m_{c}, 6) AS {c}"), _stats("avg({c}) AS m_{c}")))
_query("step_scale", _line(S.step_scale(LINE)), _line_sql(_both("round({c} / d_{c}, 6) AS {c}"), _stats("stddev_samp({c}) AS d_{c}")))
_query("step_range", _line(S.step_range(LINE, -1.0, 1.0)), _line_sql(_both("round(({c} - m_{c}) / (d_{c} - m_{c}) * 2 - 1, 6) AS {c}"), _stats("min({c}) AS m_{c}, max({c}) AS d_{c}")))
_query("step_log", _line(S.step_log(LINE)), _line_sql(_both("round(ln({c}), 6) AS {c}")))
_query("step_sqrt", _line(S.step_sqrt(LINE)), _line_sql(_both("round(sqrt({c}), 6) AS {c}")))
_query("step_inverse", _line(S.step_inverse(LINE, 1.0)), _line_sql(_both("round(1 / ({c} + 1), 6) AS {c}")))
_query("step_poly", _line(S.step_poly(["l_quantity"], 3), keep=["l_quantity_poly_2", "l_quantity_poly_3"]), _line_sql(["round(pow(l_quantity, 2), 6) AS l_quantity_poly_2", "round(pow(l_quantity, 3), 6) AS l_quantity_poly_3"]))
_query("step_interact", _line(S.step_interact(["l_quantity", "l_discount", "l_tax"]), keep=["l_quantity_x_l_discount", "l_quantity_x_l_tax", "l_discount_x_l_tax"]), _line_sql([f"round({a} * {b}, 6) AS {a}_x_{b}" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))]))
_query("step_ratio", _line(S.step_ratio([("l_extendedprice", "l_quantity")]), keep=["l_extendedprice_per_l_quantity"]), _line_sql(["round(l_extendedprice / (l_quantity + 1e-10), 6) AS l_extendedprice_per_l_quantity"]))
_query("step_mutate", _line(S.step_mutate(net=lambda df: F.col("l_extendedprice") * (1 - F.col("l_discount")), gross=lambda df: F.col("net") * (1 + F.col("l_tax"))), keep=["net", "gross"]), _line_sql(["round(l_extendedprice * (1 - l_discount), 6) AS net", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross"]))
_query("step_winsorizer", _line(S.step_winsorizer(LINE, 0.5)), _line_sql(_both("round(greatest(least({c}, b_{c} + 0.5 * (b_{c} - a_{c})), a_{c} - 0.5 * (b_{c} - a_{c})), 6) AS {c}"), _stats("quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}")))
_query("step_outlier_trimmer", _line(S.step_outlier_trimmer(LINE, 0.5)), _line_sql(_both("round({c}, 6) AS {c}"), _stats("quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}")) + " WHERE " + " AND ".join(_both("{c} BETWEEN a_{c} - 0.5 * (b_{c} - a_{c}) AND b_{c} + 0.5 * (b_{c} - a_{c})")))
_query("step_select", _line(S.step_select([*KEY, "l_tax"]), keep=["l_tax"]), _line_sql(["round(l_tax, 6) AS l_tax"]))
_query("step_rm", _line(S.step_rm(["l_tax"]), keep=["l_quantity"]), _line_sql(["round(l_quantity, 6) AS l_quantity"]))


def _kept(*steps):
    """One row a column: whether it stays."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumns({"twice": F.col("l_quantity") * 2, "flat": F.lit(1.0), "gaps": F.when(F.col("l_quantity") > 45, F.col("l_tax"))})
        out = Recipe().add(*steps).prep(t).bake(t)
        return spark.createDataFrame([(c, c in out.columns) for c in t.columns], "column_name string, kept boolean")

    return build


_names = "(VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('twice'), ('flat'), ('gaps')) AS t(column_name)"
_query("step_zv", _kept(S.step_zv()), f"SELECT column_name, column_name <> 'flat' OR (SELECT count(*) = 0 FROM lineitem) AS kept FROM {_names}")
_query("step_filter_missing", _kept(S.step_filter_missing(threshold=0.5)), f"SELECT column_name, column_name <> 'gaps' OR (SELECT avg((l_quantity <= 45)::INT) <= 0.5 FROM lineitem) AS kept FROM {_names}")
_query("step_select_corr", _kept(S.step_zv(), S.step_filter_missing(), S.step_select_corr()), f"SELECT column_name, column_name NOT IN ('twice', 'flat', 'gaps') AND (column_name <> 'l_extendedprice' OR (SELECT abs(corr(l_quantity, l_extendedprice)) <= 0.9 FROM lineitem)) AS kept FROM {_names}")
_query("step_nzv", _kept(S.step_nzv(["l_quantity", "l_tax", "flat"])), f"SELECT column_name, column_name <> 'flat' AS kept FROM {_names}")


def _orders(*steps, keep):
    return lambda spark, d: Recipe().add(*steps).prep(t := load(spark, d, "orders")).bake(t).select("o_orderkey", *keep)


_prio = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_query("step_dummy", lambda spark, d: Recipe().add(S.step_dummy(["o_orderstatus"])).prep(t := load(spark, d, "orders").select("o_orderkey", "o_orderstatus")).bake(t), "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
_query("step_integer", _orders(S.step_integer(["o_orderpriority"]), keep=["o_orderpriority"]), "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority FROM orders")
_query("step_other", lambda spark, d: Recipe().add(S.step_other(["p_brand"], 0.04)).prep(t := load(spark, d, "part").select("p_partkey", "p_brand")).bake(t), "WITH k AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(*) FROM part)) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'other' END AS p_brand FROM part")
_query("step_novel", lambda spark, d: Recipe().add(S.step_novel(["p_type"])).prep((t := load(spark, d, "part").select("p_partkey", "p_type")).where("p_partkey <= 8")).bake(t), "SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_partkey <= 8) THEN p_type ELSE 'new' END AS p_type FROM part")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("event_id") % 7 == 0
    return load(spark, d, "events").select("event_id", F.when(~gap, F.col("value")).alias("value"), F.when(~gap, F.col("event_type")).alias("event_type"))


_gaps_sql = "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events) "


def _events(*steps, keep, rounded=()):
    return lambda spark, d: _r(Recipe().add(*steps).prep(t := _gaps(spark, d)).bake(t).select("event_id", *keep), *rounded)


_query("step_impute_mean", _events(S.step_impute_mean(["value"]), keep=["value"], rounded=["value"]), _gaps_sql + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value FROM g")
_query("step_impute_median", _events(S.step_impute_median(["value"]), keep=["value"], rounded=["value"]), _gaps_sql + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM g)), 6) AS value FROM g")
_query("step_impute_mode", _events(S.step_impute_mode(["event_type"]), keep=["event_type"]), _gaps_sql + "SELECT event_id, coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g")
_query("step_unknown", _events(S.step_unknown(["event_type"]), keep=["event_type"]), _gaps_sql + "SELECT event_id, coalesce(event_type, '_unknown_') AS event_type FROM g")
_query("step_indicate_na", _events(S.step_indicate_na(["value", "event_id"]), keep=["na_ind_value"]), _gaps_sql + "SELECT event_id, (value IS NULL)::INT AS na_ind_value FROM g")
_query("step_na_omit", _events(S.step_na_omit(["value"]), keep=["value"], rounded=["value"]), _gaps_sql + "SELECT event_id, round(value, 6) AS value FROM g WHERE value IS NOT NULL")
_price = "o_totalprice"
_query("step_discretize_quantile", _orders(S.step_discretize([_price], 4), keep=[_price]), f"WITH s AS (SELECT quantile_cont({_price}, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT o_orderkey, CASE WHEN {_price} <= q[1] THEN 'bin_1' WHEN {_price} <= q[2] THEN 'bin_2' WHEN {_price} <= q[3] THEN 'bin_3' ELSE 'bin_4' END AS {_price} FROM orders CROSS JOIN s")
_query("step_discretize_width", _orders(S.step_discretize([_price], 4, "width"), keep=[_price]), f"WITH s AS (SELECT min({_price}) AS a, max({_price}) AS b FROM orders) SELECT o_orderkey, CASE WHEN {_price} <= a + (b - a) * 1 / 4 THEN 'bin_1' WHEN {_price} <= a + (b - a) * 2 / 4 THEN 'bin_2' WHEN {_price} <= a + (b - a) * 3 / 4 THEN 'bin_3' ELSE 'bin_4' END AS {_price} FROM orders CROSS JOIN s")
_query("step_cut", _orders(S.step_cut([_price], [0, 100000, 300000]), keep=[_price]), f"SELECT o_orderkey, CASE WHEN {_price} BETWEEN 0 AND 100000 THEN 'bin_1' WHEN {_price} > 100000 AND {_price} <= 300000 THEN 'bin_2' END AS {_price} FROM orders")

# daily series of each event type
_day = "WITH s AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS v FROM events GROUP BY 1, 2) "


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return T.summarize_by_time(load(spark, d, "events"), "ts", "day", ["event_type"], v=F.sum("value"))


def _series(f, keep):
    return lambda spark, d: _r(f(_daily(spark, d)).select("event_type", "ts", *keep), *keep)


_g, _o, _w = ["event_type"], ["ts"], "OVER (PARTITION BY event_type ORDER BY ts)"
_query("summarize_by_time", _series(lambda s: s, ["v"]), _day + "SELECT event_type, ts, round(v, 6) AS v FROM s")
_query("step_lag", _series(lambda s: T.lag(s, ["v"], [1, 3], _g, _o), ["v_lag_1", "v_lag_3"]), _day + f"SELECT event_type, ts, round(lag(v, 1) {_w}, 6) AS v_lag_1, round(lag(v, 3) {_w}, 6) AS v_lag_3 FROM s")
_query("step_lead", _series(lambda s: T.lead(s, ["v"], [2], _g, _o), ["v_lead_2"]), _day + f"SELECT event_type, ts, round(lead(v, 2) {_w}, 6) AS v_lead_2 FROM s")
_query("step_diff", _series(lambda s: T.diff(s, ["v"], _g, _o, 2, 2), ["v_diff_2_order_2"]), _day + f"SELECT event_type, ts, round(v - 2 * lag(v, 2) {_w} + lag(v, 4) {_w}, 6) AS v_diff_2_order_2 FROM s")
_query("step_pct_change", _series(lambda s: T.pct_change(s, ["v"], _g, _o), ["v_pctdiff_1"]), _day + f"SELECT event_type, ts, round(v / nullif(lag(v) {_w}, 0) - 1, 6) AS v_pctdiff_1 FROM s")
_roll = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_query("step_rolling", _series(lambda s: T.rolling(s, ["v"], 5, _g, _o, ("mean", "min", "max", "sum")), [f"v_rolling_{f}_5" for f in ("mean", "min", "max", "sum")]), _day + "SELECT event_type, ts, " + ", ".join(f"CASE WHEN row_number() {_w} >= 5 THEN round({q}(v) {_roll}, 6) END AS v_rolling_{f}_5" for f, q in (("mean", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"))) + " FROM s")
_exp = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_query("step_expanding", _series(lambda s: T.expanding(s, ["v"], _g, _o), [f"v_expanding_{f}" for f in ("mean", "min", "max", "sum")]), _day + "SELECT event_type, ts, " + ", ".join(f"round({q}(v) {_exp}, 6) AS v_expanding_{f}" for f, q in (("mean", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"))) + " FROM s")
_query("augment_drawdown", _series(lambda s: T.drawdown(s, "v", _g, _o), ["v_peak", "v_drawdown"]), _day + f"SELECT event_type, ts, round(max(v) {_exp}, 6) AS v_peak, round(v - max(v) {_exp}, 6) AS v_drawdown FROM s")
_query("step_ewm", _series(lambda s: T.ewm_mean(s, "v", 0.3, _g, _o), ["v_ewm_mean"]), "WITH RECURSIVE s AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS n FROM events GROUP BY event_type, date_trunc('day', ts)), r AS (SELECT event_type, ts, n, v AS m FROM s WHERE n = 1 UNION ALL SELECT s.event_type, s.ts, s.n, 0.3 * s.v + 0.7 * r.m FROM r JOIN s ON s.event_type = r.event_type AND s.n = r.n + 1) SELECT event_type, ts, round(m, 6) AS v_ewm_mean FROM r")
_sig = ["year", "quarter", "month", "day", "yday", "week", "wday", "half"]
_query("timeseries_signature", lambda spark, d: T.signature(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", *[f"o_orderdate_{k}" for k in _sig]), "SELECT o_orderkey, " + ", ".join(f"({e})::INT AS o_orderdate_{k}" for k, e in zip(_sig, ("year(o_orderdate)", "quarter(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)", "dayofyear(o_orderdate)", "weekofyear(o_orderdate)", "dayofweek(o_orderdate) + 1", "CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END"), strict=True)) + " FROM orders")
def _fourier(spark: SparkSession, d: str) -> DataFrame:
    return _r(T.fourier(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 365, 1).drop("o_orderdate"), "o_orderdate_sin_1_365", "o_orderdate_cos_1_365")


_query("step_fourier", _fourier, "SELECT o_orderkey, round(sin(2 * pi() * date_diff('day', DATE '1970-01-01', o_orderdate::DATE) / 365), 6) AS o_orderdate_sin_1_365, round(cos(2 * pi() * date_diff('day', DATE '1970-01-01', o_orderdate::DATE) / 365), 6) AS o_orderdate_cos_1_365 FROM orders")
_query("initial_time_split", lambda spark, d: resample.initial_time_split(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.75, 5).select("o_orderkey", "split"), "SELECT o_orderkey, CASE WHEN r <= floor(n * 0.75) THEN 'train' WHEN r <= floor(n * 0.75) + 5 THEN 'none' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)")
_query("vfold_cv", lambda spark, d: resample.vfold_cv(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10, 42), "SELECT o_orderkey, (((o_orderkey * 7919 + 42) % 1000003) % 10 + 1)::INT AS fold FROM orders")


def _nested(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return _r(models.linear_reg(t, "l_extendedprice", ["l_quantity"], ["l_returnflag"]), "coefficient")


_query("linear_reg_nested", lambda spark, d: _nested(spark, d).withColumn("coefficient", F.round("coefficient", 3)), "SELECT l_returnflag, 'Intercept' AS variable, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem GROUP BY 1")
_query("null_model_mean", lambda spark, d: _r(models.null_model(_daily(spark, d), "v", _g), ".pred"), _day + "SELECT event_type, round(avg(v), 6) AS \".pred\" FROM s GROUP BY 1")
_query("null_model_median", lambda spark, d: _r(models.null_model(_daily(spark, d), "v", _g, "median"), ".pred"), _day + "SELECT event_type, round(median(v), 6) AS \".pred\" FROM s GROUP BY 1")
_query("null_model_last", lambda spark, d: _r(models.null_model(_daily(spark, d), "v", _g, "last", ["ts"]), ".pred"), _day + "SELECT event_type, round(arg_max(v, ts), 6) AS \".pred\" FROM s GROUP BY 1")
_query("naive_reg", _series(lambda s: models.naive_reg(s, "v", _g, _o), ["fitted"]), _day + f"SELECT event_type, ts, round(coalesce(lag(v) {_w}, v), 6) AS fitted FROM s")
_query("naive_reg_seasonal", _series(lambda s: models.naive_reg(s, "v", _g, _o, "seasonal_naive", 7), ["fitted"]), _day + f"SELECT event_type, ts, round(coalesce(lag(v, 7) {_w}, v), 6) AS fitted FROM s")
_query("naive_reg_window", _series(lambda s: models.naive_reg(s, "v", _g, _o, "window", window=7), ["fitted"]), _day + "SELECT event_type, ts, round(coalesce(avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), v), 6) AS fitted FROM s")
_query("manual_reg", lambda spark, d: _r(models.manual_reg(load(spark, d, "lineitem"), {"l_quantity": 2.0, "l_tax": -1.5}, 10.0).select(*KEY, "`.pred`"), ".pred"), f"SELECT {', '.join(KEY)}, round(10 + 2 * l_quantity - 1.5 * l_tax, 6) AS \".pred\" FROM lineitem")


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return models.naive_reg(_daily(spark, d), "v", _g, _o).withColumn("e", F.col("v") - F.col("fitted"))


_fit_sql = _day + f", p AS (SELECT *, coalesce(lag(v) {_w}, v) AS f FROM s) "
_formulas = {"rmse": "sqrt(avg((v - f) ** 2))", "mae": "avg(abs(v - f))", "mape": "100 * avg(abs((v - f) / nullif(v, 0)))", "smape": "100 * avg(abs(v - f) / nullif((abs(v) + abs(f)) / 2, 0))", "mpe": "100 * avg((v - f) / nullif(v, 0))", "msd": "avg(v - f)", "rsq": "corr(v, f) ** 2", "r_squared": "1 - sum((v - f) ** 2) / (var_pop(v) * count(v))", "ccc": "2 * covar_pop(v, f) / (var_pop(v) + var_pop(f) + (avg(v) - avg(f)) ** 2)"}
_query("metric_set", lambda spark, d: _r(M.metric_set(_fitted(spark, d), "v", "fitted", list(_formulas), _g), "value"), _fit_sql + " UNION ALL ".join(f"SELECT event_type, '{k}' AS metric, round({q}, 6) AS value FROM p GROUP BY 1" for k, q in _formulas.items()))
_query("durbin_watson", lambda spark, d: _r(M.durbin_watson(_fitted(spark, d), "e", _g, _o), "value"), _fit_sql + f", q AS (SELECT event_type, v - f AS e, (v - f) - lag(v - f) {_w} AS d FROM p) SELECT event_type, round(sum(d ** 2) / sum(e ** 2), 6) AS value FROM q GROUP BY 1")
_query("confusion_metrics", lambda spark, d: _r(M.confusion_metrics(load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("p")), "doc_id"), "quality", "p"), "value"), "WITH s AS (SELECT quality AS y, (n_chars > 1000)::INT AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT sum((y = 1 AND p = 1)::INT) AS tp, sum((y = 0 AND p = 1)::INT) AS fp, sum((y = 1 AND p = 0)::INT) AS fn, avg((y = p)::INT) AS acc FROM s) SELECT 'accuracy' AS metric, round(acc, 6) AS value FROM c UNION ALL SELECT 'precision', round(tp / nullif(tp + fp, 0), 6) FROM c UNION ALL SELECT 'recall', round(tp / nullif(tp + fn, 0), 6) FROM c UNION ALL SELECT 'f_meas', round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) FROM c")
_query("hier_rollup", lambda spark, d: _r(load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.sum("o_totalprice").alias("total")), "total").withColumn("total", F.round("total", 2)), "SELECT n_regionkey, n_nationkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
_query("step_pca", _line(S.step_normalize(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), S.step_pca(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2), keep=["PC1", "PC2"]))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Normalise, one-hot encode, then ordinary least squares over all rows."""
    t = load(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    recipe = Recipe().add(S.step_normalize(["l_quantity"]), S.step_dummy(["l_returnflag"])).prep(t)
    baked = recipe.bake(t)
    return models.linear_reg(baked, "l_extendedprice", ["l_quantity", *[c for c in baked.columns if c.startswith("l_returnflag_")][1:]])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_extra, catalog_flows, catalog_models, catalog_more, catalog_sql, catalog_steps  # noqa: F401, register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_extra, catalog_flows, catalog_models, catalog_more, catalog_sql, catalog_steps  # noqa: F401, register their queries

    return dict(SQL)
