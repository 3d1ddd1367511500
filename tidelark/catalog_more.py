"""More queries: selection, power and encoding steps, oscillators, folds, rankings, formulas and trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _day, _daily, _fit_sql, _fitted, _g, _gaps, _gaps_sql, _kept, _names, _o, _query, _r, _series, _w, KEY
from .functions import metrics as M
from .operators import learners as L
from .operators import oscillators as O
from .operators import resample
from .operators import selection as X
from .operators import steps as S
from .operators.models import linear_reg
from .plans import ranking
from .plans.formula import forge, mold
from .plans.recipe import Recipe
from .sources.tables import load

_price = "o_totalprice"


def _percentile(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", _price)
    return Recipe().add(S.step_percentile([_price], 20)).prep(t).bake(t)


_query("step_percentile", _percentile, f"WITH e AS (SELECT unnest(list_distinct(quantile_cont({_price}, [{', '.join(str(i / 20) for i in range(21))}]))) AS e FROM orders), l AS (SELECT list_sort(list(e)) AS l FROM e) SELECT o_orderkey, least(len(list_filter(l, lambda x: x <= {_price})) / (len(l) - 1) * 20, 20)::DOUBLE AS share FROM orders CROSS JOIN l".replace("SELECT o_orderkey, least(", "SELECT o_orderkey, floor(least(").replace("::DOUBLE AS share", f")::INT AS {_price}"))
_few = ["l_quantity", "l_tax", "twice"]
_query("step_lin_comb", _kept(X.step_lin_comb(_few)), f"SELECT column_name, column_name <> 'twice' AS kept FROM {_names}")
_query("step_vif", _kept(X.step_vif(_few)), f"SELECT column_name, column_name <> 'twice' AS kept FROM {_names}")
_query("step_select_variance_threshold", _kept(X.step_select_variance_threshold(["l_quantity", "l_tax", "flat"], 0.01)), f"SELECT column_name, CASE column_name WHEN 'flat' THEN false WHEN 'l_tax' THEN (SELECT var_pop(l_tax) > 0.01 FROM lineitem) WHEN 'l_quantity' THEN (SELECT var_pop(l_quantity) > 0.01 FROM lineitem) ELSE true END AS kept FROM {_names}")
_query("step_select_psi", _kept(X.step_select_psi("l_quantity <= 25", ["l_quantity", "l_tax"])), f"SELECT column_name, column_name <> 'l_quantity' AS kept FROM {_names}")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", _price)
    return _r(Recipe().add(X.step_target_encode(_price, ["o_orderpriority"], 10.0)).prep(t).bake(t).select("o_orderkey", "o_orderpriority"), "o_orderpriority").withColumn("o_orderpriority", F.round("o_orderpriority", 4))


_query("step_target_encode", _encoded, f"WITH a AS (SELECT avg({_price}) AS m FROM orders), k AS (SELECT o_orderpriority AS p, (sum({_price}) + 10 * any_value(m)) / (count({_price}) + 10) AS v FROM orders CROSS JOIN a GROUP BY 1) SELECT o_orderkey, round(v, 4) AS o_orderpriority FROM orders JOIN k ON o_orderpriority = p")
_query("step_ordinal", lambda spark, d: (lambda t: Recipe().add(X.step_ordinal({"o_orderstatus": ["P", "O", "F"]})).prep(t).bake(t))(load(spark, d, "orders").select("o_orderkey", "o_orderstatus")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END::INT AS o_orderstatus FROM orders")


def _imputed(spark: SparkSession, d: str) -> DataFrame:
    t = _gaps(spark, d).select("event_id", "value").join(load(spark, d, "events").select("event_id", F.col("user_id").cast("double").alias("user_id")), "event_id")
    return _r(Recipe().add(X.step_impute_linear(["value"], ["user_id"])).prep(t).bake(t).select("event_id", "value"), "value")


_query("step_impute_linear", _imputed, _gaps_sql + ", t AS (SELECT g.event_id, g.value, user_id::DOUBLE AS u FROM g JOIN events USING (event_id)), c AS (SELECT regr_slope(value, u) AS b, regr_intercept(value, u) AS a FROM t) SELECT event_id, round(coalesce(value, a + b * u), 6) AS value FROM t CROSS JOIN c")
for _name, _step in (("step_boxcox", X.step_boxcox), ("step_yeojohnson", X.step_yeojohnson)):
    _query(_name, lambda spark, d, step=_step: (lambda t: _r(Recipe().add(step(["l_quantity"])).prep(t).bake(t), "l_quantity"))(load(spark, d, "lineitem").select(*KEY, F.col("l_quantity").cast("double").alias("l_quantity"))))

# oscillators over the daily series
_query("augment_roc", _series(lambda s: O.roc(s, "v", _g, _o, 3), ["v_roc_3"]), _day + f"SELECT event_type, ts, round(v / nullif(lag(v, 3) {_w}, 0) - 1, 6) AS v_roc_3 FROM s")
_f5 = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_query("step_oscillators_rsi", _series(lambda s: O.rsi(s, "v", _g, _o, 5), ["v_rsi_5"]), _day + f", x AS (SELECT *, v - lag(v) {_w} AS x FROM s), y AS (SELECT event_type, ts, count(x) {_f5} AS n, avg(CASE WHEN x IS NULL THEN 0 ELSE greatest(x, 0) END) {_f5} AS a, avg(CASE WHEN x IS NULL THEN 0 ELSE greatest(-x, 0) END) {_f5} AS b FROM x) SELECT event_type, ts, round(CASE WHEN n < 5 THEN NULL WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END, 6) AS v_rsi_5 FROM y")
_query("step_oscillators_stochastic", _series(lambda s: O.stochastic(s, "v", "v", "v", _g, _o, 5, 3), ["v_stoch_k_5", "v_stoch_d_3"]), _day + f", k AS (SELECT event_type, ts, CASE WHEN row_number() {_w} >= 5 THEN 100 * (v - min(v) {_f5}) / nullif(max(v) {_f5} - min(v) {_f5}, 0) END AS k FROM s) SELECT event_type, ts, round(k, 6) AS v_stoch_k_5, CASE WHEN count(k) OVER q >= 3 THEN round(avg(k) OVER q, 6) END AS v_stoch_d_3 FROM k WINDOW q AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
_query("augment_bbands", _series(lambda s: O.bollinger(s, "v", _g, _o, 5), [f"v_bband_{k}_5" for k in ("lower", "middle", "upper")]), _day + "SELECT event_type, ts, " + ", ".join(f"CASE WHEN row_number() {_w} >= 5 THEN round(avg(v) {_f5} + {s} * 2 * stddev_samp(v) {_f5}, 6) END AS v_bband_{k}_5" for k, s in (("lower", -1), ("middle", 0), ("upper", 1))) + " FROM s")


def _ema_sql(spans: tuple[int, ...]) -> str:
    """Exponential means of v by spans, as a recursive table r of event_type, ts, n, m0, m1, ..."""
    base = "s AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS n FROM events GROUP BY event_type, date_trunc('day', ts))"
    first = ", ".join(f"v AS m{i}" for i in range(len(spans)))
    nxt = ", ".join(f"{2 / (n + 1)!r} * s.v + {1 - 2 / (n + 1)!r} * r.m{i}" for i, n in enumerate(spans))
    return f"WITH RECURSIVE {base}, r AS (SELECT event_type, ts, n, {first} FROM s WHERE n = 1 UNION ALL SELECT s.event_type, s.ts, s.n, {nxt} FROM r JOIN s ON s.event_type = r.event_type AND s.n = r.n + 1) "


_query("augment_ppo", _series(lambda s: O.ppo(s, "v", _g, _o), ["v_ppo_12_26"]), _ema_sql((12, 26)) + "SELECT event_type, ts, round(100 * (m0 - m1) / nullif(m1, 0), 6) AS v_ppo_12_26 FROM r")
_query("step_oscillators_macd", _series(lambda s: O.macd(s, "v", _g, _o), ["v_macd_12_26_9"]), _ema_sql((12, 26)) + "SELECT event_type, ts, round(m0 - m1, 6) AS v_macd_12_26_9 FROM r")
_query("step_fractional_diff", _series(lambda s: O.fractional_diff(s, "v", 0.4, _g, _o, 0.05), ["v_fracdiff"]), _day + f"SELECT event_type, ts, round(v - 0.4 * lag(v, 1) {_w} - 0.12 * lag(v, 2) {_w} - 0.064 * lag(v, 3) {_w}, 6) AS v_fracdiff FROM s")
_query("step_weight_time_decay", _series(lambda s: O.time_decay_weight(s, "ts", 7.0, _g), ["weight"]), _day + "SELECT event_type, ts, round(pow(0.5, date_diff('day', ts, max(ts) OVER (PARTITION BY event_type)) / 7.0), 6) AS weight FROM s")
_query("step_detrend_linear", _series(lambda s: O.detrend(s, "v", _g, _o), ["v_detrended"]), _day + f", t AS (SELECT *, (row_number() {_w})::DOUBLE AS t FROM s), c AS (SELECT event_type, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM t GROUP BY 1) SELECT event_type, ts, round(v - a - b * t, 6) AS v_detrended FROM t JOIN c USING (event_type)")
_query("step_detrend_constant", _series(lambda s: O.detrend(s, "v", _g, _o, "constant"), ["v_detrended"]), _day + "SELECT event_type, ts, round(v - avg(v) OVER (PARTITION BY event_type), 6) AS v_detrended FROM s")
_query("step_deseasonalize", _series(lambda s: O.deseasonalize(s, "v", _g, _o, 7), ["v_deseasonalized"]), _day + f", t AS (SELECT *, (row_number() {_w} - 1) % 7 AS p, CASE WHEN count(v) OVER q = 7 THEN v - avg(v) OVER q END AS x FROM s WINDOW q AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), m AS (SELECT event_type, p, avg(x) AS m FROM t GROUP BY 1, 2), c AS (SELECT event_type, avg(m) AS c FROM m GROUP BY 1) SELECT event_type, ts, round(v - coalesce(m - c, 0), 6) AS v_deseasonalized FROM t JOIN m USING (event_type, p) JOIN c USING (event_type)")
_query("pad_by_time", lambda spark, d: _r(O.pad_by_time(_daily(spark, d).where("day(ts) % 3 <> 2"), "ts", "day", _g), "v"), _day + ", k AS (SELECT * FROM s WHERE day(ts) % 3 <> 2), b AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM k GROUP BY 1) SELECT b.event_type, b.ts, round(v, 6) AS v FROM b LEFT JOIN k ON k.event_type = b.event_type AND k.ts = b.ts")

# folds
_ord = ["o_orderdate", "o_orderkey"]


def _folds_sql(cumulative: bool) -> str:
    """Half of the rows first, then folds of a tenth each, to the end of the table."""
    start = "0" if cumulative else "k * a"
    return f"WITH c AS (SELECT count(*) // 2 AS i, count(*) // 10 AS a, count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders), f AS (SELECT k::BIGINT AS k, i, a FROM generate_series(0, 9) AS t(k), c WHERE i + a + k * a <= n) SELECT o_orderkey, (k + 1)::INT AS fold, CASE WHEN r < i + k * a THEN 'train' ELSE 'test' END AS role FROM r JOIN f ON r >= {start} AND r < i + a + k * a"


def _share_folds(spark, d, cumulative: bool):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    n = rows.count()
    return resample.time_series_folds(rows, _ord, n // 2, n // 10, cumulative=cumulative).select("o_orderkey", "fold", "role")


for _name, _cum in (("time_series_cv_expanding", True), ("time_series_cv_rolling", False)):
    _query(_name, lambda spark, d, cum=_cum: _share_folds(spark, d, cum), _folds_sql(_cum))
_query("time_series_nested_cv", lambda spark, d: resample.time_series_folds(_daily(spark, d), _o, 10, 5, group=_g).select("event_type", "ts", "fold", "role"), _day + f", r AS (SELECT *, row_number() {_w} - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s) SELECT event_type, ts, (k + 1)::INT AS fold, CASE WHEN r < 10 + 5 * k THEN 'train' ELSE 'test' END AS role FROM r JOIN generate_series(0, 10) AS t(k) ON r < 15 + 5 * k AND 15 + 5 * k <= n")
_query("vfold_cv_strata", lambda spark, d: resample.vfold_cv(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, 7, "o_orderstatus"), "SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7919 + 7) % 1000003, o_orderkey) - 1) % 5 + 1)::INT AS fold FROM orders")

# metrics
_query("metric_mase", lambda spark, d: _r(M.mase(_fitted(spark, d), "v", "fitted", _g, _o, 7), "value"), _fit_sql + f", q AS (SELECT event_type, abs(v - f) AS e, abs(v - lag(v, 7) {_w}) AS d FROM p) SELECT event_type, round(avg(e) / avg(d), 6) AS value FROM q GROUP BY 1")
_query("metric_mda", lambda spark, d: _r(M.mda(_fitted(spark, d), "v", "fitted", _g, _o), "value"), _fit_sql + f", q AS (SELECT event_type, sign(v - lag(v) {_w}) = sign(f - lag(f) {_w}) AS d FROM p) SELECT event_type, round(avg(d::INT), 6) AS value FROM q GROUP BY 1")
_query("roc_auc", lambda spark, d: _r(M.roc_auc(load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars"), "value"), "WITH s AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)), c AS (SELECT x, sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM s GROUP BY 1), b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 6) AS value FROM b")
_query("ljung_box", lambda spark, d: _r(M.ljung_box(_fitted(spark, d), "e", _g, _o, 2), "value").withColumn("value", F.round("value", 4)), _fit_sql + f", c AS (SELECT event_type, ts, (v - f) - avg(v - f) OVER (PARTITION BY event_type) AS c FROM p), l AS (SELECT event_type, c, c * lag(c, 1) {_w} AS a, c * lag(c, 2) {_w} AS b FROM c), z AS (SELECT event_type, count(c) AS n, sum(c * c) AS v, sum(a) AS a, sum(b) AS b FROM l GROUP BY 1) SELECT event_type, round(n * (n + 2) * ((a / v) ** 2 / (n - 1) + (b / v) ** 2 / (n - 2)), 4) AS value FROM z")


# rankings of the metrics of two naive models, each event type a fold
def _results(spark: SparkSession, d: str) -> DataFrame:
    from .operators.models import naive_reg

    s, out = _daily(spark, d), None
    for name, kind in (("naive", "naive"), ("window", "window")):
        rows = M.metric_set(naive_reg(s, "v", _g, _o, kind, window=7), "v", "fitted", ["rmse", "mae"], _g).withColumn("wflow_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


_res_sql = _day + f", a AS (SELECT 'naive' AS wflow_id, event_type, v, coalesce(lag(v) {_w}, v) AS f FROM s UNION ALL SELECT 'window', event_type, v, coalesce(avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), v) FROM s), m AS (SELECT wflow_id, event_type, sqrt(avg((v - f) ** 2)) AS rmse, avg(abs(v - f)) AS mae FROM a GROUP BY 1, 2) "
_query("collect_metrics", lambda spark, d: _r(ranking.collect_metrics(_results(spark, d), ["wflow_id"]), "mean", "std", "std_err"), _res_sql + " UNION ALL ".join(f"SELECT wflow_id, '{k}' AS metric, round(avg({k}), 6) AS mean, round(stddev_samp({k}), 6) AS std, count(*) AS n, round(stddev_samp({k}) / sqrt(count(*)), 6) AS std_err FROM m GROUP BY 1" for k in ("rmse", "mae")))
_query("rank_results", lambda spark, d: _r(ranking.rank_results(_results(spark, d), ["wflow_id"], "rmse").select("wflow_id", "mean", "rank"), "mean"), _res_sql + "SELECT wflow_id, round(avg(rmse), 6) AS mean, (row_number() OVER (ORDER BY avg(rmse), wflow_id))::INT AS rank FROM m GROUP BY 1")


# formulas and trained models
def _molded(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_tax", "l_returnflag", "l_extendedprice")
    _, plan = mold("l_extendedprice ~ l_quantity + l_returnflag + I(l_quantity ** 2) + l_quantity:l_tax", t)
    return _r(forge(t, plan, outcomes=True).groupBy("`l_returnflag[T.N]`", "`l_returnflag[T.R]`").agg(F.count(F.lit(1)).alias("n"), F.sum("Intercept").alias("ones"), F.sum("`I(l_quantity ** 2)`").alias("sq"), F.sum("`l_quantity:l_tax`").alias("qt")), "sq", "qt").withColumn("qt", F.round("qt", 3)).withColumnsRenamed({"l_returnflag[T.N]": "is_n", "l_returnflag[T.R]": "is_r"})


_query("mold_forge", _molded, "SELECT (l_returnflag = 'N')::INT::DOUBLE AS is_n, (l_returnflag = 'R')::INT::DOUBLE AS is_r, count(*) AS n, count(*)::DOUBLE AS ones, round(sum(l_quantity ** 2), 6) AS sq, round(sum(l_quantity * l_tax), 3) AS qt FROM lineitem GROUP BY 1, 2")
_query("linear_reg_ridge", lambda spark, d: linear_reg(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], penalty=1000.0).withColumn("coefficient", F.round("coefficient", 3)), "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000) AS b FROM lineitem) SELECT 'Intercept' AS variable, round(my - b * mx, 3) AS coefficient FROM s UNION ALL SELECT 'l_quantity', round(b, 3) FROM s")
_PRED = ["l_quantity", "l_discount", "l_tax"]


def _trained(fit):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select(*KEY, *_PRED, "l_extendedprice")
        return _r(L.predict(fit(t, "l_extendedprice", _PRED), t, _PRED).select(*KEY, "`.pred`"), ".pred")

    return build


for _name, _fit in (("decision_tree", L.decision_tree), ("rand_forest", L.rand_forest), ("bag_tree", L.bag_tree), ("boost_tree", L.boost_tree), ("poisson_reg", L.poisson_reg)):
    _query(_name, _trained(_fit))


def _rfe(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select(*_PRED, "l_extendedprice")
    left = L.select_rfe(t, "l_extendedprice", _PRED, 1)
    return spark.createDataFrame([(c, c in left) for c in _PRED], "column_name string, kept boolean")


_query("step_rfe", _rfe)
