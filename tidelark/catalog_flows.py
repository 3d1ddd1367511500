"""Queries of joins on order, censored times, tree steps, series selections, models of any kind over splits, and windows of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _daily, _day, _g, _o, _query, _r, _w
from .catalog_sql import eliminated
from .functions import survival as SV
from .operators import basis_steps as BS
from .operators import joins as J
from .operators import resample
from .operators import series_tests as ST
from .operators import steps as S
from .operators import tree_steps as TS
from .plans import specs
from .plans.recipe import Recipe
from .plans.tuning import tune
from .sources.tables import load
from .streaming.windows import run_available, summarize_stream

# joins on order
_clicks = lambda spark, d: load(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_value"))
_buys = lambda spark, d: load(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
_asof_sql = "WITH r AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'click' GROUP BY 1, 2), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT l.event_id, {v} AS last_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"
_query("asof_join", lambda spark, d: _r(J.asof_join(_buys(spark, d), _clicks(spark, d), "ts", ["user_id"], 86400.0).select("event_id", "last_value"), "last_value"), _asof_sql.format(v="round(r.last_value, 6)"))
_query("asof_join_tolerance", lambda spark, d: _r(J.asof_join(_buys(spark, d), _clicks(spark, d), "ts", ["user_id"], 86400.0, 3 * 86400.0).select("event_id", "last_value"), "last_value"), _asof_sql.format(v="CASE WHEN epoch(l.ts) - epoch(r.ts) <= 3 * 86400 THEN round(r.last_value, 6) END"))
_trials = lambda spark, d: load(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("to_ts"))
_query("interval_join", lambda spark, d: J.interval_join(_buys(spark, d), _trials(spark, d), "ts", "from_ts", "to_ts", ["user_id"], 86400.0).select("event_id", "signup_id"), "SELECT a.event_id, b.event_id AS signup_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 2 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'signup'")

# censored times: days into the year as the time, orders still open as censored
_TIMES = {60.0: "s60", 180.0: "s180", 300.0: "s300"}
_alive = {f"s{int(t)}": f"exp(-{t} * (1 + o_totalprice / 500000) / 200)" for t in _TIMES}
_waits = lambda spark, d: load(spark, d, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("time"), (F.col("o_orderstatus") != "O").cast("int").alias("event"), *[F.expr(e).alias(c) for c, e in _alive.items()])
_waits_sql = "WITH o AS (SELECT o_orderkey, dayofyear(o_orderdate)::INT AS time, (o_orderstatus <> 'O')::INT AS event, " + ", ".join(f"{e} AS {c}" for c, e in _alive.items()) + " FROM orders), c AS (SELECT time, count(*) AS k, sum((event = 0)::INT) AS z FROM o GROUP BY 1), n AS (SELECT time, sum(k) OVER (ORDER BY time DESC) - (k - z) AS n, z FROM c), g AS (SELECT time, n, z, product(CASE WHEN n > 0 THEN 1 - z / n ELSE 1 END) OVER (ORDER BY time) AS g FROM n)"
_at_sql = ", ".join(f"w{int(t)} AS (SELECT o.*, CASE WHEN time <= {t} AND event = 1 THEN 1 / nullif(h, 0) WHEN time > {t} THEN 1 / (SELECT min(g) FROM g WHERE time <= {t}) ELSE 0 END AS w FROM o JOIN (SELECT time, coalesce(lag(g) OVER (ORDER BY time), 1) AS h FROM g) USING (time))" for t in _TIMES)
_brier_sql = f"{_waits_sql}, {_at_sql}, b AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS eval_time, avg(w * CASE WHEN time <= {t} AND event = 1 THEN {c} ** 2 WHEN time > {t} THEN (1 - {c}) ** 2 ELSE 0 END) AS value FROM w{int(t)}" for t, c in _TIMES.items()) + ")"
_query("survival_censoring", lambda spark, d: _r(SV.censoring(_waits(spark, d), "time", "event"), "g"), _waits_sql + " SELECT time, n::BIGINT AS n, z::BIGINT AS censored, round(g, 6) AS g FROM g")
_query("brier_survival", lambda spark, d: _r(SV.brier_survival(_waits(spark, d), "time", "event", _TIMES), "value"), _brier_sql + " SELECT eval_time, round(value, 6) AS value FROM b")
_query("brier_survival_integrated", lambda spark, d: _r(SV.brier_survival_integrated(SV.brier_survival(_waits(spark, d), "time", "event", _TIMES)), "value"), _brier_sql + ", l AS (SELECT *, lag(eval_time) OVER (ORDER BY eval_time) AS t, lag(value) OVER (ORDER BY eval_time) AS v FROM b) SELECT round(sum((eval_time - t) * (value + v) / 2) / max(eval_time), 6) AS value FROM l")
_roc_sql = _waits_sql + ", " + _at_sql + ", q AS (SELECT s180 AS threshold, sum(CASE WHEN time <= 180 AND event = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN time > 180 THEN w ELSE 0 END) AS k FROM w180 GROUP BY 1), r AS (SELECT threshold, sum(p) OVER (ORDER BY threshold) / sum(p) OVER () AS sens, 1 - sum(k) OVER (ORDER BY threshold) / sum(k) OVER () AS spec FROM q)"
_query("roc_curve_survival", lambda spark, d: _r(SV.roc_curve_survival(_waits(spark, d).withColumn("s180", F.round("s180", 9)), "time", "event", "s180", 180.0), "threshold", "sensitivity", "specificity").groupBy("threshold").agg(F.max("sensitivity").alias("sensitivity"), F.min("specificity").alias("specificity")), _roc_sql.replace("SELECT s180 AS threshold", "SELECT round(s180, 9) AS threshold") + " SELECT round(threshold, 6) AS threshold, round(max(sens), 6) AS sensitivity, round(min(spec), 6) AS specificity FROM r GROUP BY 1")
_query("roc_auc_survival", lambda spark, d: _r(SV.roc_auc_survival(_waits(spark, d), "time", "event", "s180", 180.0), "value"), _roc_sql + ", a AS (SELECT sens, spec, coalesce(lag(sens) OVER (ORDER BY threshold), 0) AS s0, coalesce(lag(spec) OVER (ORDER BY threshold), 1) AS c0 FROM r) SELECT round(sum((c0 - spec) * (sens + s0) / 2), 6) AS value FROM a")

# series selections
_walk = lambda spark, d: _daily(spark, d).withColumn("walk", F.sum("v").over(ST.Window.partitionBy("event_type").orderBy("ts"))).withColumns({"near": F.col("walk") * 2 + F.sin("v") * 100, "far": F.sum(F.cos("v")).over(ST.Window.partitionBy("event_type").orderBy("ts"))})
_walk_sql = _day + f", a AS (SELECT *, sum(v) {_w} AS walk, sum(cos(v)) {_w} AS far FROM s), k AS (SELECT *, walk * 2 + sin(v) * 100 AS near FROM a)"


def _adf_sql(source: str, column: str) -> str:
    return f"SELECT event_type, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t FROM (SELECT event_type, regr_slope(e - x, x) AS b, regr_count(e - x, x) AS n, regr_sxx(e - x, x) AS sxx, regr_syy(e - x, x) AS syy FROM (SELECT event_type, {column} AS e, lag({column}) {_w} AS x FROM {source}) GROUP BY 1)"


_coint_sql = _walk_sql + "".join(f", {c}_f AS (SELECT event_type, regr_slope(walk, {c}) AS b, regr_intercept(walk, {c}) AS a FROM k GROUP BY 1), {c}_e AS (SELECT event_type, ts, walk - f.a - f.b * {c} AS e FROM k JOIN {c}_f f USING (event_type)), {c}_t AS ({_adf_sql(f'{c}_e', 'e')})" for c in ("near", "far"))
_query("cointegrated", lambda spark, d: _r(ST.cointegrated(_walk(spark, d), "walk", ["near", "far"], _g, _o), "statistic"), _coint_sql + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, event_type, round(t, 6) AS statistic, t < -3.34 AS cointegrated FROM {c}_t" for c in ("near", "far")))


def _left_of(make, names: list[str]):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = _walk(spark, d)
        out = Recipe().add(make()).prep(t).bake(t).columns
        return spark.createDataFrame([(c, c in out) for c in names], "column_name string, kept boolean")

    return build


_query("step_select_cointegration", _left_of(lambda: ST.step_select_cointegration("walk", ["near", "far"], _g, _o), ["near", "far"]), _coint_sql + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_and(t < -3.34) AS kept FROM {c}_t" for c in ("near", "far")))
_query("step_select_stationary", _left_of(lambda: ST.step_select_stationary(["v", "walk", "far"], _g, _o), ["v", "walk", "far"]), _walk_sql + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_and(t < -2.86) AS kept FROM ({_adf_sql('k', c)})" for c in ("v", "walk", "far")))
_season_sql = _walk_sql + "".join(f", {c}_d AS (SELECT event_type, ts, {c} - lag({c}) {_w} AS x FROM k), {c}_s AS (SELECT event_type, corr(x, y) AS r FROM (SELECT event_type, x, lag(x, 7) {_w} AS y FROM {c}_d) GROUP BY 1)" for c in ("v", "far"))
_query("seasonal_strength", lambda spark, d: _r(ST.seasonal_strength(_walk(spark, d), ["v", "far"], 7, _g, _o), "strength"), _season_sql + " " + " UNION ALL ".join(f"SELECT event_type, '{c}' AS column_name, round(r, 6) AS strength FROM {c}_s" for c in ("v", "far")))
_query("step_select_seasonal", _left_of(lambda: ST.step_select_seasonal(["v", "far"], 7, _g, _o, -0.2), ["v", "far"]), _season_sql + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_and(coalesce(r > -0.2, false)) AS kept FROM {c}_s" for c in ("v", "far")))

# hierarchies
_base = lambda spark, d: load(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias(".pred")).unionByName(load(spark, d, "orders").groupBy("o_orderpriority").agg((F.avg("o_totalprice") * 2.5).alias(".pred")).withColumn("o_orderstatus", F.lit(None).cast("string")))
_query("reconcile_ols", lambda spark, d: ST.reconcile_ols(_base(spark, d), ["o_orderpriority"], ["o_orderstatus"]).select("o_orderpriority", "o_orderstatus", F.round("`.pred`", 3).alias("pred")), "WITH c AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), t AS (SELECT o_orderpriority, avg(o_totalprice) * 2.5 AS top FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, sum(p) AS s, count(*) AS k, any_value(top) AS top FROM c JOIN t USING (o_orderpriority) GROUP BY 1) SELECT o_orderpriority, o_orderstatus, round(p + (top - s) / (k + 1), 3) AS pred FROM c JOIN s USING (o_orderpriority) UNION ALL SELECT o_orderpriority, NULL, round(s + k * (top - s) / (k + 1), 3) FROM s")
_middle = lambda spark, d: load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias(".pred"))
_past = lambda spark, d: load(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
_query("reconcile_middle_out", lambda spark, d: ST.reconcile_middle_out(_middle(spark, d), _past(spark, d), "o_totalprice", ["o_orderstatus"], ["o_orderpriority"], ["year"]).select("o_orderstatus", "o_orderpriority", "year", F.round("`.pred`", 3).alias("pred")), "WITH m AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS p, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) SELECT o_orderstatus, NULL AS o_orderpriority, NULL::INT AS year, round(sum(p), 3) AS pred FROM m GROUP BY 1 UNION ALL SELECT o_orderstatus, o_orderpriority, NULL, round(p, 3) FROM m UNION ALL SELECT o.o_orderstatus, o.o_orderpriority, year(o_orderdate)::INT, round(any_value(p) * sum(o_totalprice) / any_value(s), 3) FROM orders o JOIN m ON m.o_orderstatus = o.o_orderstatus AND m.o_orderpriority = o.o_orderpriority GROUP BY 1, 2, 3")

# steps that learn from trees
_TREE_X = ["l_quantity", "l_discount", "l_tax"]
_TREE_Y = "l_extendedprice * CASE WHEN l_discount >= 0.05 THEN 0.5 ELSE 1.0 END"
_lines = lambda spark, d: load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in _TREE_X], F.expr(_TREE_Y).cast("double").alias("y"))


def _split_sql(share: float) -> str:
    """The best single split of each column: b of column_name, cut, cost, n, yy, line (squares about the regression line)."""
    run = "OVER (PARTITION BY column_name ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    values = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::DOUBLE AS x, ({_TREE_Y})::DOUBLE AS y FROM lineitem" for c in _TREE_X)
    return f"""WITH l AS ({values}), a AS (SELECT column_name, x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY 1, 2),
w AS (SELECT column_name, x, sum(n) {run} AS n, sum(s) {run} AS s, sum(q) {run} AS q, sum(n) OVER p AS tn, sum(s) OVER p AS ts, sum(q) OVER p AS tq FROM a WINDOW p AS (PARTITION BY column_name)),
k AS (SELECT *, q - s * s / n + tq - q - (ts - s) ** 2 / (tn - n) AS cost FROM w WHERE n >= greatest(1, {share} * tn) AND tn - n >= greatest(1, {share} * tn)),
z AS (SELECT column_name, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS line FROM l GROUP BY 1),
b AS (SELECT column_name, arg_min(x, (round(cost, 3), x)) AS cut, min(cost) AS cost, any_value(tn) AS n, any_value(line) AS line FROM k JOIN z USING (column_name) GROUP BY 1)"""


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    known = Recipe().add(TS.step_splitwise("y", _TREE_X)).prep(_lines(spark, d)).steps[0].known
    return spark.createDataFrame([(c, known.get(c)) for c in _TREE_X], "column_name string, cut double")


_query("step_splitwise", _cuts, _split_sql(0.1) + " SELECT column_name, CASE WHEN n * (ln(line / n) - ln(cost / n)) >= 2 THEN cut END AS cut FROM b")
_stump = lambda make: lambda spark, d: (lambda t: Recipe().add(make("y", ["l_discount"], 1)).prep(t).bake(t))(_lines(spark, d))
_stump_sql = _split_sql(0.01) + f", c AS (SELECT cut FROM b WHERE column_name = 'l_discount') SELECT l_orderkey, l_linenumber, round(avg({_TREE_Y}) OVER (PARTITION BY l_discount >= cut), 3) AS {{name}} FROM lineitem, c"
_query("step_dt_discretiser", lambda spark, d: _stump(TS.step_dt_discretiser)(spark, d).select("l_orderkey", "l_linenumber", F.round("l_discount", 3).alias("l_discount")), _stump_sql.format(name="l_discount"))
_query("step_dt_features", lambda spark, d: _stump(TS.step_dt_features)(spark, d).select("l_orderkey", "l_linenumber", F.round("l_discount_dt", 3).alias("l_discount_dt")), _stump_sql.format(name="l_discount_dt"))


def _forest_kept(make):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = _lines(spark, d)
        out = Recipe().add(make()).prep(t).bake(t).columns
        return spark.createDataFrame([(c, c in out) for c in _TREE_X], "column_name string, kept boolean")

    return build


_query("step_filter_rf_importance", _forest_kept(lambda: TS.step_filter_rf_importance("y", _TREE_X, 1, trees=5)))
_query("step_select_probe", _forest_kept(lambda: TS.step_select_probe("y", _TREE_X, trees=10)))
_query("step_boruta", _forest_kept(lambda: TS.step_boruta("y", _TREE_X, rounds=8, trees=5)))


# models of any kind over splits
def _time_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = _daily(spark, d).withColumn("x", F.dayofmonth("ts").cast("double"))
    return resample.time_series_folds(rows, _o, 10, 5, group=_g)


_x_flow = lambda kind, **args: specs.Flow(specs.ModelSpec(kind, args=args), "v", ("x",))
_query("tune_grid_time_series", lambda spark, d: specs.tune_flows({"line": _x_flow("linear_reg")}, [], specs.splits_of_roles(_time_folds(spark, d)), ["rmse", "mae"]).select("wflow_id", "fold", "metric", F.round("value", 4).alias("value")),
       _day + f", r AS (SELECT event_type, day(ts)::DOUBLE AS x, v, row_number() {_w} - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s), f AS (SELECT k, x, v, CASE WHEN r < 10 + 5 * k THEN 'train' WHEN r < 15 + 5 * k THEN 'test' END AS role FROM r, generate_series(0, 1000) AS g(k) WHERE 15 + 5 * k <= n), c AS (SELECT k, regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM f WHERE role = 'train' GROUP BY 1), e AS (SELECT k, v - a - b * x AS e FROM f JOIN c USING (k) WHERE role = 'test') SELECT 'line' AS wflow_id, (k + 1)::VARCHAR AS fold, 'rmse' AS metric, round(sqrt(avg(e * e)), 4) AS value FROM e GROUP BY k UNION ALL SELECT 'line', (k + 1)::VARCHAR, 'mae', round(avg(abs(e)), 4) FROM e GROUP BY k")
_query("tune_grid_forest", lambda spark, d: specs.tune_flows({"forest": specs.Flow(specs.ModelSpec("rand_forest", args={"trees": 5, "tree_depth": tune()}), "y", recipe=Recipe().add(S.step_normalize(_TREE_X)), keep=("l_orderkey", "l_linenumber"))}, [{".config": f"config_{i:03d}", "tree_depth": p} for i, p in enumerate((2, 5), 1)], specs.splits_of_folds(resample.vfold_cv(_lines(spark, d), "l_orderkey", 2)), ["rmse"]).withColumnRenamed(".config", "config"))


def _per_group(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"), "l_extendedprice")
    flow = specs.Flow(specs.ModelSpec("linear_reg"), "l_extendedprice", recipe=Recipe().add(S.step_normalize(["l_quantity"])), keep=("l_orderkey", "l_linenumber"))
    out = specs.predict_groups(specs.fit_groups(flow, t, "l_returnflag"), t, "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 5).alias("z"), F.round("`.pred`", 2).alias("pred"))


_query("fit_nested_per_group_recipe", _per_group, "WITH g AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 5) AS z, round(a + b * l_quantity, 2) AS pred FROM lineitem JOIN g USING (l_returnflag)")


# windows of a stream
def _streamed(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = run_available(summarize_stream(stream, "ts", "6 hours", ["event_type"], "1 hour", n=F.count(F.lit(1)), total=F.sum("value")), spark, "windows")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


_query("summarize_stream", _streamed, "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, value FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")


# bases, depths, profiles
_whole = lambda step, *keep: lambda spark, d: (lambda t: _r(Recipe().add(step).prep(t).bake(t).select("l_orderkey", "l_linenumber", *keep), *keep))(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"))
_hats = "WITH k AS (SELECT min(l_quantity)::DOUBLE AS a, median(l_quantity)::DOUBLE AS m, max(l_quantity)::DOUBLE AS b FROM lineitem), h AS (SELECT l_orderkey, l_linenumber, a, m, b, greatest(0, (m - l_quantity) / (m - a)) AS h0, CASE WHEN l_quantity <= m THEN (l_quantity - a) / (m - a) ELSE (b - l_quantity) / (b - m) END AS h1, greatest(0, (l_quantity - m) / (b - m)) AS h2 FROM lineitem, k) SELECT l_orderkey, l_linenumber, "
_query("step_spline_monotone", _whole(BS.step_spline_monotone(["l_quantity"], 2, 1), "l_quantity_monotone_1", "l_quantity_monotone_2"), _hats + "round(h1 + h2, 6) AS l_quantity_monotone_1, round(h2, 6) AS l_quantity_monotone_2 FROM h")
_query("step_spline_nonnegative", _whole(BS.step_spline_nonnegative(["l_quantity"], 2, 1), *[f"l_quantity_nonnegative_{i}" for i in (1, 2, 3)]), _hats + "round(2 * h0 / (m - a), 6) AS l_quantity_nonnegative_1, round(2 * h1 / (b - a), 6) AS l_quantity_nonnegative_2, round(2 * h2 / (b - m), 6) AS l_quantity_nonnegative_3 FROM h")
_of_class = "(SELECT avg(l_quantity) AS q, avg(l_tax) AS t, var_samp(l_quantity) AS a, var_samp(l_tax) AS c, covar_samp(l_quantity, l_tax) AS b FROM lineitem WHERE l_returnflag = '{v}') AS {v}"
_far = "({v}.c * (l_quantity - {v}.q) ** 2 - 2 * {v}.b * (l_quantity - {v}.q) * (l_tax - {v}.t) + {v}.a * (l_tax - {v}.t) ** 2) / ({v}.a * {v}.c - {v}.b ** 2)"
_query("step_depth", _whole(BS.step_depth("l_returnflag", ["l_quantity", "l_tax"]), *[f"depth_{v}" for v in "ANR"]), "SELECT l_orderkey, l_linenumber, " + ", ".join(f'round(1 / (1 + {_far.format(v=v)}), 6) AS "depth_{v}"' for v in "ANR") + " FROM lineitem, " + ", ".join(_of_class.format(v=v) for v in "ANR"))
_query("step_profile", lambda spark, d: (lambda t: _r(Recipe().add(BS.step_profile("l_quantity", points=8)).prep(t).bake(t), "l_quantity", "l_tax"))(load(spark, d, "lineitem").select("l_quantity", "l_tax", "l_returnflag")), "SELECT round(a + i * (b - a) / 7, 6) AS l_quantity, round(t, 6) AS l_tax, r AS l_returnflag FROM range(8) AS g(i), (SELECT min(l_quantity)::DOUBLE AS a, max(l_quantity)::DOUBLE AS b, avg(l_tax) AS t FROM lineitem), (SELECT l_returnflag AS r FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
_query("step_impute_bag", lambda spark, d: (lambda t: _r(Recipe().add(BS.step_impute_bag(["gap"], ["l_quantity", "l_tax"], 5)).prep(t).bake(t), "gap"))(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.when(F.col("l_quantity") > 9, F.col("l_extendedprice")).alias("gap"))))


def _additive(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    fitted = BS.gen_additive_mod("l_extendedprice", ["l_quantity", "l_discount"], 1).fit(t)
    return fitted.predict(t).select(F.round("l_quantity_ns_1", 6).alias("l_quantity"), F.round("l_discount_ns_1", 6).alias("l_discount"), F.round("`.pred`", 2).alias("pred"))


_terms = {"q": "l_quantity", "d": "l_discount", "y": "l_extendedprice"}
_query("gen_additive_mod_lines", _additive, "WITH " + eliminated("lineitem", _terms, ["d", "q"], "a") + ", " + eliminated("lineitem", _terms, ["q", "d"], "b") + ", c AS (SELECT a1.q_y / a1.q_q AS bq, b1.d_y / b1.d_d AS bd FROM a1, b1), m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS y FROM lineitem) SELECT round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount, round(m.y + bq * (l_quantity - q) + bd * (l_discount - d), 2) AS pred FROM lineitem, c, m")
