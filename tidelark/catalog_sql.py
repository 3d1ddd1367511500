"""SQL that computes the statistics behind selections, checks and tests of series, and queries that go with it.

Sums of squares of regressions come from an elimination over covariances, so
any least squares of a few columns can be said in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import KEY, _daily, _day, _g, _o, _query, _r, _w
from .catalog import QUERIES as _built
from . import catalog_more, catalog_steps  # noqa: F401, their queries get their SQL here
from .catalog_models import _CHARGE, _XS, _Y
from .operators import more_steps as MS
from .operators import rows as R
from .operators import series_tests as ST
from .plans.recipe import Recipe
from .sources.tables import load


def eliminated(table: str, terms: dict[str, str], order: list[str], name: str, group: str = "", centred: bool = True, ridge: float = 0.0) -> str:
    """CTEs ``name``0, ``name``1, ...: cross products of the terms, and those left when the columns of ``order`` are taken out in turn.

    ``a_b`` is the product of terms a and b (a before b), ``n`` the rows; a column without anything left takes out nothing.
    """
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [f"{f'covar_pop({terms[a]}, {terms[b]}) * count(*)' if centred else f'sum(({terms[a]}) * ({terms[b]}))'} AS {a}_{b}" for a, b in pairs]
    head, tail = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    out = [f"{name}0 AS (SELECT {head}count(*)::DOUBLE AS n, {', '.join(sums)} FROM {table}{tail})"]
    if ridge:
        unit = [f"{a}_{b} * n / sqrt({a}_{a} * {b}_{b})" + (f" + {ridge} * n" if a == b and a != names[-1] else "") + f" AS {a}_{b}" for a, b in pairs]
        out.append(f"{name}u AS (SELECT {head}n, {', '.join(unit)} FROM {name}0)")
    cell = lambda a, b: f"{a}_{b}" if names.index(a) <= names.index(b) else f"{b}_{a}"
    for i, c in enumerate(order, 1):
        left = [f"{a}_{b} - coalesce({cell(a, c)} * {cell(b, c)} / nullif({cell(c, c)}, 0), 0) AS {a}_{b}" for a, b in pairs]
        source = f"{name}u" if ridge and i == 1 else f"{name}{i - 1}"
        out.append(f"{name}{i} AS (SELECT {head}n, {', '.join(left)} FROM {source})")
    return ", ".join(out)


# columns that stay or go, on a table with a doubled, a flat and a sparse column
_ALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "twice", "flat", "gaps"]
_wide = "WITH t AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 AS twice, 1.0::DOUBLE AS flat, CASE WHEN l_quantity > 45 THEN l_tax END AS gaps FROM lineitem), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS i, {c}::DOUBLE AS v FROM t" for i, c in enumerate(_ALL)) + ")"
_varies = "SELECT column_name, i, min(v) IS DISTINCT FROM max(v) AND coalesce(avg((v IS NULL)::INT) <= 0.5, true) AS fit FROM u GROUP BY 1, 2"
_pairs = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr({a}, {b})) AS r FROM t" for j, b in enumerate(_ALL) for i, a in enumerate(_ALL[:j]))


def _state(name: str, sql: str) -> None:
    _query(name, _built[name], sql)


_state("step_zv", _wide + " SELECT column_name, min(v) IS DISTINCT FROM max(v) AS kept FROM u GROUP BY 1")
_state("step_filter_missing", _wide + " SELECT column_name, coalesce(avg((v IS NULL)::INT) <= 0.5, true) AS kept FROM u GROUP BY 1")
_state("step_select_corr", _wide + f", f AS ({_varies}), r AS ({_pairs}), x AS (SELECT r.j FROM r JOIN f ON f.i = r.i AND f.fit WHERE r > 0.9 GROUP BY 1) SELECT column_name, fit AND i NOT IN (SELECT j FROM x) AS kept FROM f")
_state("step_nzv", _wide + ", c AS (SELECT column_name, v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2), s AS (SELECT column_name, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v DESC) AS k FROM c), z AS (SELECT column_name, max(n) FILTER (WHERE k = 1) / max(n) FILTER (WHERE k = 2) AS freq, count(*) AS distinct_ FROM s GROUP BY 1) SELECT column_name, column_name NOT IN ('l_quantity', 'l_tax', 'flat') OR NOT (coalesce(freq > 19, true) AND 100 * distinct_ / (SELECT count(*) FROM t) < 10) AS kept FROM z RIGHT JOIN (SELECT DISTINCT column_name FROM u) USING (column_name)")
_three = {"q": "l_quantity", "t": "l_tax", "w": "twice"}
_rest = lambda kept: "SELECT column_name, CASE column_name " + " ".join(f"WHEN '{c}' THEN {k}" for c, k in kept.items()) + " ELSE true END AS kept FROM (SELECT DISTINCT column_name FROM u)"
_state("step_lin_comb", _wide + ", " + eliminated("t", _three, ["q", "t"], "e", centred=False) + ", s AS (SELECT e0.q_q > 1e-10 AS q, e1.t_t > greatest(1e-10, 1e-10 * e0.t_t) AS t, e2.w_w > greatest(1e-10, 1e-10 * e0.w_w) AS w FROM e0, e1, e2) " + _rest({c: f"(SELECT {k} FROM s)" for k, c in _three.items()}))
_state("step_vif", _wide + ", " + eliminated("t", _three, ["q", "t"], "e") + ", s AS (SELECT e2.w_w > 1e-9 * e0.w_w AS w, e0.t_t / e1.t_t <= 10 AS t FROM e0, e1, e2) " + _rest({"twice": "(SELECT w FROM s)", "l_tax": "(SELECT t FROM s)"}))
_edge = ", ".join(f"{i / 10}" for i in range(1, 10))
_psi = lambda c: f"(SELECT sum((p - q) * ln(p / q)) FROM (SELECT greatest(sum(h) / (SELECT sum((l_quantity <= 25)::INT) FROM t), 1e-4) AS p, greatest(sum(1 - h) / (SELECT sum((l_quantity > 25)::INT) FROM t), 1e-4) AS q FROM (SELECT len(list_filter(e, lambda x: x < {c}::DOUBLE)) AS bin, (l_quantity <= 25)::INT AS h FROM t, (SELECT list_distinct(quantile_cont({c}::DOUBLE, [{_edge}])) AS e FROM t WHERE l_quantity <= 25)) GROUP BY bin))"
_state("step_select_psi", _wide + " " + _rest({c: f"{_psi(c)} <= 0.25" for c in ("l_quantity", "l_tax")}))


# checks that flag what fails: trained on a part, applied to the whole table
def _flagged(step, part: str, keep: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        t = load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_tax", "l_returnflag", F.when(F.col("l_quantity") > 9, F.col("l_tax")).alias("gap"))
        return Recipe().add(step).prep(t.where(part)).bake(t).select(*KEY, keep)

    return build


_k = ", ".join(KEY)
_query("check_range_failures", _flagged(MS.check_range(["l_quantity"], 0.1, "flag"), "l_quantity BETWEEN 10 AND 40", "l_quantity_failed"), f"WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity BETWEEN 10 AND 40) SELECT {_k}, l_quantity NOT BETWEEN lo - 0.1 * (hi - lo) AND hi + 0.1 * (hi - lo) AS l_quantity_failed FROM lineitem, s")
_query("check_missing_failures", _flagged(MS.check_missing(["gap"], "flag"), "l_quantity > 9", "gap_failed"), f"SELECT {_k}, CASE WHEN l_quantity > 9 THEN l_tax END IS NULL AS gap_failed FROM lineitem")
_query("check_new_values_failures", _flagged(MS.check_new_values(["l_returnflag"], "flag"), "l_tax < 0.04 AND l_returnflag <> 'R'", "l_returnflag_failed"), f"SELECT {_k}, l_returnflag NOT IN (SELECT l_returnflag FROM lineitem WHERE l_tax < 0.04 AND l_returnflag <> 'R') AS l_returnflag_failed FROM lineitem")

# selection by an outcome
_v = {"q": "l_quantity", "d": "l_discount", "e": _Y, "y": _CHARGE}
_of = dict(zip(_XS, "qde", strict=True))
_last = {k: eliminated("lineitem", _v, [o for o in "qde" if o != k] + [k], k) for k in "qde"}
_fits = "WITH " + ", ".join(_last.values()) + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {k}0.n, {k}0.y_y AS whole, {k}2.y_y AS without, {k}3.y_y AS sse, {k}2.{k}_y / {k}2.{k}_{k} AS b, {k}0.{k}_{k} / {k}0.n AS var FROM {k}0, {k}2, {k}3" for c, k in _of.items()) + ") "
_state("step_pvalue", _fits + "SELECT column_name, (without - sse) / (sse / (n - 4)) > 3.8417 AS kept FROM s")  # the square of t at 5 %, many rows
_state("step_select_lofo", _fits + "SELECT column_name, (sqrt(without / n) - sqrt(sse / n)) / sqrt(whole / n) > 0.01 AS kept FROM s")
_state("step_select_permutation", _fits + "SELECT column_name, row_number() OVER (ORDER BY b * b * var DESC, column_name) = 1 AS kept FROM s")
_spread = " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(abs({c} - m)) AS a FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)" for c in _XS)
_state("step_select_shap", _fits + f", a AS ({_spread}) SELECT column_name, row_number() OVER (ORDER BY abs(b) * a DESC, column_name) = 1 AS kept FROM s JOIN a USING (column_name)")
_ridge = {k: eliminated("lineitem", _v, [o for o in "qde" if o != k], k, ridge=0.01) for k in "qde"}
_state("step_select_ridge", "WITH " + ", ".join(_ridge.values()) + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, abs({k}_y / {k}_{k}) AS b FROM {k}2" for c, k in _of.items()) + ") SELECT column_name, row_number() OVER (ORDER BY b DESC, column_name) = 1 AS kept FROM s")
_sets = {m: [k for i, k in enumerate("qde") if m >> i & 1] for m in range(8)}
_aic = "WITH " + ", ".join(eliminated("lineitem", _v, ks, f"m{m}_") for m, ks in _sets.items()) + ", c AS (" + " UNION ALL ".join(f"SELECT {m} AS m, n * ln(greatest(y_y, 1e-300) / n) + 2.0 * ({len(ks)} + 1) AS cost FROM m{m}_{len(ks)}" for m, ks in _sets.items()) + "), p0 AS (SELECT 0 AS m)"
_move = "".join(f", p{i + 1} AS (SELECT coalesce((SELECT arg_min(b.m, b.cost) FROM c b WHERE b.m & p.m = p.m AND bit_count(b.m) = bit_count(p.m) + 1 AND b.cost < a.cost - 1e-9), p.m) AS m FROM p{i} p JOIN c a ON a.m = p.m)" for i in range(3))
_state("step_select_stepwise", _aic + _move + " SELECT column_name, (m >> i) & 1 = 1 AS kept FROM p3, (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(_XS)) + ") AS x(column_name, i)")
_state("step_filter_anova", "WITH " + "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, l_returnflag AS g, {c} AS v FROM lineitem" for c in _XS) + "), k AS (SELECT column_name, g, count(v) AS n, avg(v) AS a, var_pop(v) AS s FROM l GROUP BY 1, 2), m AS (SELECT column_name, sum(n * a) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(n * s) AS within FROM k GROUP BY 1) SELECT column_name, sum(k.n * (k.a - m.m) ** 2) / (any_value(m.k) - 1) / (any_value(m.within) / (any_value(m.n) - any_value(m.k))) > 2.9959 AS kept FROM k JOIN m USING (column_name) GROUP BY 1")  # F at 5 %, three classes, many rows
_state("step_filter_chisq", "WITH p AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT a, sum(n) AS na FROM p GROUP BY 1), b AS (SELECT b, sum(n) AS nb FROM p GROUP BY 1), e AS (SELECT coalesce(n, 0) AS n, na * nb / (SELECT sum(n) FROM p) AS e FROM a CROSS JOIN b LEFT JOIN p USING (a, b)) SELECT 'l_linestatus' AS column_name, sum((n - e) ** 2 / e) > 13.8155 AS kept FROM e")  # at 0.1 %, two degrees

# tests of series
_lags = f", l AS (SELECT event_type, v AS y, lag(v, 1) {_w} AS a, lag(v, 2) {_w} AS b, lag(sin(v), 1) {_w} AS c, lag(sin(v), 2) {_w} AS d FROM s), k AS (SELECT * FROM l WHERE b IS NOT NULL AND d IS NOT NULL)"
_query("granger", lambda spark, d: _r(ST.granger(_daily(spark, d).withColumn("w", F.sin("v")), "v", "w", _g, _o, 2), "statistic", "p_value"), _day + _lags + ", " + eliminated("k", {x: x for x in "abcdy"}, list("abcd"), "e", "event_type") + ", f AS (SELECT event_type, (e2.y_y - e4.y_y) / 2 / (e4.y_y / (e4.n - 5)) AS f, e4.n - 5 AS m FROM e2 JOIN e4 USING (event_type)) SELECT event_type, round(f, 6) AS statistic, round(pow(1 + 2 * f / m, -m / 2), 6) AS p_value FROM f")
_cum = f", k AS (SELECT event_type, ts, sum(v) {_w} AS v FROM s), l AS (SELECT event_type, ts, v, lag(v) {_w} AS x FROM k), r AS (SELECT event_type, regr_slope(v - x, x) AS b, regr_count(v - x, x) AS n, regr_sxx(v - x, x) AS sxx, regr_syy(v - x, x) AS syy FROM l GROUP BY 1), a AS (SELECT bool_and(coalesce(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86, true)) AS every FROM r) SELECT event_type, ts, round(CASE WHEN every THEN v ELSE v - x END, 6) AS v FROM l CROSS JOIN a"
_state("step_stationary_diff", _day + _cum)
_lagged = lambda spark, d: _daily(spark, d).withColumn("z", F.sin("v") + F.col("v") / 1000)
_query("step_best_lag", lambda spark, d: _r(R.best_lag(_lagged(spark, d), "v", ["z"], _g, _o), "corr"), _day + f", z AS (SELECT event_type, ts, v, sin(v) + v / 1000 AS z FROM s), l AS (SELECT v, {', '.join(f'lag(z, {k}) {_w} AS z{k}' for k in range(4))} FROM z), c AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, corr(v, z{k}) AS corr FROM l" for k in range(4)) + ") SELECT 'z' AS column_name, lag::INT AS lag, round(corr, 6) AS corr FROM c ORDER BY round(abs(corr), 12) DESC, lag LIMIT 1")

# powers of largest likelihood: the grid, then twice a finer one around its best
for _name, _f, _j in (("step_boxcox", "CASE WHEN abs(p) < 1e-9 THEN ln(x) ELSE (pow(x, p) - 1) / p END", "ln(x)"), ("step_yeojohnson", "CASE WHEN abs(p) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, p) - 1) / p END", "ln(1 + x)")):
    _grids, _score = "WITH g0 AS (SELECT -2 + 0.25::DOUBLE * i AS p FROM range(17) AS r(i))", f"SELECT p, -count(*) / 2.0 * ln(var_pop({_f})) + (p - 1) * sum({_j}) AS score FROM (SELECT l_quantity::DOUBLE AS x FROM lineitem WHERE l_quantity > 0) CROSS JOIN"
    for _i, _by in enumerate((0.05, 0.01), 1):
        _grids += f", b{_i} AS (SELECT arg_max(p, (score, -p)) AS b FROM ({_score} g{_i - 1} GROUP BY p)), g{_i} AS (SELECT round(b + {_by}::DOUBLE * i, 4) AS p FROM b{_i}, range(-5, 6) AS r(i))"
    _state(_name, _grids + f", z AS (SELECT arg_max(p, (score, -p)) AS p FROM ({_score} g2 GROUP BY p)) SELECT {_k}, round({_f}, 6) AS l_quantity FROM (SELECT {_k}, l_quantity::DOUBLE AS x FROM lineitem) CROSS JOIN z")
