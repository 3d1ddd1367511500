"""Tests on series, each one statistic per group from window columns and regression sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_tail
from ..plans.recipe import Step
from ..plans.selectors import all_numeric

#: Large-sample critical values of the Dickey-Fuller t statistic with a constant, at 1, 5 and 10 percent.
DICKEY_FULLER = {0.01: -3.43, 0.05: -2.86, 0.1: -2.57}
#: Those of residuals of a regression of two series, with a constant.
ENGLE_GRANGER = {0.01: -3.9, 0.05: -3.34, 0.1: -3.04}


def adf_test(df: DataFrame, col: str, group: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """``statistic``, the t of the last value in a regression of changes on it (no lagged changes), and ``stationary``."""
    w = Window.partitionBy(*group).orderBy(*order)
    x = df.withColumn("__x", F.lag(col).over(w)).withColumn("__d", F.col(col) - F.col("__x"))
    s = x.groupBy(*group).agg(F.regr_slope("__d", "__x").alias("b"), F.regr_count("__d", "__x").alias("n"), F.regr_sxx("__d", "__x").alias("sxx"), F.regr_syy("__d", "__x").alias("syy"))
    var = F.try_divide(F.col("syy") - F.col("b") ** 2 * F.col("sxx"), F.col("n") - 2)
    s = s.withColumn("statistic", F.try_divide(F.col("b"), F.sqrt(F.try_divide(var, F.col("sxx")))))
    return s.select(*group, "statistic", (F.col("statistic") < DICKEY_FULLER[alpha]).alias("stationary"))


def stationary(df: DataFrame, col: str, group: list[str], order: list[str], max_diff: int = 2) -> DataFrame:
    """``col`` differenced, in every group alike, until all groups test stationary or ``max_diff`` differences are taken."""
    w = Window.partitionBy(*group).orderBy(*order)
    for _ in range(max_diff):
        if not adf_test(df, col, group, order).where(~F.coalesce("stationary", F.lit(True))).limit(1).count():
            break
        df = df.withColumn(col, F.col(col) - F.lag(col).over(w))
    return df


def breusch_pagan(df: DataFrame, e: str, x: str, group: list[str]) -> DataFrame:
    """``statistic``: rows times the R squared of squared errors on ``x``."""
    return df.withColumn("__s", F.col(e) ** 2).groupBy(*group).agg((F.regr_count("__s", x) * F.regr_r2("__s", x)).alias("statistic"))


def granger(df: DataFrame, y: str, x: str, group: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """``statistic`` (F) and ``p_value`` per group of whether lags of ``x`` help to predict ``y`` beyond its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[[y, x]].dropna().to_numpy(float)
        n = len(v) - lags
        out = pd.DataFrame({c: [pdf[c].iat[0]] for c in group})
        f = p = None
        if n > 2 * lags + 1:
            own = np.column_stack((np.ones(n), *[v[lags - k : len(v) - k, 0] for k in range(1, lags + 1)]))
            both = np.column_stack((own, *[v[lags - k : len(v) - k, 1] for k in range(1, lags + 1)]))
            sse = lambda m: float(((v[lags:, 0] - m @ np.linalg.lstsq(m, v[lags:, 0], rcond=None)[0]) ** 2).sum())
            a, b = sse(own), sse(both)
            if b > 0:
                f = (a - b) / lags / (b / (n - 2 * lags - 1))
                p = f_tail(f, lags, n - 2 * lags - 1)
        out["statistic"], out["p_value"] = f, p
        return out

    kinds = dict(df.dtypes)
    return df.select(*group, *order, y, x).groupBy(*group).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", statistic double, p_value double")


def reconcile_top_down(base: DataFrame, history: DataFrame, y: str, parent: list[str], child: list[str]) -> DataFrame:
    """Forecasts ``.pred`` of parents dealt out by the children's shares of history; parents without one give null."""
    sums = history.groupBy(*parent, *child).agg(F.sum(y).alias("__s"))
    share = F.try_divide(F.col("__s"), F.sum("__s").over(Window.partitionBy(*parent)))
    return base.join(sums.withColumn("__share", share), parent).withColumn(".pred", F.col("`.pred`") * F.col("__share")).drop("__s", "__share")


def reconcile_bottom_up(base: DataFrame, levels: list[str], step: list[str]) -> DataFrame:
    """Forecasts ``.pred`` of the lowest level summed up for every level above, by one rollup for each step."""
    sets = [[*levels[:i], *step] for i in range(len(levels), -1, -1)]
    return base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*levels, *step)]).agg(F.sum("`.pred`").alias(".pred"))


def reconcile_ols(base: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Forecasts ``.pred`` of parents (``child`` null) and their children made to add up by least squares, every error weighing alike.

    With k children, each and their sum share the gap between the parent's
    forecast and the children's: a child gets gap / (k + 1) more.  Rows with a
    null parent key are left out.
    """
    is_parent = F.lit(True)
    for c in child:
        is_parent = is_parent & F.col(c).isNull()
    rows = base.dropna(subset=parent).withColumn("__parent", is_parent)
    sums = rows.groupBy(*parent).agg(F.sum(F.when(~F.col("__parent"), F.col("`.pred`"))).alias("__sum"), F.sum((~F.col("__parent")).cast("long")).alias("__k"), F.max(F.when(F.col("__parent"), F.col("`.pred`"))).alias("__top"))
    share = (F.coalesce("__top", "__sum") - F.coalesce("__sum", "__top")) / (F.col("__k") + 1)
    new = F.when(F.col("__parent"), F.coalesce("__sum", "__top") + F.col("__k") * share).otherwise(F.col("`.pred`") + share)
    return rows.join(sums, parent).withColumn(".pred", new).drop("__parent", "__sum", "__k", "__top")


def reconcile_middle_out(base: DataFrame, history: DataFrame, y: str, top: list[str], middle: list[str], child: list[str]) -> DataFrame:
    """Forecasts ``.pred`` of the middle level summed up to ``top`` and dealt down to the children by their shares of history, all levels in one table (missing levels null)."""
    down = reconcile_top_down(base, history, y, [*top, *middle], child).select(*top, *middle, *child, "`.pred`")
    kinds = dict(history.dtypes)
    none = lambda cs: [F.lit(None).cast(kinds[c]).alias(c) for c in cs]
    middle_rows = base.select(*top, *middle, *none(child), "`.pred`")
    up = base.groupBy(*top).agg(F.sum("`.pred`").alias(".pred")).select(*top, *none(middle), *none(child), "`.pred`")
    return up.unionByName(middle_rows).unionByName(down)


def cointegrated(df: DataFrame, y: str, xs: list[str], group: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """``column_name`` and, by group, ``statistic`` and ``cointegrated``: whether what is left of ``y`` after its regression on the column stands still.

    The residuals' Dickey-Fuller t without lagged changes, against the
    large-sample critical values of two series.
    """
    out = None
    for x in xs:
        fit = df.groupBy(*group).agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
        left = df.join(fit, group).withColumn("__e", F.col(y) - F.col("__a") - F.col("__b") * F.col(x)).select(*group, *order, "__e")
        one = adf_test(left, "__e", group, order).select(F.lit(x).alias("column_name"), *group, "statistic", (F.col("statistic") < ENGLE_GRANGER[alpha]).alias("cointegrated"))
        out = one if out is None else out.unionByName(one)
    return out


def _series_step(name: str, columns, passes) -> Step:
    """A step that drops the columns that fail in any group; ``passes(df, cs)`` gives column_name and ``ok`` by group."""

    def learn(df, cs):
        rows = passes(df, cs).groupBy("column_name").agg(F.min(F.coalesce("ok", F.lit(False)).cast("int")).alias("ok")).collect()  # a row a column
        ok = {r["column_name"] for r in rows if r["ok"]}
        return {c: c not in ok for c in cs}

    return Step(name, columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*[c for c in cs if k.get(c)]))


def step_select_cointegration(outcome: str, columns, group: list[str], order: list[str], alpha: float = 0.05) -> Step:
    """Columns that are cointegrated with the outcome in every group stay."""
    return _series_step("select_cointegration", columns, lambda df, cs: cointegrated(df, outcome, [c for c in cs if c != outcome], group, order, alpha).withColumnRenamed("cointegrated", "ok"))


def step_select_stationary(columns, group: list[str], order: list[str], alpha: float = 0.05) -> Step:
    """Columns that stand still in every group stay."""

    def passes(df, cs):
        each = [adf_test(df, c, group, order, alpha).select(F.lit(c).alias("column_name"), F.col("stationary").alias("ok")) for c in cs]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    return _series_step("select_stationary", columns, passes)


def step_select_granger(outcome: str, columns, group: list[str], order: list[str], lags: int = 1, alpha: float = 0.05) -> Step:
    """Columns whose lags help to predict the outcome in every group stay."""

    def passes(df, cs):
        each = [granger(df, outcome, c, group, order, lags).select(F.lit(c).alias("column_name"), (F.col("p_value") < alpha).alias("ok")) for c in cs if c != outcome]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    return _series_step("select_granger", columns, passes)


def seasonal_strength(df: DataFrame, columns: list[str], period: int, group: list[str], order: list[str]) -> DataFrame:
    """``column_name`` and, by group, ``strength``: the correlation of a column's changes with those ``period`` rows before."""
    w = Window.partitionBy(*group).orderBy(*order)
    changes = df.select(*group, *order, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in columns])
    lagged = changes.select(*group, *columns, *[F.lag(c, period).over(w).alias(f"__{c}") for c in columns])
    wide = lagged.groupBy(*group).agg(*[F.corr(c, f"__{c}").alias(c) for c in columns])
    return wide.unpivot(group, columns, "column_name", "strength")


def step_select_seasonal(columns, period: int, group: list[str], order: list[str], threshold: float = 0.3) -> Step:
    """Columns whose seasonal strength exceeds ``threshold`` in every group stay."""
    return _series_step("select_seasonal", columns, lambda df, cs: seasonal_strength(df, cs, period, group, order).withColumn("ok", F.col("strength") > threshold))
