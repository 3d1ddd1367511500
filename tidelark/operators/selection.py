"""Steps that choose or recode columns by a statistic of all rows: one aggregate each, small algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric
from .quantiles import percentiles
from .steps import _drop, _replace, correlation


def cross_products(df: DataFrame, terms: list[Column]) -> np.ndarray:
    """Sums of products of each two terms over all rows, from one aggregate."""
    n = len(terms)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*[F.sum(terms[i] * terms[j]).alias(f"g_{i}_{j}") for i, j in at]).first()
    g = np.zeros((n, n))
    for (i, j), v in zip(at, row, strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return g


def step_lin_comb(columns=None, threshold: float = 1e-5) -> Step:
    """A column that earlier ones combine to goes; nulls count as 0.

    What is left of each column beyond the earlier ones comes from a Cholesky
    pass over the Gram matrix; it must exceed ``threshold`` in length, and
    1e-5 of the column's own length, below which a Gram matrix cannot tell.
    """

    def learn(df, cs):
        g = cross_products(df, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs])
        kept, low = [], np.zeros((0, 0))
        out = {}
        for i, c in enumerate(cs):
            w = np.linalg.solve(low, g[kept, i]) if kept else np.zeros(0)
            left = g[i, i] - w @ w
            out[c] = bool(left <= max(threshold**2, 1e-10 * g[i, i]))
            if not out[c]:
                low = np.block([[low, np.zeros((len(kept), 1))], [w[None, :], np.array([[math.sqrt(left)]])]])
                kept.append(i)
        return out

    return Step("lin_comb", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_vif(columns=None, threshold: float = 10.0) -> Step:
    """The column of the largest variance inflation goes, until none exceeds ``threshold``; of equal ones the last."""

    def learn(df, cs):
        r = np.nan_to_num(correlation(df, cs), nan=0.0)
        left = list(range(len(cs)))
        while len(left) > 1:
            vif = np.diag(np.linalg.pinv(r[np.ix_(left, left)], hermitian=True))
            one = np.linalg.matrix_rank(r[np.ix_(left, left)], hermitian=True) < len(left)
            if one:  # exact combinations: drop the last column that adds no rank
                left.remove(next(i for n, i in reversed(list(enumerate(left))) if np.linalg.matrix_rank(r[np.ix_(left[: n + 1], left[: n + 1])], hermitian=True) == np.linalg.matrix_rank(r[np.ix_(left[:n], left[:n])], hermitian=True)))
                continue
            worst = max(range(len(left)), key=lambda n: (round(float(vif[n]), 9), n))
            if vif[worst] <= threshold:
                break
            left.pop(worst)
        return {c: i not in left for i, c in enumerate(cs)}

    return Step("vif", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_select_variance_threshold(columns=None, threshold: float = 0.0) -> Step:
    """Columns whose population variance is not above ``threshold`` go; all-null ones too."""
    return Step("select_variance_threshold", columns, all_numeric(), lambda cs: {c: F.var_pop(c) for c in cs}, None, lambda df, cs, k: df.drop(*_drop(k, lambda v: v is None or v <= threshold)))


def step_select_psi(split: str, columns=None, threshold: float = 0.25, bins: int = 10) -> Step:
    """Columns whose population stability index between the parts that the SQL condition ``split`` makes exceeds ``threshold`` go.

    Bins are quantiles of the rows where ``split`` holds; a share of 0 counts as 1e-4.
    """

    def learn(df, cs):
        inner = [i / bins for i in range(1, bins)]
        edges = percentiles(df.where(split), {c: inner for c in cs})
        edges = {c: sorted(set(edges[c] or [])) for c in cs}

        def bucket(c):
            return F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda e: e < F.col(c))) if edges[c] else F.lit(0)

        halves = {"a": F.expr(split), "b": ~F.expr(split)}
        row = df.agg(*[F.sum((half & F.col(c).isNotNull() & (bucket(c) == i)).cast("long")).alias(f"{c}_{h}_{i}") for c in cs for h, half in halves.items() for i in range(len(edges[c]) + 1)]).first()
        out = {}
        for c in cs:
            share = [np.array([row[f"{c}_{h}_{i}"] or 0 for i in range(len(edges[c]) + 1)], float) for h in halves]
            p, q = (np.maximum(s / max(s.sum(), 1.0), 1e-4) for s in share)
            out[c] = bool(((p - q) * np.log(p / q)).sum() > threshold)
        return out

    return Step("select_psi", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_target_encode(outcome: str, columns=None, smoothing: float = 0.0) -> Step:
    """A level becomes the mean outcome of its training rows, drawn to the overall mean by ``smoothing`` rows of it.

    Levels are joined, not listed in the plan, so their number is not bound.
    Null is a level of its own; levels unseen in training get the overall mean.
    """

    def learn(df, cs):
        mean = df.agg(F.avg(outcome)).first()[0]
        tables = {c: df.groupBy(F.col(c).alias("__level")).agg(((F.sum(outcome) + smoothing * (mean or 0.0)) / (F.count(outcome) + smoothing)).alias("__mean")) for c in cs}
        return {"mean": mean, "tables": tables}

    def project(df, cs, k):
        for c in cs:
            df = df.join(k["tables"][c], F.col(c).eqNullSafe(F.col("__level")), "left").withColumn(c, F.coalesce("__mean", F.lit(k["mean"]))).drop("__level", "__mean")
        return df

    return Step("target_encode", columns, all_nominal(), None, learn, project)


def step_ordinal(levels: dict[str, list[str]]) -> Step:
    """The position of the value in the stated order, from 0; null for others."""
    return Step("ordinal", list(levels), None, None, None, lambda df, cs, k: _replace(df, {c: F.when((p := F.array_position(F.array(*map(F.lit, levels[c])), F.col(c))) > 0, p - 1).cast("int") for c in cs}))


def step_impute_linear(columns: list[str], impute_with: list[str]) -> Step:
    """Nulls give way to a least-squares prediction from ``impute_with``, learnt on the rows where all are present."""

    def learn(df, cs):
        out = {}
        for c in cs:
            whole = df.dropna(subset=[c, *impute_with])
            g = cross_products(whole, [F.lit(1.0), *[F.col(x).cast("double") for x in impute_with], F.col(c).cast("double")])
            out[c] = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0].tolist()
        return out

    def project(df, cs, k):
        return _replace(df, {c: F.coalesce(F.col(c), sum((F.col(x) * b for x, b in zip(impute_with, k[c][1:], strict=True)), F.lit(k[c][0]))) for c in cs})

    return Step("impute_linear", columns, None, None, learn, project)


def _boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def _yeojohnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _power(name: str, transform, jacobian, usable, columns) -> Step:
    """The exponent of largest likelihood: a grid over [-2, 2] by 0.25, then twice a finer one around its best, an aggregate each."""

    def best(df, c, grid):
        x = F.when(usable(F.col(c)), F.col(c).cast("double"))
        row = df.agg(F.count(x), F.sum(jacobian(x)), *[F.var_pop(transform(x, v)) for v in grid]).first()
        n, logs, spread = row[0], row[1], row[2:]
        score = [-n / 2 * math.log(s) + (v - 1) * logs if s and s > 0 else -math.inf for v, s in zip(grid, spread, strict=True)] if n else []
        return grid[int(np.argmax(score))] if n and max(score) > -math.inf else None

    def learn(df, cs):
        out = {}
        for c in cs:
            at, step = best(df, c, np.arange(-2, 2.01, 0.25).tolist()), 0.25
            while at is not None and step > 0.01:
                step /= 5
                at = best(df, c, [round(at + step * i, 4) for i in range(-5, 6)])
            out[c] = at
        return out

    return Step(name, columns, all_numeric(), None, learn, lambda df, cs, k: _replace(df, {c: F.when(usable(F.col(c)), transform(F.col(c).cast("double"), k[c])) for c in cs if k[c] is not None}))


def step_boxcox(columns=None) -> Step:
    """Box-Cox of positive values; others become null."""
    return _power("boxcox", _boxcox, F.log, lambda x: x > 0, columns)


def step_yeojohnson(columns=None) -> Step:
    """Yeo-Johnson of all values."""
    return _power("yeojohnson", _yeojohnson, lambda x: F.signum(x) * F.log1p(F.abs(x)), lambda x: x.isNotNull(), columns)
