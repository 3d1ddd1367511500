"""Steps that choose columns by their worth for an outcome, from one aggregate of cross products or counts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail, t_tail
from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric
from ..plans.tuning import solve
from .quantiles import percentiles
from .selection import cross_products
from .steps import _drop


def _matrix(df: DataFrame, cs: list[str], outcome: str) -> np.ndarray:
    """Cross products of (1, columns, outcome) over rows without nulls."""
    whole = df.dropna(subset=[*cs, outcome])
    return cross_products(whole, [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cs], F.col(f"`{outcome}`").cast("double")])


def _by(name: str, outcome: str, columns, choose: Callable[[np.ndarray, list[str]], set[str]]) -> Step:
    """A step that drops the columns that ``choose`` leaves out."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        kept = choose(_matrix(df, cs, outcome), cs)
        return {c: c not in kept for c in cs}

    return Step(name, columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def _top(score: dict[str, float], top_n: int | None, threshold: float) -> set[str]:
    """Columns above ``threshold``, the ``top_n`` largest if given; of equal ones the first by name."""
    ranked = sorted((c for c in score if score[c] > threshold), key=lambda c: (-round(score[c], 12), c))
    return set(ranked[:top_n])


def _moments(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred cross products of all but the constant."""
    m = g[0, 1:] / g[0, 0]
    return m, g[1:, 1:] - g[0, 0] * np.outer(m, m)


def _coefficients(g: np.ndarray, penalty: float, mixture: float) -> np.ndarray:
    """Elastic net on columns scaled to unit deviation; the penalty is per row."""
    n, (_, s) = g[0, 0], _moments(g)
    sd = np.sqrt(np.maximum(np.diag(s), 0) / n)
    scale = np.where(sd > 0, sd, 1.0)
    r = s / np.outer(scale, scale)
    unit = np.zeros_like(g)
    unit[0, 0], unit[1:, 1:] = n, r
    return solve(unit, list(range(1, len(g) - 1)), penalty * n, mixture)[1:]


def _penalised(name: str, outcome: str, columns, penalty: float, mixture: float, top_n: int | None, threshold: float) -> Step:
    return _by(name, outcome, columns, lambda g, cs: _top(dict(zip(cs, np.abs(_coefficients(g, penalty, mixture)), strict=True)), top_n, threshold))


def step_select_lasso(outcome: str, columns=None, penalty: float = 0.01, top_n: int | None = None) -> Step:
    """Columns with a coefficient in a lasso of standardised columns and outcome stay."""
    return _penalised("select_lasso", outcome, columns, penalty, 1.0, top_n, 1e-9)


def step_select_ridge(outcome: str, columns=None, penalty: float = 0.01, top_n: int | None = None, threshold: float = 0.0) -> Step:
    return _penalised("select_ridge", outcome, columns, penalty, 0.0, top_n, threshold)


def step_select_elastic_net(outcome: str, columns=None, penalty: float = 0.01, mixture: float = 0.5, top_n: int | None = None) -> Step:
    return _penalised("select_elastic_net", outcome, columns, penalty, mixture, top_n, 1e-9)


def p_values(g: np.ndarray) -> np.ndarray:
    """Two-sided p-values of the coefficients of all columns together, least squares with an intercept."""
    _, s = _moments(g)
    a, b, n = s[:-1, :-1], s[:-1, -1], g[0, 0]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta, df = inverse @ b, n - len(b) - 1
    if df <= 0:
        return np.ones(len(b))
    var = max(s[-1, -1] - beta @ b, 0.0) / df
    se = np.sqrt(np.maximum(np.diag(inverse) * var, 0))
    return np.array([t_tail(x / e, df) if e > 0 else float(x == 0) for x, e in zip(beta, se, strict=True)])


def step_pvalue(outcome: str, columns=None, alpha: float = 0.05) -> Step:
    """Columns whose coefficient has a p-value below ``alpha`` stay."""
    return _by("pvalue", outcome, columns, lambda g, cs: {c for c, p in zip(cs, p_values(g), strict=True) if p < alpha})


def _sse(g: np.ndarray, at: list[int]) -> float:
    _, s = _moments(g)
    b = s[at, -1]
    return max(float(s[-1, -1] - b @ np.linalg.lstsq(s[np.ix_(at, at)], b, rcond=None)[0]), 0.0) if at else float(s[-1, -1])


def step_select_stepwise(outcome: str, columns=None, criterion: str = "AIC", direction: str = "forward") -> Step:
    """Columns join (or leave) one at a time, the best first, while the criterion falls."""

    def choose(g, cs):
        n = g[0, 0]
        cost = lambda at: n * math.log(max(_sse(g, at), 1e-300) / n) + (2.0 if criterion == "AIC" else math.log(n)) * (len(at) + 1)
        at = [] if direction == "forward" else list(range(len(cs)))
        while True:
            moves = [sorted([*at, i]) for i in range(len(cs)) if i not in at] if direction == "forward" else [[j for j in at if j != i] for i in at]
            best = min(moves, key=lambda m: (cost(m), m), default=None)
            if best is None or cost(best) >= cost(at) - 1e-9:
                return {cs[i] for i in at}
            at = best

    return _by("select_stepwise", outcome, columns, choose)


def step_select_lofo(outcome: str, columns=None, threshold: float = 0.0) -> Step:
    """Columns stay whose absence raises the root mean square error by more than ``threshold`` of the outcome's deviation."""

    def choose(g, cs):
        every, n = list(range(len(cs))), g[0, 0]
        sd = math.sqrt(max(_sse(g, []), 1e-300) / n)
        whole = math.sqrt(_sse(g, every) / n)
        return {c for i, c in enumerate(cs) if (math.sqrt(_sse(g, [j for j in every if j != i]) / n) - whole) / sd > threshold}

    return _by("select_lofo", outcome, columns, choose)


def step_select_permutation(outcome: str, columns=None, top_n: int | None = None, threshold: float = 0.0) -> Step:
    """By permutation importance of a linear model: shuffling a column adds 2 b^2 var(x) to the mean square error, without shuffling."""

    def choose(g, cs):
        _, s = _moments(g)
        beta = np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]
        return _top(dict(zip(cs, 2 * beta**2 * np.diag(s)[:-1] / max(s[-1, -1], 1e-300), strict=True)), top_n, threshold)

    return _by("select_permutation", outcome, columns, choose)


def step_select_shap(outcome: str, columns=None, top_n: int | None = None, threshold: float = 0.0) -> Step:
    """By mean absolute Shapley value of a linear model, |b| times the column's mean absolute deviation: two aggregates."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        g = _matrix(df, cs, outcome)
        m, s = _moments(g)
        beta = np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]
        spread = df.agg(*[F.avg(F.abs(F.col(f"`{c}`") - float(x))) for c, x in zip(cs, m, strict=False)]).first()
        kept = _top({c: abs(b) * (v or 0.0) for c, b, v in zip(cs, beta, spread, strict=True)}, top_n, threshold)
        return {c: c not in kept for c in cs}

    return Step("select_shap", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_select_univariate(outcome: str, columns=None, top_n: int | None = None, alpha: float = 1.0) -> Step:
    """By the F of each column's own regression; p-values must be below ``alpha`` and the ``top_n`` largest F stay."""

    def choose(g, cs):
        n, (_, s) = g[0, 0], _moments(g)
        f = {}
        for i, c in enumerate(cs):
            r2 = s[i, -1] ** 2 / (s[i, i] * s[-1, -1]) if s[i, i] > 1e-12 * g[i + 1, i + 1] and s[-1, -1] > 0 else 0.0
            f[c] = r2 / max(1 - r2, 1e-15) * (n - 2)
        return {c for c in _top(f, top_n, 0.0) if f_tail(f[c], 1, n - 2) < alpha}

    return _by("select_univariate", outcome, columns, choose)


def step_filter_anova(outcome: str, columns=None, alpha: float = 0.05, top_n: int | None = None) -> Step:
    """Numeric columns whose means differ between the outcome's classes: one-way F test, one aggregate by class."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        rows = df.where(F.col(f"`{outcome}`").isNotNull()).groupBy(outcome).agg(*[a for c in cs for a in (F.count(c), F.avg(c), F.var_pop(c))]).collect()  # a row a class
        p = {}
        for i, c in enumerate(cs):
            v = np.array([[x if x is not None else 0.0 for x in r[1 + 3 * i : 4 + 3 * i]] for r in rows if r[1 + 3 * i]], float).reshape(-1, 3)
            n, k = v[:, 0].sum(), len(v)
            between = (v[:, 0] * (v[:, 1] - (v[:, 0] @ v[:, 1]) / max(n, 1)) ** 2).sum()
            within = v[:, 0] @ v[:, 2]
            p[c] = f_tail(between / (k - 1) / (within / (n - k)), k - 1, n - k) if k > 1 and n > k and within > 0 else 1.0
        kept = sorted((c for c in cs if p[c] < alpha), key=lambda c: (p[c], c))[:top_n]
        return {c: c not in kept for c in cs}

    return Step("filter_anova", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def _counts(df: DataFrame, c: str, outcome: str) -> np.ndarray:
    """The table of counts of two columns of few levels, nulls a level."""
    rows = df.groupBy(F.col(f"`{c}`").alias("a"), F.col(f"`{outcome}`").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    a, b = (sorted({r[i] for r in rows}, key=lambda x: (x is None, str(x))) for i in (0, 1))
    out = np.zeros((len(a), len(b)))
    for r in rows:
        out[a.index(r[0]), b.index(r[1])] = r[2]
    return out


def _nominal(name: str, outcome: str, columns, worth: Callable[[np.ndarray], float], least: float) -> Step:
    """Columns of few levels whose ``worth`` exceeds ``least``; the levels' table comes to the driver."""

    def learn(df, cs):
        return {c: worth(_counts(df, c, outcome)) <= least for c in cs if c != outcome}

    return Step(name, columns, all_nominal(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_filter_chisq(outcome: str, columns=None, alpha: float = 0.05) -> Step:
    """Columns that a chi-squared test shows to depend on the outcome (p below ``alpha``) stay."""

    def worth(t):
        e = np.outer(t.sum(1), t.sum(0)) / max(t.sum(), 1)
        df = (t.shape[0] - 1) * (t.shape[1] - 1)
        return 1 - chi2_tail(float(((t - e) ** 2 / e).sum()), df) if df else 0.0

    return _nominal("filter_chisq", outcome, columns, worth, 1 - alpha)


def step_filter_mutual_info(outcome: str, columns=None, threshold: float = 0.0) -> Step:
    """Columns that share more than ``threshold`` nats with the outcome stay."""

    def worth(t):
        p = t / max(t.sum(), 1)
        e = np.outer(p.sum(1), p.sum(0))
        return float((p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum())

    return _nominal("filter_mutual_info", outcome, columns, worth, threshold)


def step_select_smart_corr(columns=None, threshold: float = 0.8) -> Step:
    """Of columns correlated above ``threshold``, taken from the largest variance down, the first of each set stays."""

    def learn(df, cs):
        g = cross_products(df.dropna(subset=cs), [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cs]])
        _, s = _moments(g)
        sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
        kept: list[int] = []
        for i in sorted(range(len(cs)), key=lambda i: (-s[i, i], i)):
            if all(abs(s[i, j]) / sd[i] / sd[j] <= threshold for j in kept):
                kept.append(i)
        return {c: i not in kept for i, c in enumerate(cs)}

    return Step("select_smart_corr", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def _pls(g: np.ndarray, num_comp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations (sample), rotations of standardised columns, weights and explained squares, by deflating cross products."""
    n, (m, s) = g[0, 0], _moments(g)
    sd = np.sqrt(np.maximum(np.diag(s), 0) / max(n - 1, 1))
    scale = np.where(sd > 0, sd, 1.0)
    r = s / np.outer(scale, scale)
    a, b = r[:-1, :-1].copy(), r[:-1, -1].copy()
    rot, ws, ss, loads = [], [], [], []
    for _ in range(min(num_comp, len(b))):
        length = np.linalg.norm(b)
        if length < 1e-12:
            break
        w = b / length
        t = float(w @ a @ w)
        if t <= 1e-12:
            break
        p, q = a @ w / t, float(b @ w) / t
        direct = w.copy()
        for v, load in zip(rot, loads, strict=True):
            direct -= (load @ w) * v
        rot.append(direct)
        loads.append(p)
        ws.append(w)
        ss.append(q * q * t)
        a, b = a - t * np.outer(p, p), b - t * q * p
    return m[:-1], scale[:-1], np.array(rot).reshape(len(rot), -1), np.array(ws).reshape(len(ws), -1), np.array(ss)


def step_pls(outcome: str, columns=None, num_comp: int = 2, prefix: str = "PLS") -> Step:
    """Scores of partial least squares in place of the columns; the outcome stays."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        m, sd, rot, _, _ = _pls(_matrix(df, cs, outcome), num_comp)
        return {"columns": cs, "m": m.tolist(), "sd": sd.tolist(), "rot": rot.tolist()}

    def project(df, _, k):
        z = [(F.col(f"`{c}`").cast("double") - m) / s for c, m, s in zip(k["columns"], k["m"], k["sd"], strict=True)]
        return df.withColumns({f"{prefix}{i}": sum((x * w for x, w in zip(z[1:], v[1:], strict=True)), z[0] * v[0]) for i, v in enumerate(k["rot"], 1)}).drop(*k["columns"])

    return Step("pls", columns, all_numeric(), None, learn, project)


def step_vip(outcome: str, columns=None, threshold: float = 1.0, num_comp: int = 2) -> Step:
    """Columns whose importance in projection exceeds ``threshold`` stay; an error if none does."""

    def choose(g, cs):
        _, _, _, w, ss = _pls(g, num_comp)
        if not len(ss):
            raise ValueError("no column says anything of the outcome")
        vip = np.sqrt(len(cs) * (w**2 * ss[:, None]).sum(0) / ss.sum())
        kept = {c for c, v in zip(cs, vip, strict=True) if v > threshold}
        if not kept:
            raise ValueError("no column passes the threshold")
        return kept

    return _by("vip", outcome, columns, choose)


def step_ns(columns, df: int = 4) -> Step:
    """Natural cubic spline terms ``<c>_ns_1`` .. in place of each column, knots at its quantiles: a line and ``df`` - 1 bends."""

    def learn(data, cs):
        return percentiles(data, {c: [i / df for i in range(df + 1)] for c in cs})

    def project(data, cs, known):
        new = {}
        for c in cs:
            knots = sorted(set(known[c] or []))
            x = F.col(f"`{c}`").cast("double")
            new[f"{c}_ns_1"] = x
            cube = lambda k, x=x: F.pow(F.greatest(x - float(k), F.lit(0.0)), F.lit(3))
            d = lambda k, last: (cube(k) - cube(last)) / float(last - k)
            for i, k in enumerate(knots[:-2], 2):
                new[f"{c}_ns_{i}"] = d(k, knots[-1]) - d(knots[-2], knots[-1])
        return data.withColumns(new).drop(*cs)

    return Step("ns", columns, None, None, learn, project)


def step_bs(columns, df: int = 4, degree: int = 3) -> Step:
    """B-spline terms ``<c>_bs_1`` .. (the first, dependent one left out) in place of each column, inner knots at quantiles; values outside the range take its ends."""
    inner = df - degree

    def learn(data, cs):
        return percentiles(data, {c: [i / (inner + 1) for i in range(inner + 2)] for c in cs})

    def project(data, cs, known):
        new = {}
        for c in cs:
            q = known[c] or [0.0, 1.0]
            knots = [q[0]] * degree + list(q) + [q[-1]] * degree
            x = F.least(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(float(q[0]))), F.lit(float(q[-1])))
            last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1]) if q[0] < q[-1] else degree
            b = [F.when((x >= float(knots[i])) & ((x <= float(knots[i + 1])) if i == last else (x < float(knots[i + 1]))), 1.0).otherwise(0.0) for i in range(len(knots) - 1)]
            for p in range(1, degree + 1):
                up = lambda i, p=p: (x - float(knots[i])) / float(knots[i + p] - knots[i]) if knots[i + p] > knots[i] else F.lit(0.0)
                down = lambda i, p=p: (float(knots[i + p + 1]) - x) / float(knots[i + p + 1] - knots[i + 1]) if knots[i + p + 1] > knots[i + 1] else F.lit(0.0)
                b = [up(i) * b[i] + down(i) * b[i + 1] for i in range(len(b) - 1)]
            new |= {f"{c}_bs_{i}": F.when(F.col(f"`{c}`").isNotNull(), v) for i, v in enumerate(b[1:], 1)}
        return data.withColumns(new).drop(*cs)

    return Step("bs", columns, None, None, learn, project)
