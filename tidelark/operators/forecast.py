"""Forecasts of many series: a series is one group, fitted in one task with numpy, all series in parallel.

A model is a function of the values in order that returns the one-step fitted
values and a function of the horizon.  Models compose: ``hybrid`` fits a second
one to what the first leaves.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Fit = tuple[np.ndarray, Callable[[int], np.ndarray]]
Model = Callable[[np.ndarray], Fit]


def _fields(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def forecast(df: DataFrame, y: str, group: list[str], order: list[str], h: int, model: Model) -> DataFrame:
    """group, ``step`` 1 to h and ``.pred``.  Rows with null ``y`` are left out; a series without others gives null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[y].dropna().to_numpy(float)
        out = pd.DataFrame({c: [pdf[c].iat[0]] * h for c in group})
        out["step"], out[".pred"] = np.arange(1, h + 1, dtype=np.int32), model(values)[1](h) if len(values) else None
        return out

    return df.select(*group, *order, y).groupBy(*group).applyInPandas(run, _fields(df, group) + ", step int, `.pred` double")


def fitted(df: DataFrame, y: str, group: list[str], order: list[str], model: Model) -> DataFrame:
    """The rows with ``fitted``, the prediction of each from those before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        known = pdf[y].notna().to_numpy()
        f = np.full(len(pdf), np.nan)
        if known.any():
            f[known] = model(pdf.loc[known, y].to_numpy(float))[0]
        pdf["fitted"] = pd.Series(f).astype(object).where(~np.isnan(f), None)
        return pdf

    return df.groupBy(*group).applyInPandas(run, _fields(df, df.columns) + ", fitted double")


def _states(v: np.ndarray, a: float, b: float, g: float, phi: float, trend: bool, season: str | None, m: int):
    """One pass of additive-error smoothing: fitted values and the last level, slope and season."""
    cycle = season is not None and len(v) >= 2 * m
    if cycle:
        mean = v[:m].mean()
        slope = (v[m : 2 * m].mean() - mean) / m if trend else 0.0
        line = mean + slope * (np.arange(m) - (m - 1) / 2)
        s = list(v[:m] - line if season == "additive" else v[:m] / np.where(line == 0, 1.0, line))
        level = line[0] - phi * slope
    else:
        slope = (v[1] - v[0]) if trend and len(v) > 1 else 0.0
        s, level = [0.0], v[0] - phi * slope  # one step before the first value
    mult = cycle and season == "multiplicative"
    if cycle and mult:
        s = [x or 1e-9 for x in s]
    fit = np.empty(len(v))
    for t, x in enumerate(v):
        old = s[t % m] if cycle else (1.0 if mult else 0.0)
        ahead = level + phi * slope
        fit[t] = ahead * old if mult else ahead + old
        new = a * (x / old if mult else x - old) + (1 - a) * ahead
        slope = b * (new - level) + (1 - b) * phi * slope if trend else 0.0
        if cycle:
            s[t % m] = g * (x / (new or 1e-9) if mult else x - new) + (1 - g) * old
        level = new
    return fit, level, slope, s, cycle, mult


def exp_smoothing(trend: str | None = None, season: str | None = None, period: int = 1, alpha: float | None = None, beta: float | None = None, gamma: float | None = None, phi: float = 1.0) -> Model:
    """Exponential smoothing; trend None, additive or damped (``phi`` below 1), season None, additive or multiplicative.

    The first value is the first level, without a season.  Parameters not
    given are the ones of least squared error on a grid refined three times.
    """

    def fit(v: np.ndarray) -> Fit:
        damp = 0.9 if trend == "damped" and phi == 1.0 else phi
        given = [alpha, beta if trend else 0.0, gamma if season else 0.0]
        best = [0.3 if p is None else p for p in given]
        axes = [np.linspace(0.05, 0.95, 7) if p is None else np.array([p]) for p in given]
        for width in (0.08, 0.025, 0.008) if None in given else ():
            err = lambda p: float(((v - _states(v, *p, damp, bool(trend), season, period)[0]) ** 2).sum())
            best = min(itertools.product(*axes), key=err)
            axes = [np.clip(np.linspace(x - width, x + width, 5), 0.001, 0.999) if p is None else np.array([p]) for x, p in zip(best, given, strict=True)]
        f, level, slope, s, cycle, mult = _states(v, *best, damp, bool(trend), season, period)

        def ahead(h: int) -> np.ndarray:
            k = np.arange(1, h + 1)
            line = level + slope * (k if damp == 1 else np.cumsum(damp**k))
            if not cycle:
                return line
            at = np.array([s[(len(v) + i) % period] for i in range(h)])
            return line * at if mult else line + at

        return f, ahead

    return fit


def theta(alpha: float | None = None) -> Model:
    """The mean of the straight line through the series and smoothing of the line that doubles its distance from it."""

    def fit(v: np.ndarray) -> Fit:
        t = np.arange(len(v), dtype=float)
        b = ((t - t.mean()) * v).sum() / max(((t - t.mean()) ** 2).sum(), 1e-300)
        a = v.mean() - b * t.mean()
        f, ahead = exp_smoothing(alpha=alpha)(2 * v - (a + b * t))
        return (f + a + b * t) / 2, lambda h: (ahead(h) + a + b * (len(v) + np.arange(h))) / 2

    return fit


def croston(alpha: float = 0.1, kind: str = "classic") -> Model:
    """Intermittent demand: smoothed sizes over smoothed intervals; ``sba`` takes 1 - alpha / 2 of that; ``tsb`` smooths the chance of demand."""

    def fit(v: np.ndarray) -> Fit:
        some = np.flatnonzero(v)
        if not len(some):
            return np.zeros(len(v)), lambda h: np.zeros(h)
        size, gap, wait = v[some[0]], float(some[0] + 1), 1
        chance = len(some) / len(v)
        f = np.empty(len(v))
        rate = lambda: size * chance if kind == "tsb" else size / gap * (1 - alpha / 2 if kind == "sba" else 1)
        for t, x in enumerate(v):
            f[t] = rate()
            if kind == "tsb":
                chance += alpha * ((x != 0) - chance)
            if x != 0:
                size += alpha * (x - size)
                gap += alpha * (wait - gap) if t > some[0] else 0.0
                wait = 1
            else:
                wait += 1
        return f, lambda h: np.full(h, rate())

    return fit


def _least(x: np.ndarray, y: np.ndarray, penalty: np.ndarray | float = 0.0) -> np.ndarray:
    return np.linalg.lstsq(x.T @ x + np.diag(np.broadcast_to(penalty, x.shape[1])), x.T @ y, rcond=None)[0]


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes, over centred columns of like scale: products of the raw ones lose the digits of values far from 0."""
    mean, level = x.mean(0), y.mean()
    x = x - mean
    scale = np.sqrt((x * x).mean(0))
    scale[scale <= 1e-14 * np.abs(mean)] = np.inf  # a column without variation has no slope
    slopes = np.linalg.lstsq(x / scale, y - level, rcond=None)[0] / scale
    return np.r_[level - mean @ slopes, slopes]


def _lagged(v: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([v[n - k : len(v) - k] for k in range(1, n + 1)]) if n else np.zeros((len(v), 0))


def arima(p: int = 1, d: int = 0, q: int = 0) -> Model:
    """ARIMA(p, d, q) with a constant by two regressions: errors from a long autoregression, then values on lags of both."""

    def fit(v: np.ndarray) -> Fit:
        w = np.diff(v, d) if d else v
        n = max(p, q)
        if len(w) <= p + q + 2 + n:
            return np.concatenate((v[:1], v[:-1])), lambda h: np.full(h, v[-1])
        e = np.zeros(len(w))
        if q:
            k = min(max(n + 3, 8), (len(w) - 1) // 3)
            x = _lagged(w, k)
            beta = _line(x, w[k:])
            e[k:] = w[k:] - beta[0] - x @ beta[1:]
            n = max(n, k) if len(w) - k > p + q + 2 else n
        x = np.column_stack((*[w[n - i : len(w) - i] for i in range(1, p + 1)], *[e[n - i : len(w) - i] for i in range(1, q + 1)], np.zeros((len(w) - n, 0))))
        beta = _line(x, w[n:])
        fit_w, e = w.copy(), np.zeros(len(w))
        step = lambda w, e, t: beta[0] + sum(beta[i] * w[t - i] for i in range(1, p + 1)) + sum(beta[p + i] * e[t - i] for i in range(1, q + 1))
        for t in range(max(p, q), len(w)):
            fit_w[t] = step(w, e, t)
            e[t] = w[t] - fit_w[t]
        f = np.concatenate((v[:d], v[d:] - (w - fit_w)))

        def ahead(h: int) -> np.ndarray:
            ws, es = list(w), list(e)
            for _ in range(h):
                ws.append(step(ws, es, len(ws)))
                es.append(0.0)
            out = np.array(ws[len(w) :])
            for i in range(d - 1, -1, -1):  # undo the differences, the last first
                out = np.cumsum(out) + (np.diff(v, i) if i else v)[-1]
            return out

        return f, ahead

    return fit


def auto_arima(max_p: int = 3, max_q: int = 2, max_d: int = 1) -> Model:
    """The order of least AICc; differences are taken while they lower the variance."""

    def fit(v: np.ndarray) -> Fit:
        d = 0
        while d < max_d and len(v) > d + 3 and np.var(np.diff(v, d + 1)) < np.var(np.diff(v, d) if d else v):
            d += 1
        best = None
        for p, q in itertools.product(range(max_p + 1), range(max_q + 1)):
            made = arima(p, d, q)(v)
            k, n = p + q + 2, len(v) - d
            if n - k - 1 <= 0:
                continue
            score = n * np.log(max(((v - made[0])[d:] ** 2).mean(), 1e-300)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            if best is None or score < best[0] - 1e-9:
                best = (score, made)
        return best[1] if best else arima(0, 0, 0)(v)

    return fit


def autoregression(lags: int = 1) -> Model:
    """A recursive regression on the last ``lags`` values."""
    return arima(lags, 0, 0)


def seasonal(period: int, rest: Model | None = None) -> Model:
    """Centred means per season index taken off a moving-average trend; the rest by another model, smoothing if not given."""

    def fit(v: np.ndarray) -> Fit:
        other = rest or exp_smoothing()
        if len(v) < 2 * period:
            return other(v)
        half = period // 2
        weight = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
        trend = np.convolve(v, weight, "valid")
        off, at = v[half : half + len(trend)] - trend, (np.arange(len(trend)) + half) % period
        s = np.array([off[at == i].mean() if (at == i).any() else 0.0 for i in range(period)])
        s -= s.mean()
        here = s[np.arange(len(v)) % period]
        f, ahead = other(v - here)
        return f + here, lambda h: ahead(h) + s[(len(v) + np.arange(h)) % period]

    return fit


def additive_trend(periods: tuple[float, ...] = (7.0,), fourier: int = 2, changes: int = 10, ridge: float = 10.0) -> Model:
    """A line that bends at ``changes`` evenly spaced points of the first four fifths, plus Fourier seasons, by ridge on the bends."""

    def fit(v: np.ndarray) -> Fit:
        n = len(v)
        bends = np.linspace(0, 0.8 * n, changes + 2)[1:-1]

        def design(t: np.ndarray) -> np.ndarray:
            waves = [f(2 * np.pi * k * t / p) for p in periods for k in range(1, fourier + 1) for f in (np.sin, np.cos)]
            return np.column_stack((np.ones(len(t)), t / n, *[np.maximum(t - b, 0) / n for b in bends], *waves))

        x = design(np.arange(n, dtype=float))
        beta = _least(x, v, np.r_[0, 0, np.full(changes, ridge), np.full(x.shape[1] - 2 - changes, 1e-6)])
        return x @ beta, lambda h: design(np.arange(n, n + h, dtype=float)) @ beta

    return fit


def hybrid(first: Model, second: Model) -> Model:
    """The sum of a model and a second one of what the first leaves."""

    def fit(v: np.ndarray) -> Fit:
        f, ahead = first(v)
        g, more = second(v - f)
        return f + g, lambda h: ahead(h) + more(h)

    return fit


def ensemble(*models: Model, weights: list[float] | None = None) -> Model:
    """The (weighted) mean of models."""

    def fit(v: np.ndarray) -> Fit:
        made = [m(v) for m in models]
        return np.average([f for f, _ in made], 0, weights), lambda h: np.average([a(h) for _, a in made], 0, weights)

    return fit


def vector_autoregression(df: DataFrame, ys: list[str], group: list[str], order: list[str], h: int, lags: int = 1) -> DataFrame:
    """group, step and ``.pred_<y>`` of each: every series on the last values of all, by least squares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[ys].dropna().to_numpy(float)
        out = pd.DataFrame({c: [pdf[c].iat[0]] * h for c in group})
        out["step"] = np.arange(1, h + 1, dtype=np.int32)
        rows = list(v)
        if len(v) > lags * (len(ys) + 1) + 1:
            x = np.column_stack((np.ones(len(v) - lags), *[v[lags - k : len(v) - k] for k in range(1, lags + 1)]))
            beta = np.linalg.lstsq(x, v[lags:], rcond=None)[0]
            for _ in range(h):
                rows.append(np.concatenate(([1.0], *rows[: -lags - 1 : -1])) @ beta)
        else:
            rows += [v[-1] if len(v) else np.full(len(ys), np.nan)] * h
        for i, c in enumerate(ys):
            out[f".pred_{c}"] = [float(r[i]) for r in rows[-h:]]
        return out

    return df.select(*group, *order, *ys).groupBy(*group).applyInPandas(run, _fields(df, group) + ", step int, " + ", ".join(f"`.pred_{c}` double" for c in ys))
