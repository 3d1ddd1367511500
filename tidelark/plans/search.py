"""Searches over models and columns that read the data once.

Every candidate is scored from the folds' matrices of cross products, which are
small (one a fold), so generations, annealing steps and subsamples cost no
further pass over the rows.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import cross_products
from ..operators.steps import _drop
from .recipe import Step
from .selectors import all_numeric
from .tuning import fold_matrices, scores, solve, square


def fold_losses(df: DataFrame, y: str, x: list[str], fold: str | Column, folds: int = 100) -> Callable[[list[str], float, float], float]:
    """A function of columns, penalty and mixture: the mean root mean square error over folds.

    At most ``folds`` matrices come to the driver; more raise an error.
    """
    rows = fold_matrices(df, y, x, fold).limit(folds + 1).collect()
    if not 1 < len(rows) <= folds:
        raise ValueError(f"{len(rows)} folds; from 2 to {folds} are allowed")
    grams = [square(r["gram"]) for r in sorted(rows, key=lambda r: str(r["fold"]))]
    total = sum(grams)

    def loss(columns: list[str], penalty: float = 0.0, mixture: float = 0.0) -> float:
        at = [1 + x.index(c) for c in columns]
        return float(np.mean([scores(g, at, solve(total - g, at, penalty, mixture))["rmse"] for g in grams]))

    return loss


def _result(df: DataFrame, tried: list[tuple[float, float, float]]) -> DataFrame:
    rows = [(f"Iter{i}", *t) for i, t in enumerate(tried)]
    return df.sparkSession.createDataFrame(rows, "`.config` string, penalty double, mixture double, mean double")


def tune_sim_anneal(df: DataFrame, y: str, x: list[str], fold: str | Column, penalties: tuple[float, float] = (1e-3, 1e3), iterations: int = 20, cooling: float = 0.02, seed: int = 42) -> DataFrame:
    """.config, penalty, mixture and mean rmse of every candidate tried, in order; a worse one is moved to with a chance that falls."""
    rng, loss = random.Random(seed), fold_losses(df, y, x, fold)
    low, high = map(math.log10, penalties)
    at = ((low + high) / 2, 0.5)
    now = loss(x, 10 ** at[0], at[1])
    tried = [(10 ** at[0], at[1], now)]
    for i in range(1, iterations):
        new = (min(max(at[0] + rng.gauss(0, (high - low) / 6), low), high), min(max(at[1] + rng.gauss(0, 0.2), 0.0), 1.0))
        value = loss(x, 10 ** new[0], new[1])
        tried.append((10 ** new[0], new[1], value))
        if value <= now or rng.random() < math.exp(-(value - now) / max(now, 1e-300) / (cooling / i)):
            at, now = new, value
    return _result(df, tried)


def tune_bayes(df: DataFrame, y: str, x: list[str], fold: str | Column, penalties: tuple[float, float] = (1e-3, 1e3), initial: int = 5, iterations: int = 10, seed: int = 42) -> DataFrame:
    """As ``tune_sim_anneal``; a Gaussian process picks the candidate of greatest expected improvement among 500."""
    rng, loss = np.random.default_rng(seed), fold_losses(df, y, x, fold)
    low, high = map(math.log10, penalties)
    real = lambda u: (float(10 ** (low + (high - low) * u[0])), float(u[1]))
    kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / 0.18)
    at = rng.random((initial, 2))
    value = [loss(x, *real(u)) for u in at]
    for _ in range(iterations):
        v = np.array(value)
        z = (v - v.mean()) / (v.std() or 1.0)
        inverse = np.linalg.inv(kernel(at, at) + 1e-6 * np.eye(len(at)))
        new = rng.random((500, 2))
        k = kernel(new, at)
        mean, sd = k @ inverse @ z, np.sqrt(np.maximum(1 - ((k @ inverse) * k).sum(1), 1e-12))
        u = (z.min() - mean) / sd
        gain = sd * (u * np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in u]) + np.exp(-u * u / 2) / math.sqrt(2 * math.pi))
        best = new[int(gain.argmax())]
        at = np.vstack((at, best))
        value.append(loss(x, *real(best)))
    return _result(df, [(*real(u), v) for u, v in zip(at, value, strict=True)])


def step_select_genetic_algorithm(outcome: str, fold: str | Column, columns=None, top_n: int | None = None, population_size: int = 20, generations: int = 15, mutation: float = 0.1, random_state: int = 42) -> Step:
    """The set of columns (at most ``top_n``) of least mean rmse over folds that a genetic search finds; of equal ones the smaller set."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        rng, loss = random.Random(random_state), fold_losses(df, outcome, cs, fold)
        known: dict[tuple[bool, ...], tuple] = {}

        def fitness(g):
            if g not in known:
                names = [c for c, keep in zip(cs, g, strict=True) if keep]
                known[g] = (round(loss(names), 12), len(names), g)
            return known[g]

        def fixed(g):
            g = list(g)
            while not any(g) or (top_n and sum(g) > top_n):
                i = rng.randrange(len(g))
                g[i] = not any(g) or (g[i] and not (top_n and sum(g) > top_n))
            return tuple(g)

        crowd = [fixed(rng.random() < 0.5 for _ in cs) for _ in range(population_size)]
        for _ in range(generations):
            crowd = sorted(crowd, key=fitness)
            parents, crowd = crowd[: max(2, population_size // 2)], crowd[:2]
            while len(crowd) < population_size:
                a, b = rng.sample(parents, 2)
                child = (p if rng.random() < 0.5 else q for p, q in zip(a, b, strict=True))
                crowd.append(fixed(g != (rng.random() < mutation) for g in child))
        best = min(crowd, key=fitness)
        return {c: not keep for c, keep in zip(cs, best, strict=True)}

    return Step("select_genetic_algorithm", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_select_stability(outcome: str, fold: str | Column, columns=None, penalty: float = 0.05, threshold: float = 0.8, subsamples: int = 50, random_state: int = 42) -> Step:
    """Columns that a lasso keeps in at least ``threshold`` of the random halves of the folds, standardised in each."""

    def learn(df, cs):
        from ..operators.choice import _coefficients

        cs = [c for c in cs if c != outcome]
        grams = [square(r["gram"]) for r in sorted(fold_matrices(df, outcome, cs, fold).collect(), key=lambda r: str(r["fold"]))]  # one a fold
        rng, times = random.Random(random_state), np.zeros(len(cs))
        for _ in range(subsamples):
            times += np.abs(_coefficients(sum(rng.sample(grams, max(1, len(grams) // 2))), penalty, 1.0)) > 1e-9
        return {c: bool(n < threshold * subsamples) for c, n in zip(cs, times, strict=True)}

    return Step("select_stability", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_ica(columns=None, num_comp: int | None = None, prefix: str = "IC", iterations: int = 200) -> Step:
    """Independent components in place of the columns, by the fixed point of the fourth moment.

    With that contrast every iteration needs only the moments of fourth order
    of the centred columns, which one aggregate gives: the number of columns to
    the fourth over 24, so this is for some ten columns.  The largest weight of
    each component is positive.
    """

    def learn(df, cs):
        whole = df.dropna(subset=cs)
        g = cross_products(whole, [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cs]])
        n, m = g[0, 0], g[0, 1:] / g[0, 0]
        values, vectors = np.linalg.eigh(g[1:, 1:] / n - np.outer(m, m))
        order = np.argsort(-values)[: num_comp or len(cs)]
        order = order[values[order] > 1e-12 * values.max()]
        white = (vectors[:, order] / np.sqrt(values[order])).T
        k, p = white.shape
        z = [sum((F.col(f"`{c}`").cast("double") - float(a)) * float(w) for c, a, w in zip(cs, m, row, strict=True)) for row in white]
        at = [(a, b, c, d) for a in range(k) for b in range(a, k) for c in range(b, k) for d in range(c, k)]
        named = whole.select(*[v.alias(f"__z{i}") for i, v in enumerate(z)])
        row = named.agg(*[F.avg(F.col(f"__z{a}") * F.col(f"__z{b}") * F.col(f"__z{c}") * F.col(f"__z{d}")) for a, b, c, d in at]).first()
        fourth = np.zeros((k,) * 4)
        for i, v in zip(at, row, strict=True):
            for a, b, c, d in {tuple(i[j] for j in o) for o in itertools.permutations(range(4))}:
                fourth[a, b, c, d] = v
        w = np.linalg.qr(np.random.default_rng(42).normal(size=(k, k)))[0]
        for _ in range(iterations):
            new = np.einsum("abcd,ib,ic,id->ia", fourth, w, w, w) - 3 * w
            u, _, v = np.linalg.svd(new)
            new = u @ v
            done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-12
            w = new
            if done:
                break
        weights = w @ white
        weights *= np.sign(weights[np.arange(k), np.abs(weights).argmax(1)])[:, None]
        return {"columns": cs, "m": m.tolist(), "w": weights.tolist()}

    def project(df, _, k):
        z = [F.col(f"`{c}`").cast("double") - a for c, a in zip(k["columns"], k["m"], strict=True)]
        return df.withColumns({f"{prefix}{i}": sum((x * a for x, a in zip(z[1:], w[1:], strict=True)), z[0] * w[0]) for i, w in enumerate(k["w"], 1)}).drop(*k["columns"])

    return Step("ica", columns, all_numeric(), None, learn, project)
