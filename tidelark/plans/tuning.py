"""Workflows of linear models over folds: grids, races, workflow sets and stacks.

One aggregate gives the matrix of cross products of each fold (and group).  A
fold's training matrix is the total less the fold's own, and coefficients,
squared errors and the cross products of out-of-fold predictions all follow
from those small matrices: a whole grid over all folds reads the data once,
whatever the number of models.  Groups stay distributed; a group's matrices,
one a fold, meet in one task.

Elastic net: half the squared error plus ``penalty * (mixture * L1 + (1 -
mixture) / 2 * L2)``, the intercept left out.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile
from . import ranking
from .recipe import FittedRecipe, Recipe, Step


@dataclass(frozen=True)
class tune:  # noqa: N801, reads as a mark in a specification
    """Marks a parameter that a grid fills in."""

    name: str = ""


@dataclass(frozen=True)
class LinearSpec:
    """A linear model; ``penalty`` and ``mixture`` may be ``tune()``."""

    penalty: float | tune = 0.0
    mixture: float | tune = 0.0

    def finalized(self, chosen: dict) -> "LinearSpec":
        return replace(self, **{k: float(chosen[k]) for k in ("penalty", "mixture") if k in chosen})


def grid_regular(ranges: dict[str, tuple], levels: int = 3) -> list[dict]:
    """All combinations of ``levels`` evenly spaced values; a range is (low, high) or (low, high, "log")."""
    axes = []
    for low, high, *kind in ranges.values():
        x = np.linspace(math.log10(low), math.log10(high), levels) if kind == ["log"] else np.linspace(low, high, levels)
        axes.append((10**x if kind == ["log"] else x).tolist())
    return [{".config": f"config_{i:03d}", **dict(zip(ranges, v, strict=True))} for i, v in enumerate(itertools.product(*axes), 1)]


def grid_random(ranges: dict[str, tuple], size: int = 10, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    draw = lambda low, high, kind=None: 10 ** rng.uniform(math.log10(low), math.log10(high)) if kind == "log" else rng.uniform(low, high)
    return [{".config": f"config_{i:03d}", **{k: draw(*r) for k, r in ranges.items()}} for i in range(1, size + 1)]


def fold_matrices(df: DataFrame, y: str, x: list[str], fold: str | Column, group: list[str] | None = None) -> DataFrame:
    """Group, fold and ``gram``, the upper triangle of the cross products of (1, x, y); rows with a null there are left out."""
    terms = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in x], F.col(f"`{y}`").cast("double")]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    named = df.withColumn("__fold", F.col(fold) if isinstance(fold, str) else fold)
    return named.dropna(subset=[y, *x]).groupBy(*(group or []), F.col("__fold").alias("fold")).agg(F.array(*sums).alias("gram"))


def square(flat) -> np.ndarray:
    m = int((math.sqrt(8 * len(flat) + 1) - 1) / 2)
    g = np.zeros((m, m))
    g[np.triu_indices(m)] = np.asarray(flat, float)
    return g + np.triu(g, 1).T


def solve(g: np.ndarray, at: list[int], penalty: float = 0.0, mixture: float = 0.0, nonnegative: bool = False, passes: int = 1000) -> np.ndarray:
    """(intercept, coefficients of the rows ``at``) from cross products of (1, x, y)."""
    n = g[0, 0]
    m = g[0, at] / n
    a = g[np.ix_(at, at)] - n * np.outer(m, m)
    b = g[at, -1] - g[0, -1] * m
    if not at:
        beta = np.zeros(0)
    elif mixture == 0 and not nonnegative:
        sd = np.sqrt(np.maximum(np.diag(a), 1e-300))  # to one scale, so that what is dependent shows
        beta = np.linalg.lstsq((a + penalty * np.eye(len(at))) / np.outer(sd, sd), b / sd, rcond=1e-11)[0] / sd
    else:
        beta, ridge, lasso = np.zeros(len(at)), penalty * (1 - mixture), penalty * mixture
        for _ in range(passes):
            before = beta.copy()
            for j in range(len(at)):
                if a[j, j] + ridge <= 0:
                    continue
                r = b[j] - a[j] @ beta + a[j, j] * beta[j]
                r = max(abs(r) - lasso, 0.0) * (1 if r > 0 else -1)
                beta[j] = max(r, 0.0) / (a[j, j] + ridge) if nonnegative else r / (a[j, j] + ridge)
            if np.abs(beta - before).max() <= 1e-12 * max(1.0, np.abs(beta).max()):
                break
    return np.concatenate(([(g[0, -1] / n) - m @ beta], beta))


def scores(g: np.ndarray, at: list[int], beta: np.ndarray) -> dict[str, float | None]:
    """rmse and r_squared (1 - SSE / SST) on the rows that ``g`` sums up."""
    c = np.zeros(len(g))
    c[0], c[at], c[-1] = -beta[0], -beta[1:], 1.0
    sse, sst = max(float(c @ g @ c), 0.0), g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    return {"rmse": math.sqrt(sse / g[0, 0]), "r_squared": 1 - sse / sst if sst > 0 else None}


def tune_grid(df: DataFrame, y: str, formulas: dict[str, list[str]], grid: list[dict], fold: str | Column, group: list[str] | None = None) -> DataFrame:
    """wflow_id, .config, penalty, mixture, fold, metric, value of every formula and configuration, by group if given.

    Folds without rows in the rest, as a single fold, give no rows.
    """
    group = group or []
    x = list(dict.fromkeys(c for cs in formulas.values() for c in cs))
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in group] + ["wflow_id string, `.config` string, penalty double, mixture double, fold string, metric string, value double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [square(v) for v in pdf["gram"]]
        total, rows = sum(grams), []
        for fold_id, g in zip(pdf["fold"], grams, strict=True):
            rest = total - g
            if rest[0, 0] <= 0:
                continue
            for name, cs in formulas.items():
                at = [1 + x.index(c) for c in cs]
                for p in grid:
                    found = scores(g, at, solve(rest, at, p.get("penalty", 0.0), p.get("mixture", 0.0)))
                    rows += [(*(pdf[c].iat[0] for c in group), name, p[".config"], p.get("penalty", 0.0), p.get("mixture", 0.0), str(fold_id), m, v) for m, v in found.items()]
        return pd.DataFrame(rows, columns=[*group, "wflow_id", ".config", "penalty", "mixture", "fold", "metric", "value"])

    mats = fold_matrices(df, y, x, fold, group)
    return mats.groupBy(*(group or [F.lit(0).alias("__all")])).applyInPandas(run, schema)  # one row a fold meets


def show_best(results: DataFrame, metric: str, n: int = 5) -> DataFrame:
    return ranking.rank_results(results, ["wflow_id", "`.config`", "penalty", "mixture"], metric, n)


def select_best(results: DataFrame, metric: str) -> dict:
    return show_best(results, metric, 1).select("wflow_id", "`.config`", "penalty", "mixture").first().asDict()


def _table(results: DataFrame, metric: str) -> tuple[pd.DataFrame, int]:
    """Configurations by folds, as losses: one cell a model and fold, bounded by the grid."""
    wide = results.where(F.col("metric") == metric).select("wflow_id", "`.config`", "fold", "value").toPandas()
    wide["model"] = list(zip(wide["wflow_id"], wide[".config"], strict=True))
    if metric in ranking.NEAR_ZERO:
        raise ValueError(f"{metric} has no direction to race in")
    sign = -1 if metric in ranking.MORE else 1
    ranking.cost(metric, F.lit(0.0))  # raises for a metric that is not known
    return sign * wide.pivot(index="model", columns="fold", values="value").sort_index(axis=0).sort_index(axis=1), sign


def _pass_anova(t: np.ndarray, alpha: float) -> np.ndarray:
    """Models not shown worse than the best: a two-way layout of models and folds, one-sided bounds at ``alpha``."""
    m, f = t.shape
    left = t - t.mean(1, keepdims=True) - t.mean(0, keepdims=True) + t.mean()
    df = (m - 1) * (f - 1)
    if df < 1:
        return np.ones(m, bool)
    gap = t.mean(1) - t.mean(1).min()
    return gap <= t_quantile(1 - alpha, df) * math.sqrt(2 * (left**2).sum() / df / f) + 1e-12


def _pass_win_loss(t: np.ndarray, alpha: float) -> np.ndarray:
    """Models whose Bradley-Terry ability is within its bound of the best one's; half a win each is added as a prior."""
    wins = (t[:, None, :] < t[None, :, :]).sum(2) + 0.5 * (t[:, None, :] == t[None, :, :]).sum(2) + 0.5
    np.fill_diagonal(wins, 0)
    games, p = wins + wins.T, np.ones(len(t))
    for _ in range(500):
        p = wins.sum(1) / (games / (p[:, None] + p[None, :])).sum(1)
        p /= np.exp(np.log(p).mean())
    q = p[:, None] / (p[:, None] + p[None, :])
    info = -games * q * (1 - q)
    np.fill_diagonal(info, 0)
    np.fill_diagonal(info, -info.sum(1))
    cov, best = np.linalg.pinv(info), int(p.argmax())
    se = np.sqrt(np.maximum(np.diag(cov) + cov[best, best] - 2 * cov[best], 0))
    return np.log(p[best]) - np.log(p) <= t_quantile(1 - alpha, 1e6) * se + 1e-12


def _race(results: DataFrame, metric: str, keep: Callable[[np.ndarray, float], np.ndarray], burn_in: int, alpha: float, num_ties: int) -> DataFrame:
    table, sign = _table(results, metric)
    alive = np.ones(len(table), bool)
    used = np.full(len(table), min(burn_in, table.shape[1]))
    ties, t = 0, table.to_numpy()
    for f in range(burn_in, table.shape[1] + 1):
        used[alive] = f
        if alive.sum() > 1 and f > 1:
            at = np.flatnonzero(alive)
            alive[at[~keep(t[at, :f], alpha)]] = False
            if alive.sum() == 2:
                ties += 1
                if ties >= num_ties:
                    pair = np.flatnonzero(alive)
                    alive[pair[t[pair, :f].mean(1).argmax()]] = False
    rows = [(w, c, int(n), float(sign * v[:n].mean()), bool(a)) for (w, c), n, v, a in zip(table.index, used, t, alive, strict=True)]
    return results.sparkSession.createDataFrame(rows, "wflow_id string, `.config` string, n int, mean double, pass boolean")


def tune_race_anova(results: DataFrame, metric: str = "rmse", burn_in: int = 3, alpha: float = 0.05, num_ties: int = 10) -> DataFrame:
    """wflow_id, .config, n folds used, mean over them and ``pass``: from ``burn_in`` folds on, models shown worse leave.

    A filter of finished results: linear models of all folds come from one aggregate, so no fit is saved.
    """
    return _race(results, metric, _pass_anova, burn_in, alpha, num_ties)


def tune_race_win_loss(results: DataFrame, metric: str = "rmse", burn_in: int = 3, alpha: float = 0.05, num_ties: int = 10) -> DataFrame:
    return _race(results, metric, _pass_win_loss, burn_in, alpha, num_ties)


def blend_predictions(df: DataFrame, y: str, members: dict[str, tuple[list[str], dict]], fold: str, penalty: float = 0.0, mixture: float = 1.0) -> DataFrame:
    """member and weight (Intercept first) of a stack: a non-negative elastic net on the out-of-fold predictions.

    Those are linear in x within a fold, so their cross products are the fold's matrix between the members' coefficients.
    """
    x = list(dict.fromkeys(c for cs, _ in members.values() for c in cs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [square(v) for v in pdf["gram"]]
        total, blend = sum(grams), 0.0
        for g in grams:
            b = np.zeros((len(g), len(members) + 2))
            b[0, 0] = b[-1, -1] = 1.0
            for k, (cs, p) in enumerate(members.values(), 1):
                at = [1 + x.index(c) for c in cs]
                b[[0, *at], k] = solve(total - g, at, p.get("penalty", 0.0), p.get("mixture", 0.0))
            blend = blend + b.T @ g @ b
        w = solve(blend, list(range(1, len(members) + 1)), penalty, mixture, nonnegative=True, passes=20000)
        return pd.DataFrame({"member": ["Intercept", *members], "weight": w})

    return fold_matrices(df, y, x, fold).groupBy(F.lit(0).alias("__all")).applyInPandas(run, "member string, weight double")


def predict_linear(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """``.pred`` from coefficients by name; a null input gives null."""
    total = F.lit(float(coefficients.get("Intercept", 0.0)))
    for c, b in coefficients.items():
        if c != "Intercept":
            total = total + F.col(f"`{c}`").cast("double") * float(b)
    return df.withColumn(".pred", total)


@dataclass(frozen=True)
class Workflow:
    """A preprocessor and a model; every change gives a new workflow."""

    spec: LinearSpec | None = None
    outcome: str | None = None
    predictors: tuple[str, ...] | None = None
    recipe: Recipe | None = None

    def add_model(self, spec: LinearSpec) -> "Workflow":
        if self.spec:
            raise ValueError("a model is already there")
        return replace(self, spec=spec)

    def update_model(self, spec: LinearSpec) -> "Workflow":
        return replace(self, spec=spec)

    def remove_model(self) -> "Workflow":
        return replace(self, spec=None)

    def add_formula(self, formula: str) -> "Workflow":
        """``y ~ a + b`` or ``y ~ .``."""
        if self.outcome or self.recipe:
            raise ValueError("a preprocessor is already there")
        left, right = (s.strip() for s in formula.split("~"))
        return replace(self, outcome=left, predictors=None if right == "." else tuple(s.strip() for s in right.split("+")))

    def add_recipe(self, recipe: Recipe, outcome: str) -> "Workflow":
        if self.outcome or self.recipe:
            raise ValueError("a preprocessor is already there")
        return replace(self, recipe=recipe, outcome=outcome)

    def finalize(self, chosen: dict) -> "Workflow":
        return replace(self, spec=self.spec.finalized(chosen))

    def fit(self, train: DataFrame, group: list[str] | None = None) -> "FittedWorkflow":
        """Fits on ``train``; of a recipe all numeric columns but the outcome and ``group`` predict."""
        if not self.spec or not self.outcome:
            raise ValueError("a workflow needs a model and a formula or recipe")
        prepared = self.recipe.prep(train) if self.recipe else None
        baked = prepared.bake(train) if prepared else train
        numeric = [f.name for f in baked.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte") or f.dataType.typeName().startswith("decimal")]
        x = list(self.predictors or [c for c in numeric if c != self.outcome and c not in (group or [])])
        y, p, m = self.outcome, self.spec.penalty, self.spec.mixture
        if isinstance(p, tune) or isinstance(m, tune):
            raise ValueError("parameters are still to be tuned: finalize first")
        schema = ", ".join([f"`{c}` {dict(baked.dtypes)[c]}" for c in (group or [])] + ["`__b` array<double>, n long, rmse double, r_squared double"])

        def run(batches: Iterable[pd.DataFrame]):
            for pdf in batches:
                out = pdf[group or []].copy()
                found = []
                for flat in pdf["gram"]:
                    g = square(flat)
                    at = list(range(1, len(x) + 1))
                    b = solve(g, at, p, m)
                    s = scores(g, at, b)
                    found.append((b.tolist(), int(g[0, 0]), s["rmse"], s["r_squared"]))
                out[["__b", "n", "rmse", "r_squared"]] = pd.DataFrame(found, columns=["__b", "n", "rmse", "r_squared"], index=out.index)
                yield out

        fits = fold_matrices(baked, y, x, F.lit(0), group).mapInPandas(run, schema)
        return FittedWorkflow(self, tuple(x), tuple(group or []), fits, prepared)

    def fit_nested(self, train: DataFrame, group: list[str]) -> "FittedWorkflow":
        """One model a group, all from one aggregate."""
        return self.fit(train, group)

    def fit_global(self, train: DataFrame, group: str) -> "FittedWorkflow":
        """One model for all groups, the group a predictor by indicators of all levels but the first."""
        from ..operators.steps import step_dummy

        first = Step("reference", learn=lambda df, cs: {"first": min(c for c in df.columns if c.startswith(f"{group}_"))}, project=lambda df, cs, k: df.drop(k["first"]))
        recipe = (self.recipe or Recipe()).add(step_dummy([group]), first)
        if self.predictors:
            train = train.select(self.outcome, *self.predictors, group)
        return replace(self, recipe=recipe, predictors=None).fit(train)


@dataclass(frozen=True)
class FittedWorkflow:
    workflow: Workflow
    predictors: tuple[str, ...]
    group: tuple[str, ...]
    fits: DataFrame
    prepared: FittedRecipe | None = field(default=None)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` (baked) with ``.pred``; groups never seen get null.

        Groups' coefficients join by equality; without groups they are literals of a projection.
        """
        baked = self.prepared.bake(df) if self.prepared else df
        if not self.group:
            row = self.fits.first()  # one row
            return predict_linear(baked, dict(zip(("Intercept", *self.predictors), row["__b"], strict=True))) if row else baked.withColumn(".pred", F.lit(None).cast("double"))
        joined = baked.join(self.fits.select(*self.group, "__b"), list(self.group), "left")
        total = F.col("__b")[0]
        for i, c in enumerate(self.predictors, 1):
            total = total + F.col(f"`{c}`").cast("double") * F.col("__b")[i]
        return joined.withColumn(".pred", total).drop("__b")

    def evaluate(self, df: DataFrame, names: list[str]) -> DataFrame:
        from ..functions.metrics import metric_set

        return metric_set(self.predict(df), self.workflow.outcome, "`.pred`", names, list(self.group))

    def coefficients(self) -> DataFrame:
        names = F.array(*[F.lit(c) for c in ("Intercept", *self.predictors)])
        return self.fits.select(*self.group, F.explode(F.arrays_zip(names.alias("variable"), F.col("__b").alias("coefficient"))).alias("e")).select(*self.group, "e.variable", "e.coefficient")

    def stats(self) -> DataFrame:
        return self.fits.select(*self.group, "n", "rmse", "r_squared")

    def extract_outputs(self, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """outputs (actuals, fitted, residuals), coefficients and stats."""
        y = F.col(f"`{self.workflow.outcome}`")
        return self.predict(df).withColumns({"actuals": y, "fitted": F.col("`.pred`"), "residuals": y - F.col("`.pred`")}), self.coefficients(), self.stats()


@dataclass(frozen=True)
class WorkflowSet:
    """Formulas crossed with models; ids are ``<formula>_<model>``."""

    formulas: dict[str, list[str]]
    models: dict[str, LinearSpec]
    outcome: str

    @staticmethod
    def from_cross(formulas: dict[str, list[str]], models: dict[str, LinearSpec], outcome: str) -> "WorkflowSet":
        return WorkflowSet(formulas, models, outcome)

    def ids(self) -> list[str]:
        return [f"{f}_{m}" for f in self.formulas for m in self.models]

    def fit_resamples(self, df: DataFrame, fold: str, group: list[str] | None = None) -> DataFrame:
        """As ``tune_grid``, for all formulas and models in one reading of ``df``."""
        grid = [{".config": k, "penalty": s.penalty, "mixture": s.mixture} for k, s in self.models.items()]
        rows = tune_grid(df, self.outcome, self.formulas, grid, fold, group)
        return rows.withColumn("wflow_id", F.concat_ws("_", "wflow_id", "`.config`"))

    def workflow_map(self, fn: str, *args, **named) -> DataFrame:
        if fn != "fit_resamples":
            raise ValueError(f"no function {fn}")
        return self.fit_resamples(*args, **named)
