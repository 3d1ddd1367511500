"""Spline bases of given shapes, depths, profiles and imputation by bagged trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recipe import Recipe, Step
from ..plans.selectors import all_numeric
from ..plans.specs import Flow, ModelSpec
from . import learners
from .choice import step_ns
from .quantiles import percentiles
from .steps import step_select


def b_splines(x: Column, knots: list[float], degree: int) -> tuple[list[Column], list[float]]:
    """All terms of a B-spline over the sorted ``knots`` (ends included), and the knots with the ends repeated; ``x`` outside takes the ends."""
    full = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    at = F.least(F.greatest(x, F.lit(float(knots[0]))), F.lit(float(knots[-1])))
    last = max((i for i in range(len(full) - 1) if full[i] < full[i + 1]), default=degree)
    terms = [F.when((at >= a) & ((at <= b) if i == last else (at < b)), 1.0).otherwise(0.0) for i, (a, b) in enumerate(zip(full, full[1:], strict=False))]
    for p in range(1, degree + 1):
        share = lambda i, p=p: (at - full[i]) / (full[i + p] - full[i]) if full[i + p] > full[i] else F.lit(0.0)
        rest = lambda i, p=p: (full[i + p + 1] - at) / (full[i + p + 1] - full[i + 1]) if full[i + p + 1] > full[i + 1] else F.lit(0.0)
        terms = [share(i) * terms[i] + rest(i) * terms[i + 1] for i in range(len(terms) - 1)]
    return terms, full


def _splines(name: str, columns, deg_free: int, degree: int, shape) -> Step:
    """A step that puts ``<c>_<name>_1``, ... in place of each column, inner knots at its quantiles; null gives null, and a column without values stays."""
    inner = deg_free - degree
    if inner < 0:
        raise ValueError("deg_free must be at least degree")

    def project(df, cs, k):
        new = {}
        for c in (c for c in cs if k[c]):
            knots = sorted(set(map(float, k[c])))
            if len(knots) == 1:
                knots = [knots[0], knots[0] + 1.0]
            x = F.col(f"`{c}`").cast("double")
            new |= {f"{c}_{name}_{i}": F.when(x.isNotNull(), v) for i, v in enumerate(shape(*b_splines(x, knots, degree), degree), 1)}
        return df.withColumns(new).drop(*[c for c in cs if k[c]])

    return Step(f"spline_{name}", columns, all_numeric(), None, lambda df, cs: percentiles(df, {c: [i / (inner + 1) for i in range(inner + 2)] for c in cs}), project)


def step_spline_monotone(columns=None, deg_free: int = 4, degree: int = 3) -> Step:
    """I-splines, which never fall: the sums of a B-spline's terms from each on, the first (always 1) left out."""
    return _splines("monotone", columns, deg_free, degree, lambda b, knots, d: [sum(b[i + 1 :], b[i]) for i in range(1, len(b))])


def step_spline_nonnegative(columns=None, deg_free: int = 4, degree: int = 3) -> Step:
    """M-splines: a B-spline's terms scaled to an area of 1."""
    return _splines("nonnegative", columns, deg_free, degree, lambda b, knots, d: [t * ((d + 1) / (knots[i + d + 1] - knots[i])) for i, t in enumerate(b) if knots[i + d + 1] > knots[i]])


def step_depth(class_col: str, columns=None, prefix: str = "depth") -> Step:
    """``<prefix>_<class>``: 1 / (1 + the squared Mahalanobis distance from the class), one aggregate by class; a class without a regular covariance gives null."""

    def learn(df, cs):
        cs = [c for c in cs if c != class_col]
        pairs = [(a, b) for i, a in enumerate(cs) for b in cs[i:]]
        x = lambda c: F.col(f"`{c}`").cast("double")
        whole = df.dropna(subset=[class_col, *cs])
        rows = whole.groupBy(class_col).agg(*[F.avg(x(c)) for c in cs], *[F.covar_samp(x(a), x(b)) for a, b in pairs]).collect()  # a row a class
        out = {}
        for r in rows:
            cov = np.zeros((len(cs), len(cs)))
            for (a, b), v in zip(pairs, r[1 + len(cs) :], strict=True):
                cov[cs.index(a), cs.index(b)] = cov[cs.index(b), cs.index(a)] = np.nan if v is None else v
            regular = np.isfinite(cov).all() and np.linalg.cond(cov) < 1e12
            out[str(r[0])] = (list(r[1 : 1 + len(cs)]), np.linalg.inv(cov).tolist() if regular else None)
        return {"columns": cs, "classes": out}

    def project(df, _, k):
        new = {}
        for name, (mean, inverse) in sorted(k["classes"].items()):
            if inverse is None:
                new[f"{prefix}_{name}"] = F.lit(None).cast("double")
                continue
            z = [F.col(f"`{c}`").cast("double") - m for c, m in zip(k["columns"], mean, strict=True)]
            far = sum((z[i] * z[j] * inverse[i][j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
            new[f"{prefix}_{name}"] = 1 / (1 + far)
        return df.withColumns(new)

    return Step("depth", columns, all_numeric(), None, learn, project)


def step_profile(profile: str, columns=None, points: int = 10) -> Step:
    """In place of the rows a grid: ``profile`` at ``points`` even steps over its training range, numeric columns at their mean, others at their most frequent value."""

    def learn(df, cs):
        numeric = set(all_numeric()(df))
        others = [c for c in cs if c != profile]
        row = df.agg(F.min(profile), F.max(profile), *[F.avg(c) if c in numeric else F.mode(c, True) for c in others]).first()
        return {"range": (row[0], row[1]), "fixed": dict(zip(others, row[2:], strict=True)), "types": {c: t if c not in numeric else "double" for c, t in df.dtypes if c in others}}

    def project(df, _, k):
        lo, hi = k["range"]
        grid = df.sparkSession.range(points if lo is not None else 0)
        at = F.lit(lo).cast("double") + F.col("id") * ((float(hi) - float(lo)) / max(points - 1, 1) if lo is not None else 0.0)
        return grid.select(at.alias(profile), *[F.lit(v).cast(k["types"][c]).alias(c) for c, v in k["fixed"].items()])

    return Step("profile", columns, None, None, learn, project)


def step_impute_bag(columns, impute_with: list[str], trees: int = 25, seed: int = 42) -> Step:
    """Missing numbers from bagged trees of the columns ``impute_with``, whose own gaps count as their means; a column never seen stays null."""

    def learn(df, cs):
        means = df.agg(*[F.avg(c).alias(c) for c in impute_with]).first().asDict()
        means = {c: 0.0 if v is None else float(v) for c, v in means.items()}
        whole = df.withColumns({f"__w{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(means[c])) for i, c in enumerate(impute_with)})
        names = [f"__w{i}" for i in range(len(impute_with))]
        models = {}
        for c in cs:
            known = whole.where(F.col(f"`{c}`").isNotNull()).withColumn("__y", F.col(f"`{c}`").cast("double"))
            if known.limit(1).count():
                models[c] = learners.bag_tree(known, "__y", names, trees=trees, seed=seed)
        return {"means": means, "models": models}

    def project(df: DataFrame, cs, k):
        names = [f"__w{i}" for i in range(len(impute_with))]
        out = df.withColumns({n: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(k["means"][c])) for n, c in zip(names, impute_with, strict=True)})
        for c in (c for c in cs if c in k["models"]):
            got = learners.predict(k["models"][c], out, names)
            out = got.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("double"), F.col("`.pred`"))).drop(".pred")
        return out.drop(*names)

    return Step("impute_bag", columns, all_numeric(), None, learn, project)


def gen_additive_mod(outcome: str, columns: list[str], deg_free: int = 4, penalty: float = 0.0) -> Flow:
    """A sum of natural splines of each column, to be fitted like any other flow."""
    return Flow(ModelSpec("linear_reg", args={"penalty": penalty}), outcome, recipe=Recipe().add(step_select([outcome, *columns]), step_ns(columns, deg_free)))
