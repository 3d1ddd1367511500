"""Recipe steps over columns of one row: scaling, categories, missing values, bins, filters."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric
from .quantiles import percentiles


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new) if new else df


def step_normalize(columns=None, method: str = "zscore") -> Step:
    """(x - mean) / population sd, or (x - min) / (max - min); constant columns become 0."""
    if method == "zscore":
        wanted = lambda cs: {f"{k}_{c}": f(c) for c in cs for k, f in (("a", F.avg), ("b", F.stddev_pop))}
    else:
        wanted = lambda cs: {k: x for c in cs for k, x in ((f"a_{c}", F.min(c).cast("double")), (f"b_{c}", (F.max(c) - F.min(c)).cast("double")))}
    return Step("normalize", columns, all_numeric(), wanted, None, lambda df, cs, k: _replace(df, {c: (F.col(c) - F.lit(k[f"a_{c}"])) / F.lit(k[f"b_{c}"] or 1.0) for c in cs}))


def step_center(columns=None) -> Step:
    return Step("center", columns, all_numeric(), lambda cs: {c: F.avg(c) for c in cs}, None, lambda df, cs, k: _replace(df, {c: F.col(c) - F.lit(k[c]) for c in cs}))


def step_scale(columns=None) -> Step:
    """x / sample sd; unchanged where that is 0."""
    return Step("scale", columns, all_numeric(), lambda cs: {c: F.stddev_samp(c) for c in cs}, None, lambda df, cs, k: _replace(df, {c: F.col(c) / F.lit(k[c]) for c in cs if k[c]}))


def step_range(columns=None, min_val: float = 0.0, max_val: float = 1.0) -> Step:
    wanted = lambda cs: {k: x for c in cs for k, x in ((f"a_{c}", F.min(c).cast("double")), (f"b_{c}", F.max(c).cast("double")))}
    return Step("range", columns, all_numeric(), wanted, None, lambda df, cs, k: _replace(df, {c: (F.col(c) - F.lit(k[f"a_{c}"])) / F.lit(k[f"b_{c}"] - k[f"a_{c}"]) * F.lit(max_val - min_val) + F.lit(min_val) for c in cs if k[f"b_{c}"] != k[f"a_{c}"]}))


def _levels(df: DataFrame, cs: list[str]) -> dict:
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cs]).first() if cs else {}
    return {c: row[c] for c in cs}


def step_dummy(columns, one_hot: bool = True) -> Step:
    """0/1 columns ``col_level`` of every training level; unknown values are 0 in all."""

    def project(df, cs, k):
        new = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c in cs for v in k[c]}
        return df.withColumns(new).drop(*cs)

    return Step("dummy", columns, all_nominal(), None, _levels, project) if one_hot else step_integer(columns)


def step_integer(columns=None, zero_based: bool = True) -> Step:
    """The position of the value among the sorted training levels; null for others."""

    def project(df, cs, k):
        return _replace(df, {c: F.when((p := F.array_position(F.array(*map(F.lit, k[c])), F.col(c))) > 0, p - int(zero_based)).cast("int") for c in cs if k[c]})

    return Step("integer", columns, all_nominal(), None, _levels, project)


def step_other(columns=None, threshold: float = 0.05, other_label: str = "other") -> Step:
    """Levels rarer than ``threshold`` of the rows, and null, become ``other_label``."""

    def learn(df, cs):
        n = df.count()
        return {c: sorted(r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= threshold * n).select(c).collect()) for c in cs}

    return Step("other", columns, all_nominal(), None, learn, lambda df, cs, k: _replace(df, {c: F.when(F.col(c).isin(k[c]), F.col(c)).otherwise(other_label) for c in cs}))


def step_novel(columns=None, novel_label: str = "new") -> Step:
    return Step("novel", columns, all_nominal(), None, _levels, lambda df, cs, k: _replace(df, {c: F.when(F.col(c).isNull() | F.col(c).isin(k[c]), F.col(c)).otherwise(novel_label) for c in cs}))


def step_unknown(columns=None, unknown_label: str = "_unknown_") -> Step:
    return Step("unknown", columns, all_nominal(), None, None, lambda df, cs, k: _replace(df, {c: F.coalesce(F.col(c), F.lit(unknown_label)) for c in cs}))


def step_indicate_na(columns=None, prefix: str = "na_ind") -> Step:
    """0/1 columns for those that had nulls in training."""
    return Step("indicate_na", columns, None, lambda cs: {c: F.max(F.col(c).isNull().cast("int")) for c in cs}, None, lambda df, cs, k: _replace(df, {f"{prefix}_{c}": F.col(c).isNull().cast("int") for c in cs if k[c]}))


def step_impute_mean(columns=None) -> Step:
    return Step("impute_mean", columns, all_numeric(), lambda cs: {c: F.avg(c) for c in cs}, None, lambda df, cs, k: _replace(df, {c: F.coalesce(F.col(c), F.lit(k[c])) for c in cs}))


def step_impute_median(columns=None) -> Step:
    return Step("impute_median", columns, all_numeric(), None, lambda df, cs: {c: v and v[0] for c, v in percentiles(df, {c: [0.5] for c in cs}).items()}, lambda df, cs, k: _replace(df, {c: F.coalesce(F.col(c), F.lit(k[c])) for c in cs}))


def step_impute_mode(columns=None) -> Step:
    """The most frequent value; of several, the smallest."""
    return Step("impute_mode", columns, all_nominal(), lambda cs: {c: F.mode(c, True) for c in cs}, None, lambda df, cs, k: _replace(df, {c: F.coalesce(F.col(c), F.lit(k[c])) for c in cs}))


def _bins(c: str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins, the lowest edge included; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in list(zip(edges, edges[1:], labels, strict=False))[::-1]:
        low = F.col(c) >= lo if lo == edges[0] else F.col(c) > lo
        out = F.when(low & (F.col(c) <= hi), label).otherwise(out)
    return out


def step_discretize(columns=None, num_breaks: int = 4, method: str = "quantile") -> Step:
    if method == "quantile":
        at = [i / num_breaks for i in range(num_breaks + 1)]
        learn = lambda df, cs: percentiles(df, {c: at for c in cs})
        wanted = None
    else:
        learn = None
        wanted = lambda cs: {c: F.array(F.min(c).cast("double"), F.max(c).cast("double")) for c in cs}

    def project(df, cs, k):
        new = {}
        for c in cs:
            if not k[c] or k[c][0] is None:  # nothing was there to learn from
                new[c] = F.lit(None).cast("string")
                continue
            edges = sorted(set(k[c])) if method == "quantile" else [k[c][0] + (k[c][1] - k[c][0]) * i / num_breaks for i in range(num_breaks + 1)]
            new[c] = _bins(c, edges, [f"bin_{i + 1}" for i in range(len(edges) - 1)])
        return _replace(df, new)

    return Step("discretize", columns, all_numeric(), wanted, learn, project)


def step_percentile(columns=None, num_breaks: int = 100, as_integer: bool = True) -> Step:
    """How many of the distinct percentile edges are not above the value, scaled to ``num_breaks``; null stays null."""
    at = [i / num_breaks for i in range(num_breaks + 1)]

    def project(df, cs, k):
        new = {}
        for c in cs:
            edges = sorted(set(k[c] or []))
            below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(c)))
            share = F.least(below / F.lit(len(edges) - 1.0) * num_breaks, F.lit(float(num_breaks))) if len(edges) > 1 else F.lit(0.0)
            new[c] = F.when(F.col(c).isNotNull(), share.cast("int") if as_integer else share)
        return _replace(df, new)

    return Step("percentile", columns, all_numeric(), None, lambda df, cs: percentiles(df, {c: at for c in cs}), project)


def step_cut(columns, breaks: list[float], labels: list[str] | None = None) -> Step:
    edges = sorted(breaks)
    names = labels if labels and len(labels) == len(edges) - 1 else [f"bin_{i + 1}" for i in range(len(edges) - 1)]
    return Step("cut", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {c: _bins(c, edges, names) for c in cs}))


def step_winsorizer(columns=None, fold: float = 1.5, tail: str = "both") -> Step:
    """Values beyond the quartiles by ``fold`` times their distance are set to that limit."""
    learn = lambda df, cs: percentiles(df, {c: [0.25, 0.75] for c in cs})

    def project(df, cs, k):
        new = {}
        for c in (c for c in cs if k[c]):
            q1, q3 = k[c]
            x = F.col(c).cast("double")
            if tail in ("right", "both"):
                x = F.least(x, F.lit(q3 + fold * (q3 - q1)))
            if tail in ("left", "both"):
                x = F.greatest(x, F.lit(q1 - fold * (q3 - q1)))
            new[c] = F.when(F.col(c).isNotNull(), x)
        return _replace(df, new)

    return Step("winsorizer", columns, all_numeric(), None, learn, project)


def step_outlier_trimmer(columns=None, fold: float = 1.5) -> Step:
    """Rows with a value beyond the winsorizer's limits go; a null lies beyond nothing."""
    learn = lambda df, cs: percentiles(df, {c: [0.25, 0.75] for c in cs})

    def project(df, cs, k):
        for c in (c for c in cs if k[c]):
            q1, q3 = k[c]
            df = df.where(F.col(c).isNull() | F.col(c).between(q1 - fold * (q3 - q1), q3 + fold * (q3 - q1)))
        return df

    return Step("outlier_trimmer", columns, all_numeric(), None, learn, project)


def step_log(columns=None, offset: float = 0.0) -> Step:
    return Step("log", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {c: F.log(F.col(c) + offset) for c in cs}))


def step_sqrt(columns=None) -> Step:
    return Step("sqrt", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {c: F.sqrt(c) for c in cs}))


def step_inverse(columns=None, offset: float = 0.0) -> Step:
    return Step("inverse", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {c: F.try_divide(F.lit(1.0), F.col(c) + offset) for c in cs}))


def step_poly(columns=None, degree: int = 2) -> Step:
    """Raw powers ``col_poly_2`` and up, beside the column."""
    return Step("poly", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {f"{c}_poly_{d}": F.pow(c, F.lit(d)) for c in cs for d in range(2, degree + 1)}))


def step_interact(columns=None, separator: str = "_x_") -> Step:
    return Step("interact", columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {f"{a}{separator}{b}": F.col(a) * F.col(b) for a, b in combinations(cs, 2)}))


def step_ratio(ratios: list[tuple[str, str]], offset: float = 1e-10, separator: str = "_per_") -> Step:
    return Step("ratio", [], None, None, None, lambda df, cs, k: _replace(df, {f"{a}{separator}{b}": F.col(a) / (F.col(b) + offset) for a, b in ratios}))


def step_mutate(**new) -> Step:
    """Columns from callables (DataFrame to Column), one after another."""

    def project(df, cs, k):
        for name, f in new.items():
            df = df.withColumn(name, f(df))
        return df

    return Step("mutate", [], None, None, None, project)


def step_rm(columns) -> Step:
    return Step("rm", columns, None, None, None, lambda df, cs, k: df.drop(*cs))


def step_select(columns) -> Step:
    return Step("select", columns, None, None, None, lambda df, cs, k: df.select(*cs))


def step_na_omit(columns=None) -> Step:
    def project(df, cs, k):
        df = df.dropna(subset=cs)
        for c in (c for c in cs if dict(df.dtypes)[c] in ("double", "float")):
            df = df.where(~F.isnan(c) & (F.abs(c) < float("inf")))
        return df

    return Step("na_omit", columns, None, None, None, project)


def _drop(k: dict, which) -> list[str]:
    return [c for c, v in k.items() if which(v)]


def step_zv(columns=None) -> Step:
    """Columns with one distinct value or none go."""
    return Step("zv", columns, all_numeric(), lambda cs: {c: F.min(c).eqNullSafe(F.max(c)) for c in cs}, None, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_filter_missing(columns=None, threshold: float = 0.5) -> Step:
    return Step("filter_missing", columns, None, lambda cs: {c: F.avg(F.col(c).isNull().cast("int")) for c in cs}, None, lambda df, cs, k: df.drop(*_drop(k, lambda v: v is not None and v > threshold)))


def step_nzv(columns=None, freq_cut: float = 19.0, unique_cut: float = 10.0) -> Step:
    """Columns dominated by one value, with few distinct ones, go; all-null ones too."""

    def learn(df, cs):
        # all columns' values are counted in one pass; a row a column comes back
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cs])).alias("e")).select("e.c", "e.v")
        counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        there = F.col("v").isNotNull()
        top = F.max(F.when(there, F.struct("n", "v"))).alias("top")
        first = counts.groupBy("c").agg(F.sum("n").alias("rows"), F.count("v").alias("distinct"), top)
        second = counts.join(F.broadcast(first.select("c", "top")), "c").where(there & (F.col("v") != F.col("top.v"))).groupBy("c").agg(F.max("n").alias("next"))
        known = {r["c"]: r for r in first.join(second, "c", "left").collect()}
        out = {}
        for c in cs:
            r = known.get(c)
            out[c] = r is None or r["top"] is None or (r["next"] is None or r["top"]["n"] / r["next"] > freq_cut) and 100 * r["distinct"] / r["rows"] < unique_cut
        return out

    return Step("nzv", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def correlation(df: DataFrame, cs: list[str]) -> np.ndarray:
    """The correlation matrix from one aggregate."""
    pairs = list(combinations(range(len(cs)), 2))
    row = df.agg(*[F.corr(cs[i], cs[j]).alias(f"{i}_{j}") for i, j in pairs]).first() if pairs else []
    r = np.eye(len(cs))
    for (i, j), v in zip(pairs, row, strict=True):
        r[i, j] = r[j, i] = np.nan if v is None else v
    return r


def step_select_corr(columns=None, threshold: float = 0.9) -> Step:
    """A column goes if any earlier one correlates with it beyond the threshold."""

    def learn(df, cs):
        r = np.abs(correlation(df, cs))
        return {c: bool((r[:i, i] > threshold).any()) for i, c in enumerate(cs)}

    return Step("select_corr", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*_drop(k, bool)))


def step_pca(columns=None, num_comp: int = 2, prefix: str = "PC", threshold: float | None = None) -> Step:
    """Principal components from one covariance aggregate; the largest loading of each is positive.

    With ``threshold``, as many as hold that share of the variance, whatever ``num_comp``.
    """

    def learn(df, cs):
        pairs = [(i, j) for i in range(len(cs)) for j in range(i, len(cs))]
        row = df.agg(*[F.avg(c) for c in cs], *[F.covar_samp(cs[i], cs[j]) for i, j in pairs]).first()
        cov = np.zeros((len(cs), len(cs)))
        for (i, j), v in zip(pairs, row[len(cs) :], strict=True):
            cov[i, j] = cov[j, i] = v
        val, vec = np.linalg.eigh(cov)
        n = num_comp if threshold is None else int(np.searchsorted(np.cumsum(val[::-1]) / val.sum(), threshold - 1e-12)) + 1
        vec = vec[:, ::-1][:, :n]
        vec *= np.sign(vec[np.abs(vec).argmax(0), range(vec.shape[1])])
        return {"mean": list(row[: len(cs)]), "load": vec.tolist()}

    def project(df, cs, k):
        new = {f"{prefix}{f + 1}": sum(((F.col(c) - m) * row[f] for c, m, row in zip(cs, k["mean"], k["load"], strict=True)), F.lit(0.0)) for f in range(len(k["load"][0]))}
        return df.withColumns(new).drop(*cs)

    return Step("pca", columns, all_numeric(), None, learn, project)
