"""Models with a closed form, fitted by aggregates: one shuffle for all groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gram(x: list[str], y: str) -> list[Column]:
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    return [F.sum(terms[i] * terms[j]).alias(f"g_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]


def linear_reg(df: DataFrame, y: str, x: list[str], group: list[str] | None = None, penalty: float = 0.0) -> DataFrame:
    """Coefficients per group by normal equations; ``penalty`` is ridge on all but the intercept.

    Groups come back as one small row each and are solved where they are.
    """
    group = group or []
    p = len(x) + 1
    rows = df.dropna(subset=[y, *x]).groupBy(*group).agg(*_gram(x, y))
    names = ["Intercept", *x]
    schema = ", ".join([f"`{g}` {dict(df.dtypes)[g]}" for g in group] + ["variable string", "coefficient double"])

    def solve(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
                beta = np.linalg.lstsq(g[:p, :p] + penalty * np.diag([0.0] + [1.0] * (p - 1)), g[:p, p], rcond=None)[0]
                out = type(pdf)({"variable": names, "coefficient": beta})
                for k in group[::-1]:
                    out.insert(0, k, r[k])
                yield out

    return rows.mapInPandas(solve, schema)


def null_model(df: DataFrame, y: str, group: list[str], strategy: str = "mean", time: list[str] | None = None) -> DataFrame:
    fitted = {"mean": lambda: F.avg(y), "median": lambda: F.median(y), "last": lambda: F.max_by(y, F.struct(*time))}[strategy]()
    return df.groupBy(*group).agg(fitted.alias(".pred"))


def naive_reg(df: DataFrame, y: str, group: list[str], order: list[str], strategy: str = "naive", period: int = 1, window: int = 7) -> DataFrame:
    """Fitted values: y[t-1], y[t-period], drift or mean of the previous ``window``; the first is the value itself."""
    w = Window.partitionBy(*group).orderBy(*order)
    if strategy == "window":
        fitted = F.avg(y).over(w.rowsBetween(-window, -1))
    elif strategy == "drift":
        n = F.row_number().over(w)
        slope = F.try_divide(F.lag(y).over(w) - F.first(y).over(w), F.nullif(n - 2, F.lit(0)))
        fitted = F.lag(y).over(w) + F.coalesce(slope, F.lit(0.0))
    else:
        fitted = F.lag(y, period if strategy == "seasonal_naive" else 1).over(w)
    return df.withColumn("fitted", F.coalesce(fitted, F.col(y)))


def manual_reg(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    return df.withColumn(".pred", sum((F.col(c) * b for c, b in coefficients.items()), F.lit(intercept)))
