"""User functions over windows, the analytic signal, calendars of working days."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.recipe import Step
from .steps import step_zv


def rolling_apply(df: DataFrame, col: str, n: int, f: Callable[[np.ndarray], float], group: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """``<col>_rolling_apply_<n>``: ``f`` of the last ``n`` values; null until there are n.

    The window's values are gathered on the JVM side, so a series may fill any
    number of tasks' memory but one window; ``f`` runs on Arrow batches.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return _applied(df, F.collect_list(F.struct(F.col(col).cast("double").alias("v"))).over(w), lambda x: f(x) if len(x) == n else None, name or f"{col}_rolling_apply_{n}")


def expanding_apply(df: DataFrame, col: str, f: Callable[[np.ndarray], float], group: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """``<col>_expanding_apply``: ``f`` of all values so far; its cost is quadratic in a series' length."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _applied(df, F.collect_list(F.struct(F.col(col).cast("double").alias("v"))).over(w), f, name or f"{col}_expanding_apply")


def _applied(df: DataFrame, values, f, name: str) -> DataFrame:
    @F.pandas_udf("double")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([f(np.array(x, float)) for x in lists], dtype="float64")

    return df.withColumn("__window", F.transform(values, lambda s: s["v"])).withColumn(name, run("__window")).drop("__window")


def hilbert(df: DataFrame, col: str, group: list[str], order: list[str]) -> DataFrame:
    """``<col>_hilbert_real`` and ``_imag``: the analytic signal of each series, by a Fourier transform of the whole series in one task."""
    key = [*group, *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key, col).schema.fields) + f", `{col}_hilbert_real` double, `{col}_hilbert_imag` double"

    def run(pdf):
        pdf = pdf.sort_values(order)
        x = pdf[col].to_numpy(float)
        n = len(x)
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0 and n:
            h[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * h)
        return pdf.assign(**{f"{col}_hilbert_real": z.real, f"{col}_hilbert_imag": z.imag})

    return df.select(*key, col).groupBy(*group).applyInPandas(run, schema)


def weekday_sequence(spark: SparkSession, start: str, end: str, holidays: list[str] | None = None) -> DataFrame:
    """``date``: the days from start to end but Saturdays, Sundays and holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    free = F.dayofweek("date").isin(1, 7)
    if holidays:
        free = free | F.col("date").cast("string").isin(holidays)
    return days.where(~free)


def drop_zero_variance(df: DataFrame) -> DataFrame:
    """``df`` without numeric columns of one value or none."""
    step: Step = step_zv()
    return step.prep(df).bake(df)
