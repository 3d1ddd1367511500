"""Metrics as aggregate columns, so that a set of them is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _e(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


METRICS = {
    "rmse": lambda y, p: F.sqrt(F.avg(_e(y, p) ** 2)),
    "mae": lambda y, p: F.avg(F.abs(_e(y, p))),
    "mape": lambda y, p: 100 * F.avg(F.abs(F.try_divide(_e(y, p), F.col(y)))),
    "smape": lambda y, p: 100 * F.avg(F.try_divide(F.abs(_e(y, p)), (F.abs(y) + F.abs(p)) / 2)),
    "mpe": lambda y, p: 100 * F.avg(F.try_divide(_e(y, p), F.col(y))),
    "msd": lambda y, p: F.avg(_e(y, p)),
    "rsq": lambda y, p: F.corr(y, p) ** 2,
    "r_squared": lambda y, p: 1 - F.sum(_e(y, p) ** 2) / (F.var_pop(y) * F.count(y)),
    "ccc": lambda y, p: 2 * F.covar_pop(y, p) / (F.var_pop(y) + F.var_pop(p) + (F.avg(y) - F.avg(p)) ** 2),
}


def metric_set(df: DataFrame, y: str, p: str, names: list[str], group: list[str] | None = None) -> DataFrame:
    """Rows (group, metric, value)."""
    wide = df.groupBy(*(group or [])).agg(*[METRICS[n](y, p).cast("double").alias(n) for n in names])
    return wide.unpivot(group or [], names, "metric", "value")


def confusion_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, precision, recall and f_meas of 0/1 columns."""
    n = lambda c: F.sum(c.cast("int"))
    s = df.agg(n((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"), n((F.col(y) == 0) & (F.col(p) == 1)).alias("fp"), n((F.col(y) == 1) & (F.col(p) == 0)).alias("fn"), F.avg((F.col(y) == F.col(p)).cast("int")).alias("accuracy"))
    s = s.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "f_meas": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
    return s.unpivot([], ["accuracy", "precision", "recall", "f_meas"], "metric", "value")


def durbin_watson(df: DataFrame, e: str, group: list[str], order: list[str]) -> DataFrame:
    d = F.col(e) - F.lag(e).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__d", d).groupBy(*group).agg((F.sum(F.col("__d") ** 2) / F.sum(F.col(e) ** 2)).alias("value"))


def mase(df: DataFrame, y: str, p: str, group: list[str], order: list[str], m: int = 1) -> DataFrame:
    """Mean absolute error over that of the value ``m`` steps before, per group."""
    back = F.abs(F.col(y) - F.lag(y, m).over(Window.partitionBy(*group).orderBy(*order)))
    return df.withColumn("__d", back).groupBy(*group).agg(F.try_divide(F.avg(F.abs(_e(y, p))), F.avg("__d")).alias("value"))


def mda(df: DataFrame, y: str, p: str, group: list[str], order: list[str]) -> DataFrame:
    """Share of steps whose value and prediction change in the same direction, per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.signum(F.col(y) - F.lag(y).over(w)) == F.signum(F.col(p) - F.lag(p).over(w))
    return df.withColumn("__d", same.cast("int")).groupBy(*group).agg(F.avg("__d").alias("value"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """The share of (1, 0) pairs that the score orders right, ties counting half.

    Rows are counted per score first, so that a cumulative sum over distinct
    scores is all that meets in one task.
    """
    by = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum((F.col(y) == 1).cast("double")).alias("__p"), F.sum((F.col(y) == 0).cast("double")).alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = F.sum(F.col("__p") * (F.col("__below") + F.col("__n") / 2))
    return by.withColumn("__below", below).agg(F.try_divide(won, F.sum("__p") * F.sum("__n")).alias("value"))


def ljung_box(df: DataFrame, e: str, group: list[str], order: list[str], lags: int = 5) -> DataFrame:
    """n (n + 2) times the sum over k of rho_k squared / (n - k), per group."""
    mean = F.avg(e).over(Window.partitionBy(*group))
    w = Window.partitionBy(*group).orderBy(*order)
    c = df.withColumn("__c", F.col(e) - mean)
    c = c.withColumns({f"__l{k}": F.col("__c") * F.lag("__c", k).over(w) for k in range(1, lags + 1)})
    sums = c.groupBy(*group).agg(F.count("__c").alias("__n"), F.sum(F.col("__c") ** 2).alias("__v"), *[F.sum(f"__l{k}").alias(f"__l{k}") for k in range(1, lags + 1)])
    rho = sum((F.try_divide(F.try_divide(F.col(f"__l{k}"), F.col("__v")) ** 2, (F.col("__n") - k).cast("double")) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select(*group, (F.col("__n") * (F.col("__n") + 2) * rho).alias("value"))
