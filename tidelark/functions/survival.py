"""Metrics of censored times: weights by the inverse chance of not being censored, from one count a distinct time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def censoring(df: DataFrame, time: str, event: str) -> DataFrame:
    """``time``, ``n`` at risk, ``censored`` then and ``g``, the Kaplan-Meier chance of being uncensored beyond it.

    A row a distinct time meets in one window.
    """
    counts = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n_at"), F.sum((F.col(event) == 0).cast("long")).alias("censored"))
    w = Window.orderBy("time")
    after = F.sum("n_at").over(Window.orderBy(F.col("time").desc()))
    at = counts.withColumn("n", after)
    # events come before censorings at the same time
    risk = at.withColumn("n", F.col("n") - (F.col("n_at") - F.col("censored")))
    chance = F.when(F.col("censored") >= F.col("n"), F.when(F.col("n") > 0, 0.0).otherwise(1.0)).otherwise(1 - F.col("censored") / F.col("n"))
    logs = F.when(chance > 0, F.log(chance)).otherwise(float("-inf"))
    return risk.withColumn("g", F.exp(F.sum(logs).over(w))).select("time", "n", "censored", "g")


def _weighted(df: DataFrame, time: str, event: str, at: float) -> tuple[DataFrame, Column, Column, Column]:
    """Rows with the chance just before their own time, that at ``at``, and whether they are cases or controls there."""
    km = censoring(df, time, event)
    before = km.withColumn("__g", F.coalesce(F.lag("g").over(Window.orderBy("time")), F.lit(1.0))).select(F.col("time").alias("__t"), "__g")
    end = km.where(F.col("time") <= at).agg(F.coalesce(F.min("g"), F.lit(1.0)).alias("__end"))
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).join(before, F.col(time) == F.col("__t"), "left").join(F.broadcast(end))  # one row
    case, control = (F.col(time) <= at) & (F.col(event) == 1), F.col(time) > at
    weight = F.when(case, F.try_divide(F.lit(1.0), F.col("__g"))).when(control, F.try_divide(F.lit(1.0), F.col("__end"))).otherwise(0.0)
    return rows, case, control, weight


def brier_survival(df: DataFrame, time: str, event: str, estimates: dict[float, str]) -> DataFrame:
    """``eval_time`` and ``value``: weighted squares of (alive - estimated chance to be alive) over all rows, for each time's column of chances."""
    out = None
    for at, column in estimates.items():
        rows, case, control, weight = _weighted(df, time, event, at)
        s = F.col(column).cast("double")
        loss = F.when(case, s * s).when(control, (1 - s) * (1 - s)).otherwise(0.0)
        one = rows.agg(F.lit(float(at)).alias("eval_time"), F.avg(weight * loss).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def brier_survival_integrated(scores: DataFrame) -> DataFrame:
    """The trapezoid area under ``brier_survival`` over its times, divided by the last of them."""
    w = Window.orderBy("eval_time")  # a row an evaluation time
    area = (F.col("eval_time") - F.lag("eval_time").over(w)) * (F.col("value") + F.lag("value").over(w)) / 2
    return scores.withColumn("__a", area).agg((F.sum("__a") / F.max("eval_time")).alias("value"))


def roc_curve_survival(df: DataFrame, time: str, event: str, estimate: str, at: float) -> DataFrame:
    """``threshold``, ``sensitivity`` and ``specificity`` at ``at``, the estimated chance to be alive the score; a row a distinct chance meets in one window."""
    rows, case, control, weight = _weighted(df, time, event, at)
    sums = rows.groupBy(F.col(estimate).alias("threshold")).agg(F.sum(F.when(case, weight).otherwise(0.0)).alias("p"), F.sum(F.when(control, weight).otherwise(0.0)).alias("n"))
    w = Window.orderBy("threshold")
    total = lambda c: F.sum(c).over(Window.partitionBy())
    return sums.select("threshold", F.try_divide(F.sum("p").over(w), total("p")).alias("sensitivity"), (1 - F.try_divide(F.sum("n").over(w), total("n"))).alias("specificity"))


def roc_auc_survival(df: DataFrame, time: str, event: str, estimate: str, at: float) -> DataFrame:
    """``value``: the trapezoid area under ``roc_curve_survival``."""
    curve = roc_curve_survival(df, time, event, estimate, at)
    w = Window.orderBy("threshold")
    before = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    area = (before("specificity", 1.0) - F.col("specificity")) * (F.col("sensitivity") + before("sensitivity", 0.0)) / 2
    return curve.withColumn("__a", area).agg(F.sum("__a").alias("value"))
