"""Class, probability and further numeric metrics: aggregates over rows or over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import METRICS


def _e(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def _huber(y: str, p: str, delta: float = 1.0) -> Column:
    a = F.abs(_e(y, p))
    return F.avg(F.when(a <= delta, a * a / 2).otherwise(delta * (a - delta / 2)))


def _iic(y: str, p: str) -> Column:
    """Correlation times the ratio of the lesser to the greater mean absolute error of either sign."""
    e = _e(y, p)
    n = F.count(e)
    low, high = F.coalesce(F.sum(F.when(e < 0, -e)), F.lit(0.0)) / n, F.coalesce(F.sum(F.when(e >= 0, e)), F.lit(0.0)) / n
    return F.corr(y, p) * F.try_divide(F.least(low, high), F.greatest(low, high))


_RMSE = METRICS["rmse"]
METRICS |= {
    "huber_loss": _huber,
    "huber_loss_pseudo": lambda y, p: F.avg(F.sqrt(1 + _e(y, p) ** 2) - 1),
    "iic": _iic,
    "rpd": lambda y, p: F.try_divide(F.stddev_samp(y), _RMSE(y, p)),
    "rpiq": lambda y, p: F.try_divide(F.percentile(y, F.lit(0.75)) - F.percentile(y, F.lit(0.25)), _RMSE(y, p)),
    "poisson_log_loss": lambda y, p: F.avg(F.col(p) - F.col(y) * F.log(p) + F.aggregate(F.sequence(F.lit(0), F.col(y).cast("int")), F.lit(0.0), lambda t, i: t + F.log(F.greatest(i, F.lit(1)).cast("double")))),
}

_d = F.try_divide
#: From counts a, b, c, d of true positives, false positives, false negatives, true negatives.
CLASS_METRICS = {
    "accuracy": lambda a, b, c, d: _d(a + d, a + b + c + d),
    "sens": lambda a, b, c, d: _d(a, a + c),
    "spec": lambda a, b, c, d: _d(d, b + d),
    "ppv": lambda a, b, c, d: _d(a, a + b),
    "npv": lambda a, b, c, d: _d(d, c + d),
    "bal_accuracy": lambda a, b, c, d: (_d(a, a + c) + _d(d, b + d)) / 2,
    "j_index": lambda a, b, c, d: _d(a, a + c) + _d(d, b + d) - 1,
    "detection_prevalence": lambda a, b, c, d: _d(a + b, a + b + c + d),
    "f_meas": lambda a, b, c, d: _d(2 * a, 2 * a + b + c),
    "kap": lambda a, b, c, d: _d(2 * (a * d - b * c), (a + b) * (b + d) + (a + c) * (c + d)),
    "mcc": lambda a, b, c, d: _d(a * d - b * c, F.sqrt((a + b) * (a + c) * (b + d) * (c + d))),
}


def _confusion(df: DataFrame, y: str, p: str, group: list[str]) -> DataFrame:
    n = lambda i, j: F.sum(((F.col(y) == i) & (F.col(p) == j)).cast("double"))
    return df.groupBy(*group).agg(n(1, 1).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(0, 0).alias("d"))


def class_metrics(df: DataFrame, y: str, p: str, names: list[str] | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows (group, metric, value) of 0/1 columns; null where a metric divides by 0."""
    names, group = names or list(CLASS_METRICS), group or []
    wide = _confusion(df, y, p, group).select(*group, *[CLASS_METRICS[n](*map(F.col, "abcd")).alias(n) for n in names])
    return wide.unpivot(group, names, "metric", "value")


def fairness(df: DataFrame, y: str, p: str, by: str) -> DataFrame:
    """Largest gap between groups of predicted share (demographic_parity), sensitivity (equal_opportunity), and of sensitivity or false positive rate (equalized_odds)."""
    by_group = _confusion(df, y, p, [by]).select(CLASS_METRICS["detection_prevalence"](*map(F.col, "abcd")).alias("s"), CLASS_METRICS["sens"](*map(F.col, "abcd")).alias("t"), CLASS_METRICS["spec"](*map(F.col, "abcd")).alias("u"))
    gap = lambda c: F.max(c) - F.min(c)
    wide = by_group.agg(gap("s").alias("demographic_parity"), gap("t").alias("equal_opportunity"), F.greatest(gap("t"), gap("u")).alias("equalized_odds"))
    return wide.unpivot([], wide.columns, "metric", "value")


def probability_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """mn_log_loss and brier_class of a 0/1 column and the chance of 1; chances are kept 2e-16 from 0 and 1 in the logarithm."""
    s = F.least(F.greatest(F.col(score), F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    wide = df.agg(F.avg(-F.log(F.when(F.col(y) == 1, s).otherwise(1 - s))).alias("mn_log_loss"), F.avg((F.col(y) - F.col(score)) ** 2).alias("brier_class"))
    return wide.unpivot([], wide.columns, "metric", "value")


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row a distinct score, from the highest: counts above or at it, sensitivity, specificity, precision, shares tested and found, lift.

    One row a distinct score meets in one task; round scores that are nearly all distinct.
    """
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    w, every = Window.orderBy(F.col("threshold").desc()), Window.partitionBy()
    at = at.select("threshold", F.sum("__p").over(w).alias("tp"), F.sum("__n").over(w).alias("n"), F.sum("__p").over(every).alias("__all"), F.sum("__n").over(every).alias("__rows"))
    fp = F.col("n") - F.col("tp")
    return at.withColumns({
        "sensitivity": F.try_divide("tp", "__all"), "specificity": 1 - F.try_divide(fp, F.col("__rows") - F.col("__all")), "precision": F.try_divide("tp", "n"),
        "percent_tested": 100 * F.col("n") / F.col("__rows"), "percent_found": 100 * F.try_divide("tp", "__all"), "lift": F.try_divide(F.col("tp") * F.col("__rows"), F.col("n") * F.col("__all")),
    }).drop("__all", "__rows")


def curve_areas(df: DataFrame, y: str, score: str) -> DataFrame:
    """average_precision, pr_auc (trapezes, from precision 1 at recall 0) and gain_capture."""
    w = Window.orderBy(F.col("threshold").desc())
    lag = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    c = curve(df, y, score).withColumns({"r0": lag("sensitivity", 0.0), "p0": lag("precision", 1.0), "t0": lag("percent_tested", 0.0), "f0": lag("percent_found", 0.0)})
    step = F.col("sensitivity") - F.col("r0")
    base = F.max(F.struct("n", F.try_divide("tp", "n").alias("share")))["share"]
    area = F.sum((F.col("percent_tested") - F.col("t0")) * (F.col("percent_found") + F.col("f0")) / 2) / 1e4
    wide = c.agg(F.sum(step * F.col("precision")).alias("average_precision"), F.sum(step * (F.col("precision") + F.col("p0")) / 2).alias("pr_auc"), F.try_divide(area - 0.5, (1 - base) / 2).alias("gain_capture"))
    return wide.unpivot([], wide.columns, "metric", "value")
