"""Results of models over folds, long tables (wflow_id, fold, metric, value), and the choices made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which way each metric is better.
LESS = ("rmse", "mae", "mape", "smape", "mase", "rse", "log_loss", "mn_log_loss", "brier_score", "brier_class", "huber_loss", "huber_loss_pseudo", "poisson_log_loss", "classification_cost", "ranked_prob_score")
MORE = ("r_squared", "rsq", "rsq_trad", "adj_r_squared", "ccc", "iic", "rpd", "rpiq", "mda", "accuracy", "bal_accuracy", "precision", "recall", "sens", "spec", "ppv", "npv", "f_meas", "j_index", "kap", "mcc", "roc_auc", "roc_aunp", "roc_aunu", "pr_auc", "average_precision", "gain_capture")
NEAR_ZERO = ("msd", "mpe")


def cost(metric: str, value: Column) -> Column:
    """A number that is the smaller the better the metric's value is."""
    if metric in LESS:
        return value
    if metric in MORE:
        return -value
    if metric in NEAR_ZERO:
        return F.abs(value)
    raise ValueError(f"unknown metric {metric!r}: whether more or less of it is better must be stated")


def collect_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """mean, std (sample), n and std_err over folds."""
    out = results.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    return out.withColumn("std_err", F.col("std") / F.sqrt("n"))


def rank_results(results: DataFrame, by: list[str], metric: str, n: int | None = None) -> DataFrame:
    """The models in order of their mean ``metric``, best first, with ``rank``; of equal ones the smaller id."""
    means = collect_metrics(results.where(F.col("metric") == metric), by).withColumn("rank", F.row_number().over(Window.orderBy(cost(metric, F.col("mean")).asc_nulls_last(), *by)))
    return means if n is None else means.where(F.col("rank") <= n)


def select_by_one_std_err(results: DataFrame, by: list[str], metric: str, simplest: list[str]) -> DataFrame:
    """Of the models within one standard error of the best, the first in the order ``simplest``."""
    means = collect_metrics(results.where(F.col("metric") == metric), by)
    best = means.orderBy(cost(metric, F.col("mean")).asc_nulls_last(), *by).limit(1).select((cost(metric, F.col("mean")) + F.coalesce("std_err", F.lit(0.0))).alias("__limit"))
    return means.join(F.broadcast(best)).where(cost(metric, F.col("mean")) <= F.col("__limit")).drop("__limit").orderBy(*simplest, *by).limit(1)  # best is one row


def select_by_pct_loss(results: DataFrame, by: list[str], metric: str, simplest: list[str], limit: float = 2.0) -> DataFrame:
    """Of the models whose mean is at most ``limit`` percent worse than the best, with ``loss`` in percent, the first in the order ``simplest``."""
    means = collect_metrics(results.where(F.col("metric") == metric), by)
    best = means.agg(F.min(cost(metric, F.col("mean"))).alias("__best"))
    loss = F.try_divide(cost(metric, F.col("mean")) - F.col("__best"), F.abs("__best")) * 100
    return means.join(F.broadcast(best)).withColumn("loss", loss).where(F.col("loss") <= limit).drop("__best").orderBy(*simplest, *by).limit(1)  # best is one row


def compare_train_cv(train: DataFrame, cv: DataFrame, by: list[str]) -> DataFrame:
    """rmse and r_squared of training and folds side by side, their ratio and drop, and a label; best rmse_cv first.

    The label is a choice: good where the ratio is below 1.1, then moderate_overfit below 1.5, then overfit.
    """

    def wide(df, suffix):
        return df.where(F.col("metric").isin("rmse", "r_squared")).groupBy(*by).pivot("metric", ["rmse", "r_squared"]).agg(F.avg("value")).withColumnsRenamed({m: f"{m}_{suffix}" for m in ("rmse", "r_squared")})

    both = wide(train, "train").join(wide(cv, "cv"), by)
    ratio = F.try_divide("rmse_cv", "rmse_train")
    both = both.withColumns({"rmse_overfit_ratio": ratio, "r_squared_generalization_drop": F.col("r_squared_train") - F.col("r_squared_cv")})
    return both.withColumn("fit_quality", F.when(F.col("rmse_overfit_ratio") < 1.1, "good").when(F.col("rmse_overfit_ratio") < 1.5, "moderate_overfit").otherwise("overfit"))
