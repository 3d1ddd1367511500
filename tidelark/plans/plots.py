"""The data of plots as DataFrames, small enough to draw: no plotting library is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import collect_metrics, cost


def plot_forecast(actual: DataFrame, forecast: DataFrame, time: str, y: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Points (group, time, series, value): the actual series and the forecast one after the other; several groups are facets."""
    group = group or []
    one = actual.select(*group, time, F.lit("actual").alias("series"), F.col(y).cast("double").alias("value"))
    return one.unionByName(forecast.select(*group, time, F.lit("forecast").alias("series"), F.col(pred).cast("double").alias("value")))


def plot_residuals(df: DataFrame, y: str, fitted: str, bins: int = 30) -> DataFrame:
    """Bars of residuals: bin from 1, its middle and the rows in it, between the least and the largest residual."""
    e = df.select((F.col(y) - F.col(fitted)).alias("e")).where("e IS NOT NULL")
    ends = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("e") - F.col("lo")) / width) + 1, F.lit(bins))).otherwise(1).cast("int")
    counts = e.join(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    return counts.select("bin", (F.col("lo") + (F.col("bin") - 0.5) * width).alias("middle"), "n")


def plot_model_comparison(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Bars or cells (model, metric, mean, std_err, rank, relative): ``relative`` is the cost's place from 0 (best) to 1 (worst) among the models."""
    means = collect_metrics(results.where(F.col("metric").isin(metrics)), by)
    price = F.lit(None).cast("double")
    for m in metrics:
        price = F.when(F.col("metric") == m, cost(m, F.col("mean"))).otherwise(price)
    w = Window.partitionBy("metric")
    low, high = F.min("__cost").over(w), F.max("__cost").over(w)
    ranked = means.withColumn("__cost", price).withColumns({"rank": F.rank().over(w.orderBy(F.col("__cost").asc_nulls_last())), "relative": F.coalesce(F.try_divide(F.col("__cost") - low, high - low), F.lit(0.0))})
    return ranked.select(*by, "metric", "mean", "std_err", "rank", "relative")


def plot_tune_results(results: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """Points (parameter, value, mean, std_err) of a grid: the metric against each parameter, averaged over the others."""
    rows = results.where(F.col("metric") == metric)
    long = rows.select("value", F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("at")) for p in parameters])).alias("e"))
    out = long.groupBy("e.parameter", "e.at").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("std_err"))
    return out.withColumnRenamed("at", "value").select("parameter", "value", "mean", "std_err")
