"""Aggregates of a stream by windows of event time, late rows dropped beyond a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def summarize_stream(stream: DataFrame, ts: str, width: str, by: list[str], delay: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """``window_start``, ``window_end``, ``by`` and the aggregates; in append mode a window comes out once, when the watermark passes its end.

    Moments without a time zone count as UTC, as event time must be an
    instant, and so do the bounds that come out, in any session's time zone.
    """
    local = dict(stream.dtypes)[ts] == "timestamp_ntz"
    if local:
        stream = stream.withColumn(ts, F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(f"`{ts}`"))))
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    bound = lambda c: F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {_EPOCH})") if local else F.col(c)
    out = stream.withWatermark(ts, delay).groupBy(window.alias("w"), *by).agg(*[a.alias(k) for k, a in aggregates.items()])
    return out.select(bound("w.start").alias("window_start"), bound("w.end").alias("window_end"), *by, *aggregates)


def run_available(result: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What the stream gives for the input that is there now, appended to Parquet in the shared folder."""
    path = scratch(spark, name)
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
