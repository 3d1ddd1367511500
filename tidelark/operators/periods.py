"""Periods and dates as texts, splits by explicit ranges, and folds of periods."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of the units; a month counts 30 and a year 365.
DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}


def parse_period(period: str | int | timedelta) -> timedelta | int:
    """``"3 months"`` as a time span; an integer is a number of rows and stays one."""
    if isinstance(period, (int, timedelta)):
        return period
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]+?)s?\s*", period.lower())
    if not m or m[2] not in DAYS:
        raise ValueError(f"not a period: {period!r}")
    return timedelta(days=float(m[1]) * DAYS[m[2]])


def parse_date(spec: str | datetime, first: datetime, last: datetime) -> datetime:
    """A date; ``"start"`` and ``"end"``, with ``+`` or ``-`` and a period, count from the ends of the data."""
    if isinstance(spec, datetime):
        return spec
    m = re.fullmatch(r"\s*(start|end)\s*(?:([+-])\s*(.+))?", spec)
    if not m:
        return datetime.fromisoformat(spec.strip())
    at = first if m[1] == "start" else last
    step = parse_period(m[3]) if m[3] else timedelta(0)
    if not isinstance(step, timedelta):
        raise ValueError(f"not a period: {m[3]!r}")
    return at - step if m[2] == "-" else at + step


def split_by_ranges(df: DataFrame, time: str, train: tuple, test: tuple) -> DataFrame:
    """``split``: train or test by two closed ranges of dates; rows in neither go.

    Raises where the ranges overlap or one begins behind its end.
    """
    kind = df.schema[time].dataType
    ends = df.agg(F.min(time).cast("timestamp_ntz").alias("a"), F.max(time).cast("timestamp_ntz").alias("b")).first()
    (a, b), (c, d) = [[parse_date(s, ends["a"], ends["b"]) for s in pair] for pair in (train, test)]
    if a > b or c > d:
        raise ValueError("a range begins behind its end")
    if c <= b:
        raise ValueError("the test range must begin behind the training range")
    lit = lambda x: F.lit(x.isoformat(sep=" ")).cast(kind)
    at = F.col(time)
    split = F.when((at >= lit(a)) & (at <= lit(b)), "train").when((at >= lit(c)) & (at <= lit(d)), "test")
    return df.withColumn("split", split).where("split IS NOT NULL")


def training(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train").drop("split")


def testing(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test").drop("split")


def analysis(df: DataFrame, fold: int) -> DataFrame:
    return df.where((F.col("fold") == fold) & (F.col("role") == "train")).drop("fold", "role")


def assessment(df: DataFrame, fold: int) -> DataFrame:
    return df.where((F.col("fold") == fold) & (F.col("role") == "test")).drop("fold", "role")


def period_folds(df: DataFrame, time: str, initial: str, assess: str, skip: str = "0 days", lag: str = "0 days", cumulative: bool = True) -> DataFrame:
    """Each row as often as folds use it, with ``fold`` from 1 and ``role``; all lengths are periods from the first time on.

    The folds of a row come from its time by arithmetic: no window, no shuffle.
    A fold whose test period reaches beyond the last time is not made; raises if none is.
    """
    n, a, s, g = (parse_period(p) / timedelta(seconds=1) for p in (initial, assess, skip, lag))
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    first, last = df.agg(F.min(seconds), F.max(seconds)).first()
    stride = a + s
    folds = 0 if first is None else int((last - first - n - g - a) // stride) + 1
    if folds < 1:
        raise ValueError("not enough time for a fold")
    at, k = seconds - first, F.col("fold") - 1
    spread = df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    end = n + k * stride
    start = F.lit(0.0) if cumulative else k * stride
    role = F.when((at >= start) & (at < end), "train").when((at >= end + g) & (at < end + g + a), "test")
    return spread.withColumn("role", role).where("role IS NOT NULL")
