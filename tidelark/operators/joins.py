"""Joins on order: the latest row before a moment, and moments within intervals, both over buckets of time so that a busy key spreads over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _free(name: str, *frames: DataFrame) -> str:
    while any(name in f.columns for f in frames):
        name = f"_{name}"
    return name


def _seconds(df: DataFrame, c: str) -> Column:
    """A moment as a double: seconds of dates and timestamps, numbers as they are."""
    moment = F.col(f"`{c}`")
    if dict(df.dtypes)[c] in ("date", "timestamp_ntz"):
        moment = moment.cast("timestamp")
    return moment.cast("double")


def _bucket(df: DataFrame, c: str, width: float) -> Column:
    return F.floor(_seconds(df, c) / F.lit(float(width))).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], width: float, tolerance: float | None = None) -> DataFrame:
    """``left`` with the other columns of the latest row of ``right`` at or before it, by equal ``by``; null where there is none.

    ``on`` is a moment in both (a timestamp counts in seconds), ``width`` that
    of a bucket and ``tolerance`` the greatest distance.  A window runs within
    one bucket of one key; what earlier buckets leave comes from a second
    window over a row a bucket, so no task needs all rows of a key.  Of rows
    of ``right`` at the same moment the greatest by its other columns counts.
    Null keys and moments match nothing; every row of ``left`` stays.
    """
    value, b, side, found, mine, last, before = (_free(n, left, right) for n in ("__value", "__bucket", "__right", "__found", "__row", "__last", "__before"))
    extra = [c for c in right.columns if c not in (on, *by)]
    if clash := [c for c in extra if c in left.columns]:
        raise ValueError(f"columns in both sides: {clash}")
    keys = [F.col(f"`{c}`") for c in by]
    held = F.struct(F.col(f"`{on}`").alias("moment"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(extra)])
    there = right.dropna(subset=[on, *by]).select(*keys, F.col(f"`{on}`"), held.alias(value))
    there = there.groupBy(*keys, F.col(f"`{on}`")).agg(F.max(value).alias(value)).withColumn(b, _bucket(right, on, width))
    carry = there.groupBy(*keys, b).agg(F.max(value).alias(last))
    whole = F.col(f"`{on}`").isNotNull()
    for k in keys:
        whole = whole & k.isNotNull()
    rows = left.where(whole).withColumn(b, _bucket(left, on, width))
    union = rows.select(*keys, F.col(f"`{on}`"), b, F.lit(1).alias(side), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(mine), F.lit(None).cast(there.schema[value].dataType).alias(value)).unionByName(
        there.select(*keys, F.col(f"`{on}`"), b, F.lit(0).alias(side), F.lit(None).cast(left.schema).alias(mine), value)
    )
    inside = union.withColumn(found, F.last(value, True).over(Window.partitionBy(*by, b).orderBy(on, side))).where(F.col(side) == 1)
    # the last row of earlier buckets, for every bucket that a row of the left needs
    needed = rows.select(*keys, b).distinct().withColumn(last, F.lit(None).cast(carry.schema[last].dataType)).withColumn(side, F.lit(0))
    steps = needed.unionByName(carry.withColumn(side, F.lit(1)))
    earlier = steps.withColumn(before, F.last(last, True).over(Window.partitionBy(*by).orderBy(b, side).rowsBetween(Window.unboundedPreceding, -1))).where(F.col(side) == 0).drop(side, last)
    joined = inside.join(earlier, [*by, b], "left").withColumn(found, F.coalesce(found, before))
    near = F.lit(True)
    if tolerance is not None:
        at = F.col(f"{found}.moment")
        at = at.cast("timestamp").cast("double") if dict(right.dtypes)[on] in ("date", "timestamp_ntz") else at.cast("double")
        near = _seconds(left, on) - at <= tolerance
    out = joined.select(*[F.col(f"{mine}.`{c}`") for c in left.columns], *[F.when(near, F.col(f"{found}.v{i}")).alias(c) for i, c in enumerate(extra)])
    rest = left.where(~whole).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
    return out.unionByName(rest)


def interval_join(points: DataFrame, intervals: DataFrame, on: str, start: str, end: str, by: list[str], width: float) -> DataFrame:
    """Pairs of a point and an interval of the same ``by`` with start <= point < end.

    An interval is sent to each bucket of ``width`` that it meets and a point
    to its own, so ``width`` should be about the usual length of an interval:
    a long one is copied length / width times, a short width does not change
    the result.  Empty intervals and nulls match nothing.
    """
    b = _free("__bucket", points, intervals)
    if clash := [c for c in intervals.columns if c in points.columns and c not in by]:
        raise ValueError(f"columns in both sides: {clash}")
    full = intervals.where(F.col(f"`{start}`") < F.col(f"`{end}`"))
    spread = full.withColumn(b, F.explode(F.sequence(_bucket(intervals, start, width), _bucket(intervals, end, width))))
    pairs = points.withColumn(b, _bucket(points, on, width)).join(spread, [*by, b])
    return pairs.where((F.col(f"`{on}`") >= F.col(f"`{start}`")) & (F.col(f"`{on}`") < F.col(f"`{end}`"))).drop(b)
