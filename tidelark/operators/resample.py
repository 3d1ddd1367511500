"""Splits and folds as columns of one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "__r") -> DataFrame:
    """Rows numbered from 1 in ``order``, per group if given; ``order[0]`` is a time.

    Without groups, rows are numbered within their day and the days' counts
    summed up, so that only one row a day meets in one task.
    """
    if group:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    day = F.to_date(order[0])
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = df.groupBy(day.alias("__d")).agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", before).drop("__c").withColumnRenamed("__d", "__e")
    within = F.row_number().over(Window.partitionBy("__d").orderBy(*order))
    numbered = df.withColumn("__d", day).withColumn("__w", within)
    return numbered.join(days, F.col("__d").eqNullSafe(F.col("__e"))).withColumn(name, F.col("__before") + F.col("__w")).drop("__d", "__e", "__w", "__before")


def initial_time_split(df: DataFrame, order: list[str], prop: float = 0.75, lag: int = 0) -> DataFrame:
    """``split``: train for the first int(n * prop) rows, none for the next ``lag``, then test; ``order[0]`` is a time."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * prop)
    split = F.when(F.col("__r") <= cut, "train").when(F.col("__r") <= cut + lag, "none").otherwise("test")
    return position(df, order).join(F.broadcast(n)).withColumn("split", split).drop("__n", "__r")  # n is one row


def mixed_key(df: DataFrame, key: str, seed: int) -> Column:
    """A number below 1,000,003 for each value of a key of any type, the same in every run.

    Integers are reduced before they are multiplied, so none overflows; other
    types go by the digest of their text; null is a value too.
    """
    x = F.col(key)
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        whole = F.pmod(F.coalesce(x, F.lit(0)).cast("long"), F.lit(1000003))
    else:
        whole = F.pmod(F.conv(F.substring(F.md5(F.coalesce(x.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(1000003))
    return F.pmod(whole * 7919 + F.lit(seed % 1000003).cast("long"), F.lit(1000003))


def vfold_cv(df: DataFrame, key: str, v: int = 10, seed: int = 1, strata: str | None = None, repeats: int = 1) -> DataFrame:
    """``fold`` 1 to v by arithmetic on a key, without a shuffle; with ``strata``, dealt in turn within each.

    With ``repeats``, every row so often, with ``repeat`` from 1 and other folds in each.
    """
    if repeats > 1:
        each = [vfold_cv(df, key, v, seed + 104729 * i, strata).withColumn("repeat", F.lit(i + 1)) for i in range(repeats)]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out
    mixed = mixed_key(df, key, seed)
    if strata:
        mixed = F.row_number().over(Window.partitionBy(strata).orderBy(mixed, key)) - 1
    return df.withColumn("fold", (mixed % v + 1).cast("int"))


def time_series_cv(n: int, initial: int, assess: int, skip: int = 0, lag: int = 0, cumulative: bool = True, slice_limit: int | None = None) -> list[tuple[int, int, int, int]]:
    """Positions [train from, to), [test from, to) of each fold."""
    out, end = [], initial
    while end + lag + assess <= n and (slice_limit is None or len(out) < slice_limit):
        out.append((0 if cumulative else end - initial, end, end + lag, end + lag + assess))
        end += assess + skip
    if not out:
        raise ValueError("not enough rows for a fold")
    return out


def time_series_folds(df: DataFrame, order: list[str], initial: int, assess: int, skip: int = 0, lag: int = 0, cumulative: bool = True, slice_limit: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Each row as often as folds use it, with ``fold`` (from 1) and ``role`` (train or test).

    The folds of a row come from its position by arithmetic, so there is no
    join with a table of folds.  With ``group``, each group has its own folds,
    and one too short has none.
    """
    rows = position(df, order, group)
    if group:
        rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    else:
        rows = rows.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))
    stride = assess + skip
    folds = F.floor((F.col("__n") - initial - lag - assess) / stride) + 1
    if slice_limit is not None:
        folds = F.least(folds, F.lit(slice_limit))
    k, r = F.col("fold") - 1, F.col("__r") - 1
    end = initial + k * stride
    start = F.lit(0) if cumulative else k * stride
    role = F.when((r >= start) & (r < end), "train").when((r >= end + lag) & (r < end + lag + assess), "test")
    spread = rows.withColumn("fold", F.explode(F.when(folds >= 1, F.sequence(F.lit(1), folds.cast("int")))))
    return spread.withColumn("role", role).where("role IS NOT NULL").drop("__r", "__n")
