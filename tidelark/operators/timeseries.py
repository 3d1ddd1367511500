"""Time-series operators: windows with an explicit group, time and tiebreaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def lag(df: DataFrame, cols: list[str], lags: list[int], group: list[str], order: list[str]) -> DataFrame:
    w = _order(group, order)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def lead(df: DataFrame, cols: list[str], leads: list[int], group: list[str], order: list[str]) -> DataFrame:
    w = _order(group, order)
    return df.withColumns({f"{c}_lead_{k}": F.lead(c, k).over(w) for c in cols for k in leads})


def diff(df: DataFrame, cols: list[str], group: list[str], order: list[str], k: int = 1, differences: int = 1) -> DataFrame:
    """x - lag(x, k), ``differences`` times."""
    w = _order(group, order)
    suffix = f"_diff_{k}" + (f"_order_{differences}" if differences > 1 else "")
    for c in cols:
        df = df.withColumn(f"{c}{suffix}", F.col(c))
        for _ in range(differences):
            df = df.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}") - F.lag(f"{c}{suffix}", k).over(w))
    return df


def pct_change(df: DataFrame, cols: list[str], group: list[str], order: list[str], k: int = 1) -> DataFrame:
    w = _order(group, order)
    return df.withColumns({f"{c}_pctdiff_{k}": F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1 for c in cols})


def rolling(df: DataFrame, cols: list[str], n: int, group: list[str], order: list[str], functions=("mean", "stddev_samp", "min", "max", "sum")) -> DataFrame:
    """Null until the window is full."""
    w = _order(group, order)
    full = F.row_number().over(w) >= n
    frame = w.rowsBetween(-(n - 1), 0)
    return df.withColumns({f"{c}_rolling_{f}_{n}": F.when(full, getattr(F, f)(c).over(frame)) for c in cols for f in functions})


def expanding(df: DataFrame, cols: list[str], group: list[str], order: list[str], functions=("mean", "min", "max", "sum")) -> DataFrame:
    frame = _order(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_expanding_{f}": getattr(F, f)(c).over(frame) for c in cols for f in functions})


def drawdown(df: DataFrame, col: str, group: list[str], order: list[str]) -> DataFrame:
    peak = F.max(col).over(_order(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({f"{col}_peak": peak, f"{col}_drawdown": F.col(col) - peak, f"{col}_drawdown_pct": F.try_divide(F.col(col), peak) - 1})


def fourier(df: DataFrame, time: str, period: float, order: int) -> DataFrame:
    """sin and cos of 2 pi k t / period, t in days since 1970."""
    days = F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date"))
    new = {f"{time}_{f}_{k}_{period:g}": getattr(F, f)(2 * F.pi() * k * days / period) for k in range(1, order + 1) for f in ("sin", "cos")}
    return df.withColumns(new)


def signature(df: DataFrame, time: str) -> DataFrame:
    t = F.col(time)
    parts: dict[str, Column] = {"year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "day": F.dayofmonth(t), "yday": F.dayofyear(t), "week": F.weekofyear(t), "wday": F.dayofweek(t), "half": F.when(F.month(t) <= 6, 1).otherwise(2)}
    return df.withColumns({f"{time}_{k}": c.cast("int") for k, c in parts.items()})


def summarize_by_time(df: DataFrame, time: str, unit: str, group: list[str], **named: Column) -> DataFrame:
    return df.groupBy(*group, F.date_trunc(unit, F.col(time).cast("timestamp")).cast("timestamp_ntz").alias(time)).agg(*[c.alias(k) for k, c in named.items()])


def ewm_mean(df: DataFrame, col: str, alpha: float, group: list[str], order: list[str]) -> DataFrame:
    """The recursion m = alpha x + (1 - alpha) m, from the first value on, per series."""
    name = f"{col}_ewm_mean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` double"

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(**{name: pdf[col].ewm(alpha=alpha, adjust=False).mean()})

    return df.groupBy(*group).applyInPandas(run, schema)
