"""Price oscillators and series transforms per group: windows where the rule is a window, one pass of pandas where it recurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def roc(df: DataFrame, col: str, group: list[str], order: list[str], k: int = 1) -> DataFrame:
    """x / x[t-k] - 1; null where that is 0 or missing."""
    return df.withColumn(f"{col}_roc_{k}", F.try_divide(F.col(col), F.lag(col, k).over(_order(group, order))) - 1)


def rsi(df: DataFrame, col: str, group: list[str], order: list[str], n: int = 14) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss) over the last n changes; 100 where no loss is, null until there are n."""
    w = _order(group, order)
    name = f"{col}_rsi_{n}"
    change = F.col(col) - F.lag(col).over(w)
    frame = w.rowsBetween(-(n - 1), 0)
    out = df.withColumn("__x", change)
    gain, loss = F.avg(F.greatest("__x", F.lit(0.0))).over(frame), F.avg(F.greatest(-F.col("__x"), F.lit(0.0))).over(frame)
    full = F.count("__x").over(frame) >= n
    return out.withColumn(name, F.when(full, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss))))).drop("__x")


def stochastic(df: DataFrame, high: str, low: str, close: str, group: list[str], order: list[str], k: int = 14, d: int = 3) -> DataFrame:
    """%K: where the close lies in the range of the last k rows; %D: its mean over d rows.  Null until full."""
    w = _order(group, order)
    frame = w.rowsBetween(-(k - 1), 0)
    bottom, top = F.min(low).over(frame), F.max(high).over(frame)
    at = F.when(F.row_number().over(w) >= k, 100 * F.try_divide(F.col(close) - bottom, top - bottom))
    out = df.withColumn(f"{close}_stoch_k_{k}", at)
    smooth = w.rowsBetween(-(d - 1), 0)
    name = f"{close}_stoch_k_{k}"
    return out.withColumn(f"{close}_stoch_d_{d}", F.when(F.count(name).over(smooth) >= d, F.avg(name).over(smooth)))


def bollinger(df: DataFrame, col: str, group: list[str], order: list[str], n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of the last n rows and ``width`` sample deviations to each side; null until full."""
    w = _order(group, order)
    frame, full = w.rowsBetween(-(n - 1), 0), F.row_number().over(w) >= n
    mid, sd = F.avg(col).over(frame), F.stddev_samp(col).over(frame)
    return df.withColumns({f"{col}_bband_{k}_{n}": F.when(full, mid + s * width * sd) for k, s in (("lower", -1), ("middle", 0), ("upper", 1))})


def per_series(df: DataFrame, group: list[str], order: list[str], added: str, run: Callable) -> DataFrame:
    """Columns ``added`` (a schema) that ``run`` derives from one series in order.

    A series must fit in a task, as recursions have no other form.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {added}"
    return df.groupBy(*group).applyInPandas(lambda pdf: run(pdf.sort_values(order)), schema)


def macd(df: DataFrame, col: str, group: list[str], order: list[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The fast less the slow exponential mean (spans, from the first value on), its own exponential mean and their difference."""
    name = f"{col}_macd_{fast}_{slow}_{signal}"

    def run(pdf):
        ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
        line = ema(pdf[col], fast) - ema(pdf[col], slow)
        mean = ema(line, signal)
        return pdf.assign(**{name: line, f"{name}_signal": mean, f"{name}_hist": line - mean})

    return per_series(df, group, order, f"`{name}` double, `{name}_signal` double, `{name}_hist` double", run)


def ppo(df: DataFrame, col: str, group: list[str], order: list[str], fast: int = 12, slow: int = 26) -> DataFrame:
    """The fast less the slow exponential mean, as a percentage of the slow."""
    name = f"{col}_ppo_{fast}_{slow}"

    def run(pdf):
        a, b = (pdf[col].ewm(span=n, adjust=False).mean() for n in (fast, slow))
        return pdf.assign(**{name: 100 * (a - b) / b.where(b != 0)})

    return per_series(df, group, order, f"`{name}` double", run)


def fractional_diff(df: DataFrame, col: str, d: float, group: list[str], order: list[str], cut: float = 1e-2) -> DataFrame:
    """The sum of w_k x[t-k], w_0 = 1, w_k = -w_(k-1) (d - k + 1) / k, down to weights of ``cut``; null until full."""
    w, weights, k = _order(group, order), [1.0], 1
    while abs(nxt := -weights[-1] * (d - k + 1) / k) >= cut:
        weights.append(nxt)
        k += 1
    return df.withColumn(f"{col}_fracdiff", sum((F.lag(col, i).over(w) * v for i, v in enumerate(weights) if i), F.col(col) * weights[0]))


def time_decay_weight(df: DataFrame, time: str, half_life: float, group: list[str]) -> DataFrame:
    """``weight``: 1 at the group's last day, half of that for each ``half_life`` days before."""
    age = F.datediff(F.max(time).over(Window.partitionBy(*group)).cast("date"), F.col(time).cast("date"))
    return df.withColumn("weight", F.pow(F.lit(0.5), age / half_life))


def detrend(df: DataFrame, col: str, group: list[str], order: list[str], method: str = "linear") -> DataFrame:
    """What a line through the group's rows in order (or their mean) leaves."""
    whole = Window.partitionBy(*group)
    if method == "constant":
        return df.withColumn(f"{col}_detrended", F.col(col) - F.avg(col).over(whole))
    out = df.withColumn("__t", F.row_number().over(_order(group, order)).cast("double"))
    line = F.regr_intercept(col, "__t").over(whole) + F.regr_slope(col, "__t").over(whole) * F.col("__t")
    return out.withColumn(f"{col}_detrended", F.col(col) - line).drop("__t")


def deseasonalize(df: DataFrame, col: str, group: list[str], order: list[str], period: int) -> DataFrame:
    """The value less its season: the mean, over rows of equal place in the period, of what a centred moving mean leaves, made to sum to 0."""
    w = _order(group, order)
    half = period // 2
    n = F.row_number().over(w)
    if period % 2:
        trend = F.avg(col).over(w.rowsBetween(-half, half))
    else:
        trend = (F.sum(col).over(w.rowsBetween(-half, half - 1)) + F.sum(col).over(w.rowsBetween(-half + 1, half))) / (2 * period)
    full = F.count(col).over(w.rowsBetween(-half, half)) == 2 * half + 1
    out = df.withColumns({"__s": (n - 1) % period, "__x": F.when(full, F.col(col) - trend)})
    season = out.withColumn("__m", F.avg("__x").over(Window.partitionBy(*group, "__s")))
    means = season.groupBy(*group, "__s").agg(F.first("__m").alias("__m")).groupBy(*group).agg(F.avg("__m").alias("__c"))
    return season.join(means, group).withColumn(f"{col}_deseasonalized", F.col(col) - F.coalesce(F.col("__m") - F.col("__c"), F.lit(0.0))).drop("__s", "__x", "__m", "__c")


def pad_by_time(df: DataFrame, time: str, unit: str, group: list[str]) -> DataFrame:
    """Every step of ``unit`` between a group's first and last time; other columns are null in added rows."""
    first, last = F.date_trunc(unit, F.min(time)), F.date_trunc(unit, F.max(time))
    spans = df.groupBy(*group).agg(F.sequence(first.cast("timestamp"), last.cast("timestamp"), F.expr(f"INTERVAL 1 {unit}")).alias("__at"))
    steps = spans.select(*group, F.explode("__at").alias("__at")).select(*group, F.col("__at").cast(df.schema[time].dataType).alias(time))
    return steps.join(df, [*group, time], "left")
