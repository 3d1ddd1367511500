"""Row and calendar operators: filters, samples, slices, one-hot, holidays, harmonics, future frames, anomalies, series features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric
from .resample import mixed_key
from .steps import step_dummy

#: Seconds of the time units that are of one length.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}

#: Holidays of fixed date, as (month, day).
HOLIDAYS = {"NewYear": (1, 1), "IndependenceDay": (7, 4), "Christmas": (12, 25)}


def step_filter(condition: str | Column) -> Step:
    """Rows that meet the condition stay; the scan sees it."""
    return Step("filter", project=lambda df, cs, k: df.where(condition))


def step_arrange(*order) -> Step:
    return Step("arrange", project=lambda df, cs, k: df.orderBy(*order))


def step_slice(key: list[str], rows: int) -> Step:
    """The first ``rows`` rows in the order of ``key``: a top-k, not a sort."""
    return Step("slice", project=lambda df, cs, k: df.orderBy(*key).limit(rows))


def step_sample(key: str, share: float, seed: int = 1) -> Step:
    """Rows whose mixed ``key`` falls in ``share`` of a million: repeatable, no shuffle."""
    return Step("sample", project=lambda df, cs, k: df.where(mixed_key(df, key, seed) < int(share * 1000003)))


def step_shuffle(key: str, seed: int = 1) -> Step:
    """Rows in an order that depends on ``key`` and ``seed`` alone."""
    return Step("shuffle", project=lambda df, cs, k: df.orderBy(mixed_key(df, key, seed), key))


def step_one_hot(columns=None) -> Step:
    """A 0/1 column for every level."""
    return step_dummy(columns if columns is not None else all_nominal(), one_hot=True)


def step_bin(columns=None, bins: int = 10) -> Step:
    """The number, from 1, of the equally wide bin between minimum and maximum; values beyond take the end bins."""

    def aggregates(cs):
        return {f"{f}_{c}": a(c) for c in cs for f, a in (("lo", F.min), ("hi", F.max))}

    def project(df, cs, k):
        new = {}
        for c in cs:
            lo, hi = k[f"lo_{c}"], k[f"hi_{c}"]
            if lo is None or lo == hi:
                new[c] = F.when(F.col(c).isNotNull(), F.lit(1))
            else:
                new[c] = F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * bins) + 1, F.lit(1)), F.lit(bins)).cast("int")
        return df.withColumns(new)

    return Step("bin", columns, all_numeric(), aggregates, None, project)


def step_holiday(time: str, holidays: dict[str, tuple[int, int]] | None = None) -> Step:
    """``<time>_<holiday>`` 0/1 for holidays of fixed date."""

    def project(df, cs, k):
        return df.withColumns({f"{time}_{n}": ((F.month(time) == m) & (F.dayofmonth(time) == d)).cast("int") for n, (m, d) in (holidays or HOLIDAYS).items()})

    return Step("holiday", project=project)


def step_harmonic(column: str, frequency: float, cycle_size: float, order: int = 1) -> Step:
    """``<c>_sin_i`` and ``<c>_cos_i`` of 2 pi i frequency x / cycle_size."""

    def project(df, cs, k):
        at = lambda i: F.col(column).cast("double") * (2 * math.pi * i * frequency / cycle_size)
        return df.withColumns({f"{column}_{f}_{i}": g(at(i)) for i in range(1, order + 1) for f, g in (("sin", F.sin), ("cos", F.cos))})

    return Step("harmonic", project=project)


def filter_by_time(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between two dates, the end's whole day included: two comparisons that reach the scan."""
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    if end:
        df = df.where(F.col(time) < F.lit(end).cast(df.schema[time].dataType) + F.expr("INTERVAL 1 DAY"))
    return df


def future_frame(df: DataFrame, time: str, unit: str, group: list[str], h: int) -> DataFrame:
    """The ``h`` times after each group's last."""
    last = df.groupBy(*group).agg(F.max(time).alias("__last"))
    return last.select(*group, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("__i"), "__last").select(*group, (F.col("__last") + F.make_dt_interval(secs=F.col("__i") * SECONDS[unit])).alias(time))


def anomalize(df: DataFrame, col: str, group: list[str], order: list[str], window: int = 7, width: float = 1.5) -> DataFrame:
    """``<col>_anomaly``: whether the distance from the centred rolling mean lies beyond ``width`` interquartile ranges of its group's."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(window // 2), window // 2)
    rest = df.withColumn("__rest", F.col(col) - F.avg(col).over(w))
    q = rest.groupBy(*group).agg(F.percentile("__rest", F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    span = F.col("__q")[1] - F.col("__q")[0]
    far = (F.col("__rest") < F.col("__q")[0] - width * span) | (F.col("__rest") > F.col("__q")[1] + width * span)
    return rest.join(q, group).withColumn(f"{col}_anomaly", F.coalesce(far, F.lit(False))).drop("__rest", "__q")


def clean_anomalies(df: DataFrame, col: str, group: list[str], order: list[str], window: int = 7, width: float = 1.5) -> DataFrame:
    """Anomalies give way to the centred rolling mean."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(window // 2), window // 2)
    smooth = df.withColumn("__smooth", F.avg(col).over(w))
    return anomalize(smooth, col, group, order, window, width).withColumn(col, F.when(F.col(f"{col}_anomaly"), F.col("__smooth")).otherwise(F.col(col))).drop("__smooth", f"{col}_anomaly")


def ts_summary(df: DataFrame, time: str, group: list[str]) -> DataFrame:
    """Rows, first and last time, and seconds between neighbours: least, median, mean, most."""
    gap = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(time).over(Window.partitionBy(*group).orderBy(time)).cast("timestamp"))
    return df.withColumn("__gap", gap).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"), F.min("__gap").alias("gap_min"), F.median("__gap").alias("gap_median"), F.avg("__gap").alias("gap_mean"), F.max("__gap").alias("gap_max"))


def ts_features(df: DataFrame, col: str, group: list[str], order: list[str]) -> DataFrame:
    """Per series: n, mean, variance, first autocorrelation of values and changes, share of rises, crossings of the median, entropy of ten bins."""
    w = Window.partitionBy(*group).orderBy(*order)
    stats = df.groupBy(*group).agg(F.median(col).alias("__median"), F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    x = df.join(stats, group).withColumn("__b", F.lag(col).over(w)).withColumn("__d", F.col(col) - F.col("__b")).withColumn("__e", F.lag("__d").over(w))
    up, was = F.col(col) > F.col("__median"), F.col("__b") > F.col("__median")
    bin_of = F.least(F.floor(F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 10), F.lit(9))
    parts = x.withColumn("__bin", F.coalesce(bin_of, F.lit(0)))
    p = parts.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    total = p.groupBy(*group).agg((F.log(F.sum("__c")) - F.sum(F.col("__c") * F.log("__c")) / F.sum("__c")).alias("entropy"))
    out = parts.groupBy(*group).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("variance"), F.corr(col, "__b").alias("acf1"), F.corr("__d", "__e").alias("diff_acf1"),
        F.avg((F.col("__d") > 0).cast("double")).alias("rises"), F.sum((up != was).cast("int")).alias("crossings"),
    )
    return out.join(total, group)


def volatility_ewm(df: DataFrame, col: str, group: list[str], order: list[str], decay: float = 0.94, cut: float = 1e-4) -> DataFrame:
    """``<col>_volatility``: root of the weighted mean square log return; weights fall by ``decay`` a row and end below ``cut``."""
    n = math.ceil(math.log(cut) / math.log(decay))
    w = Window.partitionBy(*group).orderBy(*order)
    back = w.rowsBetween(-(n - 1), 0)
    r = df.withColumn("__r", F.log(F.try_divide(F.col(col), F.lag(col).over(w))))
    r = r.withColumn("__s", F.collect_list(F.struct(F.coalesce(F.col("__r") * F.col("__r"), F.lit(-1.0)).alias("s"))).over(back))
    m = F.size("__s")
    weights = F.transform(F.col("__s"), lambda v, i: F.when(v["s"] >= 0, F.pow(F.lit(decay), (m - 1 - i).cast("double"))).otherwise(0.0))
    top = F.aggregate(F.zip_with("__s", weights, lambda v, u: v["s"] * u), F.lit(0.0), lambda a, b: a + b)
    low = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return r.withColumn(f"{col}_volatility", F.sqrt(F.try_divide(top, low))).drop("__r", "__s")


def permutation_entropy(df: DataFrame, col: str, group: list[str], order: list[str], m: int = 3) -> DataFrame:
    """``entropy`` per series of the rank patterns of ``m`` neighbours, 0 to 1; equal values rank in order of time."""
    w = Window.partitionBy(*group).orderBy(*order)
    values = [F.lag(col, m - 1 - i).over(w) for i in range(m)]
    x = df.select(*group, *[v.alias(f"__{i}") for i, v in enumerate(values)]).dropna(subset=[f"__{i}" for i in range(m)])
    rank = lambda i: sum((((F.col(f"__{j}") <= F.col(f"__{i}")) if j < i else (F.col(f"__{j}") < F.col(f"__{i}"))).cast("int") for j in range(m) if j != i), F.lit(0))
    c = x.groupBy(*group, F.concat_ws("", *[rank(i).cast("string") for i in range(m)]).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    h = F.log(F.sum("__c")) - F.sum(F.col("__c") * F.log("__c")) / F.sum("__c")
    return c.groupBy(*group).agg((h / math.log(math.factorial(m))).alias("entropy"))


def best_lag(df: DataFrame, y: str, x: list[str], group: list[str], order: list[str], max_lag: int = 3) -> DataFrame:
    """``column_name``, ``lag`` and ``corr`` of the lag at which each column correlates most with ``y``; of equal ones the least."""
    w = Window.partitionBy(*group).orderBy(*order)
    lagged = df.select(y, *[F.lag(c, k).over(w).alias(f"{c}__{k}") for c in x for k in range(max_lag + 1)])
    row = lagged.agg(*[F.corr(y, f"{c}__{k}").alias(f"{c}__{k}") for c in x for k in range(max_lag + 1)])
    long = row.unpivot([], row.columns, "__name", "corr").select(F.substring_index("__name", "__", 1).alias("column_name"), F.substring_index("__name", "__", -1).cast("int").alias("lag"), "corr")
    return long.groupBy("column_name").agg(F.max_by(F.struct("lag", "corr"), F.struct(F.coalesce(F.round(F.abs("corr"), 12), F.lit(-1.0)), -F.col("lag"))).alias("__b")).select("column_name", "__b.lag", "__b.corr")


def atr(df: DataFrame, high: str, low: str, close: str, group: list[str], order: list[str], n: int = 14) -> DataFrame:
    """``atr_<n>``, the mean true range of the last n rows; null until there are n."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.lag(close).over(w)
    x = df.withColumn("__tr", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))
    frame = w.rowsBetween(-(n - 1), 0)
    return x.withColumn(f"atr_{n}", F.when(F.count("__tr").over(frame) >= n, F.avg("__tr").over(frame))).drop("__tr")


def cmo(df: DataFrame, col: str, group: list[str], order: list[str], n: int = 14) -> DataFrame:
    """``<col>_cmo_<n>``: 100 (gains - losses) / (gains + losses) over the last n changes; null until there are n."""
    w = Window.partitionBy(*group).orderBy(*order)
    frame = w.rowsBetween(-(n - 1), 0)
    x = df.withColumn("__d", F.col(col) - F.lag(col).over(w))
    return x.withColumn(f"{col}_cmo_{n}", F.when(F.count("__d").over(frame) >= n, 100 * F.try_divide(F.sum("__d").over(frame), F.sum(F.abs("__d")).over(frame)))).drop("__d")
