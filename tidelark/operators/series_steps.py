"""Time-series functions as recipe steps: each is given its groups and order, and bakes new data as it is.

What a step adds depends on the rows it bakes alone (windows of each series),
but for those that say what they learn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.recipe import Step
from . import oscillators, rows, series_tests
from . import timeseries as T
from .more_steps import impute_roll


def _step(name: str, f, *args, **options) -> Step:
    return Step(name, [], project=lambda df, cs, k: f(df, *args, **options))


def step_lag(cols: list[str], lags: list[int], group: list[str], order: list[str]) -> Step:
    return _step("lag", T.lag, cols, lags, group, order)


def step_lead(cols: list[str], leads: list[int], group: list[str], order: list[str]) -> Step:
    return _step("lead", T.lead, cols, leads, group, order)


def step_diff(cols: list[str], group: list[str], order: list[str], k: int = 1, differences: int = 1) -> Step:
    return _step("diff", T.diff, cols, group, order, k, differences)


def step_pct_change(cols: list[str], group: list[str], order: list[str], k: int = 1) -> Step:
    return _step("pct_change", T.pct_change, cols, group, order, k)


def step_rolling(cols: list[str], n: int, group: list[str], order: list[str], functions=("mean",)) -> Step:
    return _step("rolling", T.rolling, cols, n, group, order, functions)


def step_window(cols: list[str], size: int, group: list[str], order: list[str], statistic: str = "mean") -> Step:
    """The statistic of a centred window of an odd number of rows, in the column's place; at the ends of what there is."""

    def project(df: DataFrame, cs, k):
        w = T._order(group, order).rowsBetween(-(size // 2), size // 2)
        return df.withColumns({c: getattr(F, statistic)(c).over(w) for c in cs})

    return Step("window", cols, project=project)


def step_expanding(cols: list[str], group: list[str], order: list[str], functions=("mean",)) -> Step:
    return _step("expanding", T.expanding, cols, group, order, functions)


def step_ewm(col: str, alpha: float, group: list[str], order: list[str]) -> Step:
    return _step("ewm", T.ewm_mean, col, alpha, group, order)


def step_fourier(time: str, period: float, order: int) -> Step:
    return _step("fourier", T.fourier, time, period, order)


def step_date(time: str, features: tuple[str, ...] = ("year", "quarter", "month", "day", "wday")) -> Step:
    """``<time>_<feature>`` for the named parts of ``timeseries.signature``."""

    def project(df: DataFrame, cs, k):
        whole = T.signature(df, time)
        return whole.select(*df.columns, *[f"{time}_{f}" for f in features])

    return Step("date", [], project=project)


def step_timeseries_signature(time: str) -> Step:
    return _step("timeseries_signature", T.signature, time)


def step_clean_anomalies(col: str, group: list[str], order: list[str], window: int = 7, width: float = 1.5) -> Step:
    return _step("clean_anomalies", rows.clean_anomalies, col, group, order, window, width)


def step_detrend(col: str, group: list[str], order: list[str], method: str = "linear") -> Step:
    return _step("detrend", oscillators.detrend, col, group, order, method)


def step_deseasonalize(col: str, group: list[str], order: list[str], period: int) -> Step:
    return _step("deseasonalize", oscillators.deseasonalize, col, group, order, period)


def step_fractional_diff(col: str, d: float, group: list[str], order: list[str], cut: float = 1e-2) -> Step:
    return _step("fractional_diff", oscillators.fractional_diff, col, d, group, order, cut)


def step_weight_time_decay(time: str, half_life: float, group: list[str]) -> Step:
    return _step("weight_time_decay", oscillators.time_decay_weight, time, half_life, group)


def step_volatility_ewm(col: str, group: list[str], order: list[str], decay: float = 0.94) -> Step:
    return _step("volatility_ewm", rows.volatility_ewm, col, group, order, decay)


def step_oscillators(col: str, group: list[str], order: list[str], rsi_period: int = 14) -> Step:
    return _step("oscillators", oscillators.rsi, col, group, order, rsi_period)


def step_impute_roll(col: str, group: list[str], order: list[str], window: int = 5) -> Step:
    return _step("impute_roll", impute_roll, col, group, order, window)


def step_stationary(col: str, group: list[str], order: list[str], max_diff: int = 2) -> Step:
    return _step("stationary", series_tests.stationary, col, group, order, max_diff)


def step_permutation_entropy(col: str, group: list[str], order: list[str], m: int = 3) -> Step:
    """``<col>_entropy``: the entropy of the row's series."""

    def project(df: DataFrame, cs, k):
        known = rows.permutation_entropy(df, col, group, order, m).withColumnRenamed("entropy", f"{col}_entropy")
        return df.join(known, group, "left")

    return Step("permutation_entropy", [], project=project)


def step_best_lag(outcome: str, cols: list[str], group: list[str], order: list[str], max_lag: int = 3) -> Step:
    """Learns the lag at which each column correlates most with the outcome, and adds ``<col>_lag_<k>``."""
    learn = lambda df, cs: {r["column_name"]: r["lag"] for r in rows.best_lag(df, outcome, cols, group, order, max_lag).collect()}  # noqa: E731, a row a column

    def project(df: DataFrame, cs, k):
        for c, lag in sorted(k.items()):
            df = T.lag(df, [c], [lag], group, order)
        return df

    return Step("best_lag", [], learn=learn, project=project)
