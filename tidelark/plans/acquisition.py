"""What a search by a surrogate model takes next: improvements over the best, bounds, and their trade-off over time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the normal distribution; the error function by Abramowitz and Stegun 7.1.26, right to 1.5e-7.  Fixed values.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erf(x: Column) -> Column:
    t = 1 / (1 + 0.3275911 * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(_ERF):
        series = (series + a) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def _cdf(z: Column) -> Column:
    return (1 + _erf(z / math.sqrt(2))) / 2


def _gain(mean: Column, best: float, maximize: bool, trade_off: float) -> Column:
    return (mean - best - trade_off) if maximize else (best - mean - trade_off)


def prob_improve(mean: Column, sd: Column, best: float, maximize: bool = False, trade_off: float = 0.0) -> Column:
    """The chance that a candidate is better than ``best`` by the trade-off; without spread 0 or 1."""
    gain = _gain(mean, best, maximize, trade_off)
    return F.when(sd > 0, _cdf(gain / sd)).otherwise((gain > 0).cast("double"))


def exp_improve(mean: Column, sd: Column, best: float, maximize: bool = False, trade_off: float = 0.0) -> Column:
    """By how much a candidate is expected to be better than ``best``."""
    gain = _gain(mean, best, maximize, trade_off)
    z = gain / sd
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(sd > 0, gain * _cdf(z) + sd * density).otherwise(F.greatest(gain, F.lit(0.0)))


def conf_bound(mean: Column, sd: Column, kappa: float = 0.1, maximize: bool = False) -> Column:
    """The mean moved to its better side by ``kappa`` deviations, as a number of which more is better."""
    return mean + kappa * sd if maximize else -(mean - kappa * sd)


def expo_decay(start: float, limit: float = 0.0, rate: float = 0.1, wait: int = 0) -> Callable[[int], float]:
    """A trade-off by iteration: ``start`` until ``wait``, then falling to ``limit``."""
    return lambda i: start if i <= wait else (start - limit) * math.exp(-rate * (i - wait)) + limit
