"""Further recipe steps that are one projection, and checks that stop a bake."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric
from .level_steps import levels
from .steps import _replace


def _each(name: str, columns, f: Callable[[Column], Column]) -> Step:
    """A step that replaces each column by ``f`` of it."""
    return Step(name, columns, all_numeric(), None, None, lambda df, cs, k: _replace(df, {c: f(F.col(f"`{c}`")) for c in cs}))


def step_logit(columns=None, offset: float = 0.0) -> Step:
    """log(p / (1 - p)) of shares kept ``offset`` from 0 and 1; null at 0 and 1."""
    keep = lambda x: F.least(F.greatest(x, F.lit(offset)), F.lit(1 - offset))
    return _each("logit", columns, lambda x: F.log(keep(x)) - F.log(1 - keep(x)))


def step_invlogit(columns=None) -> Step:
    return _each("invlogit", columns, lambda x: 1 / (1 + F.exp(-x)))


def step_hyperbolic(columns=None, function: str = "sinh", inverse: bool = True) -> Step:
    """sinh, cosh or tanh, or their inverses; null outside the inverse's domain."""
    f = getattr(F, ("a" if inverse else "") + function)
    return _each("hyperbolic", columns, lambda x: F.nanvl(f(x), F.lit(None).cast("double")))


def step_relu(columns=None, shift: float = 0.0, reverse: bool = False, prefix: str = "right_relu_") -> Step:
    """``prefix`` + column, the part beyond ``shift`` (before it with ``reverse``)."""

    def project(df, cs, k):
        part = lambda c: F.lit(shift) - F.col(c) if reverse else F.col(c) - F.lit(shift)
        return df.withColumns({f"{prefix}{c}": F.greatest(part(c), F.lit(0.0)) for c in cs})

    return Step("relu", columns, all_numeric(), None, None, project)


def step_spatialsign(columns=None) -> Step:
    """The columns, centred and scaled beforehand, divided by their common length; unchanged where that is 0."""

    def project(df, cs, k):
        length = F.sqrt(sum((F.col(c) * F.col(c) for c in cs[1:]), F.col(cs[0]) * F.col(cs[0])))
        return df.withColumn("__length", length).withColumns({c: F.when(F.col("__length") > 0, F.col(c) / F.col("__length")).otherwise(F.col(c)) for c in cs}).drop("__length")

    return Step("spatialsign", columns, all_numeric(), None, None, project)


def step_geodist(lat: str, lon: str, ref_lat: float, ref_lon: float, name: str = "geo_dist", is_lat_lon: bool = True) -> Step:
    """Distance to a place: along the sphere in metres, or in the plane."""

    def project(df, cs, k):
        if not is_lat_lon:
            return df.withColumn(name, F.sqrt((F.col(lat) - ref_lat) ** 2 + (F.col(lon) - ref_lon) ** 2))
        a, b = F.radians(lat), math.radians(ref_lat)
        h = F.sin((a - b) / 2) ** 2 + F.cos(a) * math.cos(b) * F.sin((F.radians(lon) - math.radians(ref_lon)) / 2) ** 2
        return df.withColumn(name, 2 * 6371000.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))

    return Step("geodist", project=project)


def step_regex(column: str, pattern: str, result: str) -> Step:
    """1 where the pattern is found, else 0; null stays null."""
    return Step("regex", project=lambda df, cs, k: df.withColumn(result, F.col(column).rlike(pattern).cast("int")))


def step_count(column: str, pattern: str, result: str, normalize: bool = False) -> Step:
    """How often the pattern is found, per character with ``normalize``."""

    def project(df, cs, k):
        n = F.regexp_count(F.col(column), F.lit(pattern))
        return df.withColumn(result, F.try_divide(n, F.length(column)) if normalize else n)

    return Step("count", project=project)


def step_dummy_extract(column: str, sep: str = ", ", threshold: float = 0.0) -> Step:
    """A count column for every part that ``sep`` parts the text into, in order of name; parts rarer than ``threshold`` of the rows add to ``other``."""

    def learn(df, cs):
        parts = df.select(F.explode(F.array_distinct(F.split(F.col(column), sep))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        rows = df.agg(F.count(column)).first()[0]
        return {"parts": sorted(r["part"] for r in parts.where(F.col("n") >= threshold * rows).collect())}  # one a level

    def project(df, cs, k):
        split = F.coalesce(F.split(F.col(column), sep), F.array().cast("array<string>"))
        count = lambda v: F.size(F.filter(split, lambda x: x == F.lit(v)))
        new = {f"{column}_{v}": count(v) for v in k["parts"]}
        if threshold > 0:
            new[f"{column}_other"] = F.size(F.filter(split, lambda x: ~x.isin(*k["parts"]) if k["parts"] else F.lit(True)))
        return df.withColumns(new).drop(column)

    return Step("dummy_extract", learn=learn, project=project)


def step_bin2factor(columns=None, levels: tuple[str, str] = ("yes", "no")) -> Step:
    return _each("bin2factor", columns, lambda x: F.when(x == 1, levels[0]).when(x.isNotNull(), levels[1]))


def step_num2factor(columns, levels: list[str]) -> Step:
    """The level of the number, from 1; null for others."""
    return _each("num2factor", columns, lambda x: F.get(F.array(*map(F.lit, levels)), x.cast("int") - 1))


def step_relevel(column: str, first: str) -> Step:
    """Positions of the sorted training levels with ``first`` before them all; null for others."""

    def learn(df, cs):
        levels = sorted(r[0] for r in df.select(column).distinct().dropna().collect())
        return {"levels": [first, *[v for v in levels if v != first]]}

    return Step("relevel", None, None, None, learn, lambda df, cs, k: df.withColumn(column, F.nullif(F.array_position(F.array(*map(F.lit, k["levels"])), F.col(column)).cast("int"), F.lit(0))))


def step_rename(**new: str) -> Step:
    """``new_name="old_name"``."""
    return Step("rename", project=lambda df, cs, k: df.withColumnsRenamed({old: n for n, old in new.items()}))


def step_rename_at(columns, f: Callable[[str], str]) -> Step:
    return Step("rename_at", columns, None, None, None, lambda df, cs, k: df.withColumnsRenamed({c: f(c) for c in cs}))


def step_mutate_at(columns, f: Callable[[Column], Column]) -> Step:
    return _each("mutate_at", columns, f)


def step_intercept(value: float = 1.0, name: str = "intercept") -> Step:
    return Step("intercept", project=lambda df, cs, k: df.select(F.lit(value).alias(name), "*"))


def step_poly_bernstein(column: str, degree: int = 3) -> Step:
    """Bernstein polynomials 1 to ``degree`` of the column scaled to 0..1 by its training range; values beyond take the ends."""

    def project(df, cs, k):
        lo, hi = k["lo"], k["hi"]
        x = F.least(F.greatest((F.col(column) - lo) / ((hi - lo) or 1.0), F.lit(0.0)), F.lit(1.0))
        new = {f"{column}_bern_{i}": math.comb(degree, i) * F.pow(x, F.lit(i)) * F.pow(1 - x, F.lit(degree - i)) for i in range(1, degree + 1)}
        return df.withColumns(new).drop(column)

    return Step("poly_bernstein", column, None, lambda cs: {"lo": F.min(column), "hi": F.max(column)}, None, project)


def step_classdist(outcome: str, columns: list[str]) -> Step:
    """``classdist_<class>``: log of the squared Euclidean distance to the class's means."""

    def learn(df, cs):
        rows = df.groupBy(outcome).agg(*[F.avg(c) for c in columns]).dropna().collect()  # one a class
        return {str(r[0]): list(r[1:]) for r in rows}

    def project(df, cs, k):
        d = lambda m: sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns[1:], m[1:], strict=True)), (F.col(columns[0]) - float(m[0])) ** 2)
        return df.withColumns({f"classdist_{v}": F.log(d(m)) for v, m in sorted(k.items())})

    return Step("classdist", None, None, None, learn, project)


def step_impute_lower(columns=None) -> Step:
    """Nulls become the column's least value."""
    return Step("impute_lower", columns, all_numeric(), lambda cs: {c: F.min(c) for c in cs}, None, lambda df, cs, k: df.withColumns({c: F.coalesce(F.col(c), F.lit(k[c])) for c in cs}))


def impute_roll(df: DataFrame, col: str, group: list[str], order: list[str], window: int = 5) -> DataFrame:
    """Nulls become the median of the rows around them, ``window`` wide."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(window // 2), window // 2)
    values = F.array_sort(F.collect_list(col).over(w))
    df = df.withColumn("__v", values)
    n = F.size("__v")
    middle = (F.get("__v", F.floor((n - 1) / 2).cast("int")) + F.get("__v", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(col, F.coalesce(F.col(col), middle)).drop("__v")


def step_time(column: str) -> Step:
    """``<c>_hour``, ``_minute``, ``_second`` and ``_am``."""
    return Step("time", project=lambda df, cs, k: df.withColumns({f"{column}_hour": F.hour(column), f"{column}_minute": F.minute(column), f"{column}_second": F.second(column), f"{column}_am": (F.hour(column) < 12).cast("int")}))


def _check(name: str, columns, default, aggregates, learn, fails: Callable, action: str) -> Step:
    """``action`` "raise" stops the bake, where the rows are read, at the first failure; "flag" adds ``<c>_failed`` to every row."""
    if action not in ("raise", "flag"):
        raise ValueError(f"unknown action {action}")

    def project(df, cs, k):
        failed = {c: fails(c, k) for c in cs}
        if action == "flag":
            return df.withColumns({f"{c}_failed": F.coalesce(v, F.lit(False)) for c, v in failed.items()})
        return df.withColumns({c: F.when(v, F.raise_error(F.lit(f"{name} fails for {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in failed.items()})

    return Step(name, columns, default, aggregates, learn, project)


def check_missing(columns=None, action: str = "raise") -> Step:
    """No value may be null."""
    return _check("check_missing", columns, None, None, None, lambda c, k: F.col(c).isNull(), action)


def check_range(columns=None, slack: float = 0.05, action: str = "raise") -> Step:
    """No value may lie farther than ``slack`` of the training range outside it."""

    def fails(c, k):
        lo, hi = k[f"lo_{c}"], k[f"hi_{c}"]
        return (F.col(c) < lo - slack * (hi - lo)) | (F.col(c) > hi + slack * (hi - lo)) if lo is not None else F.lit(False)

    return _check("check_range", columns, all_numeric(), lambda cs: {f"{f}_{c}": a(c) for c in cs for f, a in (("lo", F.min), ("hi", F.max))}, None, fails, action)


def check_new_values(columns=None, action: str = "raise") -> Step:
    """No level may be one that training did not have; null is not a level."""
    return _check("check_new_values", columns, all_nominal(), None, levels, lambda c, k: F.col(c).isNotNull() & ~F.col(c).isin(*k[c]), action)


def check_cols(names: list[str]) -> Step:
    """An error, when planned, if a column is missing."""

    def project(df, cs, k):
        if gone := [c for c in names if c not in df.columns]:
            raise ValueError(f"missing columns: {gone}")
        return df

    return Step("check_cols", project=project)
