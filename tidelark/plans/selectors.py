"""Column selectors: functions of a schema, resolved without a job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")
Selector = Callable[[DataFrame], list[str]]


def _typed(*kinds: str) -> Callable[[], Selector]:
    return lambda: lambda df: [f.name for f in df.schema.fields if f.dataType.typeName().split("(")[0] in kinds]


all_numeric = _typed(*NUMERIC)
all_integer = _typed("byte", "short", "integer", "long")
all_float = _typed("float", "double")
all_string = all_nominal = _typed("string")
all_datetime = _typed("timestamp", "timestamp_ntz", "date")


def everything() -> Selector:
    return lambda df: list(df.columns)


def starts_with(prefix: str) -> Selector:
    return lambda df: [c for c in df.columns if c.startswith(prefix)]


def ends_with(suffix: str) -> Selector:
    return lambda df: [c for c in df.columns if c.endswith(suffix)]


def contains(part: str) -> Selector:
    return lambda df: [c for c in df.columns if part in c]


def matches(pattern: str) -> Selector:
    return lambda df: [c for c in df.columns if re.search(pattern, c)]


def one_of(*names: str) -> Selector:
    return lambda df: [c for c in df.columns if c in names]


def none_of(*names: str) -> Selector:
    return lambda df: [c for c in df.columns if c not in names]


#: The roles of the recipe that is being prepared.
_ROLES: ContextVar[dict[str, str]] = ContextVar("roles", default={})


@contextmanager
def with_roles(roles: dict[str, str]):
    token = _ROLES.set(roles)
    try:
        yield
    finally:
        _ROLES.reset(token)


def has_role(role: str) -> Selector:
    """Columns of that role in the recipe; without one a column is a predictor."""
    return lambda df: [c for c in df.columns if _ROLES.get().get(c, "predictor") == role]


def all_predictors() -> Selector:
    return has_role("predictor")


def all_outcomes() -> Selector:
    return has_role("outcome")


def all_numeric_predictors() -> Selector:
    return intersection(all_numeric(), all_predictors())


def all_nominal_predictors() -> Selector:
    return intersection(all_nominal(), all_predictors())


def where(test: Callable) -> Selector:
    """Columns whose field of the schema passes the test."""
    return lambda df: [f.name for f in df.schema.fields if test(f)]


def union(*selectors: Selector) -> Selector:
    return lambda df: [c for c in df.columns if any(c in s(df) for s in selectors)]


def intersection(*selectors: Selector) -> Selector:
    return lambda df: [c for c in df.columns if all(c in s(df) for s in selectors)]


def difference(first: Selector, second: Selector) -> Selector:
    return lambda df: [c for c in first(df) if c not in second(df)]


def resolve(selector: None | str | Iterable[str] | Selector, df: DataFrame, default: Selector | None = None) -> list[str]:
    if selector is None:
        return (default or everything())(df)
    if isinstance(selector, str):
        return [selector]
    return selector(df) if callable(selector) else list(selector)
