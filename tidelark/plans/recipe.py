"""Recipes: steps learn literals from training data in one aggregate each and
then apply as pure projections, which also run on a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..sources.tables import nan_to_null
from .selectors import resolve, with_roles


@dataclass(frozen=True)
class Step:
    """``learn(df, columns)`` returns literals; ``project(df, columns, literals)`` a DataFrame.

    ``aggregates``, where a step has them, are combined with those of the
    steps beside it that read the same columns' training values.
    """

    name: str
    columns: object = None
    default: object = None
    aggregates: Callable[[list[str]], dict[str, Column]] | None = None
    learn: Callable[[DataFrame, list[str]], dict] | None = None
    project: Callable[[DataFrame, list[str], dict], DataFrame] = lambda df, columns, known: df

    def prep(self, df: DataFrame) -> "FittedStep":
        columns = resolve(self.columns, df, self.default)
        known: dict = {}
        if self.aggregates and columns:
            wanted = self.aggregates(columns)
            row = df.agg(*[c.alias(k) for k, c in wanted.items()]).first()
            known = row.asDict()
        if self.learn:
            known |= self.learn(df, columns)
        return FittedStep(self, columns, known)


@dataclass(frozen=True)
class FittedStep:
    step: Step
    columns: list[str]
    known: dict

    def bake(self, df: DataFrame) -> DataFrame:
        return self.step.project(df, [c for c in self.columns if c in df.columns], self.known)


@dataclass(frozen=True)
class Recipe:
    """``roles`` says what columns are for (outcome, id, ...); those without a role are predictors."""

    steps: tuple[Step, ...] = field(default_factory=tuple)
    roles: dict[str, str] = field(default_factory=dict)

    def add(self, *steps: Step) -> "Recipe":
        return Recipe((*self.steps, *steps), self.roles)

    def update_role(self, *columns: str, role: str) -> "Recipe":
        return Recipe(self.steps, self.roles | dict.fromkeys(columns, role))

    def prep(self, train: DataFrame) -> "FittedRecipe":
        fitted, df = [], nan_to_null(train)
        with with_roles(self.roles):
            for step in self.steps:
                fitted.append(step.prep(df))
                df = fitted[-1].bake(df)
        return FittedRecipe(tuple(fitted))


@dataclass(frozen=True)
class FittedRecipe:
    steps: tuple[FittedStep, ...]

    def bake(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        for step in self.steps:
            df = step.bake(df)
        return df
