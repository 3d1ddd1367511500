"""Models of any kind by one specification, fitted and tuned over splits, with recipes prepared inside each split or group.

Grids of linear models belong in ``tuning``, which solves all of them from one
aggregate; here every split and configuration is a distributed fit.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import metric_set
from .recipe import FittedRecipe, Recipe
from .selectors import all_numeric
from .tuning import tune

REGRESSION = ("linear_reg", "poisson_reg", "decision_tree", "rand_forest", "bag_tree", "boost_tree")
CLASSES = ("logistic_reg", "decision_tree", "rand_forest", "bag_tree", "boost_tree", "svm_linear", "mlp")


@dataclass(frozen=True)
class ModelSpec:
    """A kind of model, its mode and arguments; an argument may be ``tune()``."""

    kind: str
    mode: str = "regression"
    args: dict = field(default_factory=dict)

    def __post_init__(self):
        from ..operators import learners

        if self.kind not in (REGRESSION if self.mode == "regression" else CLASSES):
            raise ValueError(f"{self.kind} has no mode {self.mode}")
        if unknown := set(self.args) - set(inspect.signature(getattr(learners, self.kind)).parameters):
            raise ValueError(f"{self.kind} has no arguments {sorted(unknown)}")

    def set_args(self, **args) -> "ModelSpec":
        return replace(self, args=self.args | args)

    def finalized(self, chosen: dict) -> "ModelSpec":
        return self.set_args(**{k: chosen[k] for k, v in self.args.items() if isinstance(v, tune) and k in chosen})

    def fit(self, train: DataFrame, y: str, x: list[str]) -> Model:
        from ..operators import learners

        if left := [k for k, v in self.args.items() if isinstance(v, tune)]:
            raise ValueError(f"parameters are still to be tuned: {left}")
        fit = getattr(learners, self.kind)
        mode = {"mode": self.mode} if "mode" in inspect.signature(fit).parameters else {}
        return fit(train.dropna(subset=[y, *x]), y, x, **mode, **self.args)


@dataclass(frozen=True)
class Flow:
    """A specification with an outcome, and predictors or a recipe (then all numeric columns it leaves but ``keep`` predict)."""

    spec: ModelSpec
    outcome: str
    predictors: tuple[str, ...] | None = None
    recipe: Recipe | None = None
    keep: tuple[str, ...] = ()

    def fit(self, train: DataFrame) -> "FittedFlow":
        prepared = self.recipe.prep(train) if self.recipe else None
        baked = prepared.bake(train) if prepared else train
        x = list(self.predictors or [c for c in all_numeric()(baked) if c != self.outcome and c not in self.keep])
        return FittedFlow(self, self.spec.fit(baked, self.outcome, x), tuple(x), prepared)


@dataclass(frozen=True)
class FittedFlow:
    flow: Flow
    model: Model
    predictors: tuple[str, ...]
    prepared: FittedRecipe | None

    def predict(self, df: DataFrame, kind: str | None = None) -> DataFrame:
        from ..operators import learners

        baked = self.prepared.bake(df) if self.prepared else df
        return learners.predict(self.model, baked, list(self.predictors), kind or ("numeric" if self.flow.spec.mode == "regression" else "class"))


def splits_of_roles(df: DataFrame, fold: str = "fold", role: str = "role") -> Iterable[tuple[str, DataFrame, DataFrame]]:
    """(fold, train, test) of rows dealt by ``time_series_folds`` or ``period_folds``: training rows come before, never after."""
    for (f,) in sorted(df.select(fold).distinct().collect()):  # a row a fold
        part = df.where(F.col(fold) == f)
        yield str(f), part.where(F.col(role) == "train").drop(fold, role), part.where(F.col(role) == "test").drop(fold, role)


def splits_of_folds(df: DataFrame, fold: str = "fold") -> Iterable[tuple[str, DataFrame, DataFrame]]:
    """(fold, the rest, the fold) of ``vfold_cv``."""
    for (f,) in sorted(df.select(fold).distinct().collect()):  # a row a fold
        yield str(f), df.where(F.col(fold) != f).drop(fold), df.where(F.col(fold) == f).drop(fold)


RESULT = "wflow_id string, `.config` string, fold string, metric string, value double"


def tune_flows(flows: dict[str, Flow], grid: list[dict], splits: Iterable[tuple[str, DataFrame, DataFrame]], metrics: list[str]) -> DataFrame:
    """wflow_id, .config, fold, metric, value: each flow, finalised by each configuration, fitted on train and held against test.

    Recipes are prepared on the training rows of the split alone.  A flow
    without anything to tune is fitted once a split, whatever the grid.
    """
    spark, rows = None, []
    for fold, train, test in splits:
        spark = train.sparkSession
        for name, flow in flows.items():
            free = any(isinstance(v, tune) for v in flow.spec.args.values())
            for config in grid if free else [{".config": "config_001"}]:
                fitted = replace(flow, spec=flow.spec.finalized(config)).fit(train)
                scored = fitted.predict(test)
                column = "`.pred`" if flow.spec.mode == "regression" else "`.pred_class`"
                if flow.spec.mode == "regression":
                    found = [(r["metric"], r["value"]) for r in metric_set(scored, flow.outcome, column, metrics).collect()]
                else:
                    from ..functions.multiclass import multiclass_metrics

                    every = {r["metric"]: r["value"] for r in multiclass_metrics(scored.withColumn("__p", F.col(column)), flow.outcome, "__p").collect()}
                    found = [(m, every[m]) for m in metrics]
                rows += [(name, config[".config"], fold, m, v) for m, v in found]
    if spark is None:
        raise ValueError("no splits")
    return spark.createDataFrame(rows, RESULT)


def fit_groups(flow: Flow, train: DataFrame, group: str, min_group_size: int = 1, most: int = 1000) -> dict[object, FittedFlow]:
    """One flow a group, its recipe prepared on the group's rows alone; smaller groups take a flow of all rows, under ``None``.

    Each group is a fit of its own; beyond ``most`` groups this raises, and
    ``tuning.Workflow.fit_nested`` fits linear models of any number at once.
    """
    sizes = train.groupBy(group).count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} groups")
    own = replace(flow, keep=(*flow.keep, group))
    out = {r[0]: own.fit(train.where(F.col(group).eqNullSafe(r[0]))) for r in sorted(sizes, key=lambda r: str(r[0])) if r["count"] >= min_group_size}
    if len(out) < len(sizes):
        out[None] = own.fit(train)
    return out


def predict_groups(fitted: dict[object, FittedFlow], df: DataFrame, group: str) -> DataFrame:
    """Rows with their group's prediction; those of groups without a flow take the flow of all rows, or raise where there is none."""
    named = [g for g in fitted if g is not None]
    other = ~F.coalesce(F.col(group).isin(named), F.lit(False))
    if None not in fitted and (new := df.where(other).select(group).first()):
        raise ValueError(f"a group that was not fitted: {new[0]}")
    parts = [fitted[g].predict(df.where(F.col(group) == g)) for g in named] + ([fitted[None].predict(df.where(other))] if None in fitted else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
