"""Models fitted by distributed training, and predictions of them, behind one call each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "__features"


def _assembled(df: DataFrame, x: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=x, outputCol=FEATURES, handleInvalid="skip").transform(df)


def dealt(df: DataFrame, columns: list[str], most: int = 250_000) -> DataFrame:
    """``columns`` in partitions of ``most`` rows or so; tables of no more rows stay as they are.

    Trees keep their rows as objects, many times larger than in a file, and read
    a whole partition of them in a task; a partition of a file is as large as
    its row groups and splits make it.
    """
    narrow = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])
    n = -(-narrow.count() // most)
    return narrow.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism)) if n > 1 else narrow


def _grow(estimator, df: DataFrame, y: str, x: list[str], spread: bool = True) -> Model:
    return _fit(estimator, dealt(df, [y, *x]) if spread else df, y, x)


def _fit(estimator, df: DataFrame, y: str, x: list[str]) -> Model:
    return estimator.setFeaturesCol(FEATURES).setLabelCol(y).fit(_assembled(df, x))


def linear_reg(df: DataFrame, y: str, x: list[str], penalty: float = 0.0, mixture: float = 0.0) -> Model:
    """Ridge (mixture 0) to lasso (1)."""
    return _fit(LinearRegression(regParam=penalty, elasticNetParam=mixture), df, y, x)


def poisson_reg(df: DataFrame, y: str, x: list[str], penalty: float = 0.0) -> Model:
    return _fit(GeneralizedLinearRegression(family="poisson", link="log", regParam=penalty), df, y, x)


def logistic_reg(df: DataFrame, y: str, x: list[str], penalty: float = 0.0, mixture: float = 0.0) -> Model:
    return _fit(LogisticRegression(regParam=penalty, elasticNetParam=mixture), df, y, x)


def decision_tree(df: DataFrame, y: str, x: list[str], mode: str = "regression", tree_depth: int = 5, min_n: int = 1, seed: int = 42) -> Model:
    kind = DecisionTreeRegressor if mode == "regression" else DecisionTreeClassifier
    return _grow(kind(maxDepth=tree_depth, minInstancesPerNode=min_n, seed=seed), df, y, x)


def rand_forest(df: DataFrame, y: str, x: list[str], mode: str = "regression", mtry: int | None = None, trees: int = 20, tree_depth: int = 5, min_n: int = 1, seed: int = 42, spread: bool = True) -> Model:
    """``spread`` is False for rows that ``dealt`` has dealt already."""
    kind = RandomForestRegressor if mode == "regression" else RandomForestClassifier
    return _grow(kind(numTrees=trees, maxDepth=tree_depth, minInstancesPerNode=min_n, featureSubsetStrategy=str(mtry) if mtry else "auto", seed=seed), df, y, x, spread)


def bag_tree(df: DataFrame, y: str, x: list[str], mode: str = "regression", trees: int = 20, tree_depth: int = 5, min_n: int = 1, seed: int = 42) -> Model:
    """A forest whose splits see all columns."""
    kind = RandomForestRegressor if mode == "regression" else RandomForestClassifier
    return _grow(kind(numTrees=trees, maxDepth=tree_depth, minInstancesPerNode=min_n, featureSubsetStrategy="all", seed=seed), df, y, x)


def boost_tree(df: DataFrame, y: str, x: list[str], mode: str = "regression", trees: int = 20, tree_depth: int = 3, learn_rate: float = 0.1, min_n: int = 1, sample_size: float = 1.0, seed: int = 42) -> Model:
    kind = GBTRegressor if mode == "regression" else GBTClassifier
    return _grow(kind(maxIter=trees, maxDepth=tree_depth, stepSize=learn_rate, minInstancesPerNode=min_n, subsamplingRate=sample_size, seed=seed), df, y, x)


def svm_linear(df: DataFrame, y: str, x: list[str], cost: float = 1.0) -> Model:
    """Two classes, 0 and 1; the penalty is 1 / cost over the rows."""
    return _fit(LinearSVC(regParam=1.0 / cost), df, y, x)


def mlp(df: DataFrame, y: str, x: list[str], classes: int = 2, hidden_units: tuple[int, ...] = (8,), epochs: int = 100, seed: int = 42) -> Model:
    """A feed-forward classifier of classes 0, 1, ..."""
    return _fit(MultilayerPerceptronClassifier(layers=[len(x), *hidden_units, classes], maxIter=epochs, seed=seed), df, y, x)


def predict(model: Model, df: DataFrame, x: list[str], kind: str = "numeric") -> DataFrame:
    """``df`` with ``.pred`` (numeric), ``.pred_class``, or ``.pred_0``, ``.pred_1``, ... (prob); rows with null predictors go."""
    out = model.transform(_assembled(df, x))
    if kind == "prob":
        new = {f".pred_{i}": vector_to_array("probability")[i] for i in range(model.numClasses)}
    else:
        new = {".pred" if kind == "numeric" else ".pred_class": F.col("prediction")}
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in [*df.columns, *new]])


def importance(model: Model, x: list[str]) -> dict[str, float]:
    """Split gains of trees, sizes of coefficients of others."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return {c: abs(float(v)) for c, v in zip(x, values.toArray(), strict=True)}


def select_rfe(df: DataFrame, y: str, x: list[str], n: int | None = None, drop: int = 1, fit: Callable = linear_reg) -> list[str]:
    """Columns left after the ``drop`` weakest go in turn until ``n`` (half) are left; columns are scaled by their deviation first."""
    sd = df.agg(*[F.stddev_samp(c).alias(c) for c in x]).first().asDict()
    left, scaled = list(x), df.withColumns({c: F.col(c) / F.lit(sd[c] or 1.0) for c in x})
    n = n or max(1, len(x) // 2)
    while len(left) > n:
        weak = sorted(importance(fit(scaled, y, left), left).items(), key=lambda kv: (kv[1], kv[0]))
        gone = {c for c, _ in weak[: min(drop, len(left) - n)]}
        left = [c for c in left if c not in gone]
    return left
