"""Percentiles over bins against the aggregate that holds every value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.operators import quantiles
from tidelark.operators import steps as S
from tidelark.plans.recipe import Recipe

AT = [0.0, 0.05, 0.25, 0.3333, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("few", [50_000, 20])
def test_percentiles_are_exact(spark, few, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 20)
    rng = np.random.default_rng(3)
    n = 4001
    wide = np.where(rng.random(n) < 0.1, np.inf, np.sign(rng.normal(size=n)) * 10.0 ** rng.integers(-300, 300, n))
    data = {"even": rng.random(n), "tied": np.where(rng.random(n) < 0.9, 3.0, rng.random(n) * 6), "few": rng.integers(0, 3, n).astype(float), "wide": wide, "same": np.full(n, -7.0)}
    rows = list(zip(*[v.tolist() for v in data.values()], [None] * n, [None if i % 3 else float(i) for i in range(n)], rng.integers(0, 9000, n).tolist(), strict=True))
    t = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data) + ", none double, `so.me` double, whole long")
    cs = t.columns
    want = t.agg(*[F.percentile(F.col(f"`{c}`"), F.array(*map(F.lit, AT))).alias(c) for c in cs]).first().asDict()
    assert {c: v and [x if x == x else None for x in v] for c, v in quantiles.percentiles(t, {c: AT for c in cs}, few).items()} == {c: v and [x if x == x else None for x in v] for c, v in want.items()}
    assert quantiles.percentiles(t.limit(0), {"even": [0.5]}, few) == {"even": None}


@pytest.mark.parametrize("make", [S.step_percentile, S.step_winsorizer, S.step_outlier_trimmer, S.step_impute_median, S.step_discretize])
def test_steps_hold_no_column_in_one_aggregate(spark, make, monkeypatch):
    """the aggregate of exact percentiles moves every distinct value to one task."""

    def refused(*_):
        raise AssertionError("a column's values meet in one task")

    for name in ("percentile", "median"):
        monkeypatch.setattr(F, name, refused)
    t = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"))
    Recipe().add(make(["x"])).prep(t).bake(t).collect()
