"""Joins on order, tree steps, models over splits: nulls, ties, empty tables and wrong arguments."""

import pytest
from pyspark.sql import functions as F

from tidelark.functions import survival
from tidelark.operators import joins, more_steps, tree_steps
from tidelark.operators import series_tests as ST
from tidelark.plans import specs
from tidelark.plans.recipe import Recipe
from tidelark.plans.tuning import tune

LEFT = "k string, t double, __bucket int"
RIGHT = "k string, t double, v double"


def test_asof_by_hand(spark):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 5.0, 2), ("a", 0.5, 3), ("a", 95.0, 4), (None, 5.0, 5), ("b", None, 6), ("c", 9.0, 7)], LEFT)
    right = spark.createDataFrame([("a", 1.0, 1.0), ("a", 5.0, 2.0), ("a", 5.0, 3.0), (None, 1.0, 9.0), ("b", 1.0, None), ("c", 10.0, 8.0)], RIGHT)
    for width in (1.0, 7.0, 1000.0):
        got = {r["__bucket"]: r.v for r in joins.asof_join(left, right, "t", ["k"], width).collect()}
        assert got == {1: 3.0, 2: 3.0, 3: None, 4: 3.0, 5: None, 6: None, 7: None}
    near = {r["__bucket"]: r.v for r in joins.asof_join(left, right, "t", ["k"], 7.0, 50.0).collect()}
    assert near[1] == 3.0 and near[4] is None
    assert joins.asof_join(left.where("false"), right, "t", ["k"], 7.0).count() == 0
    assert {r.v for r in joins.asof_join(left, right.where("false"), "t", ["k"], 7.0).collect()} == {None}
    with pytest.raises(ValueError):
        joins.asof_join(left.withColumn("v", F.lit(1)), right, "t", ["k"], 7.0)


def test_intervals_by_hand(spark):
    points = spark.createDataFrame([("a", float(i)) for i in range(20)] + [(None, 3.0), ("a", None)], "k string, t double")
    spans = spark.createDataFrame([("a", 2.0, 5.0, 1), ("a", 4.0, 4.0, 2), ("a", 0.0, 15.5, 3), (None, 0.0, 9.0, 4), ("a", None, 9.0, 5)], "k string, s double, e double, i int")
    for width in (0.5, 4.0, 100.0):
        rows = joins.interval_join(points, spans, "t", "s", "e", ["k"], width).select("i", "t").collect()
        assert sorted((r.i, r.t) for r in rows) == [(1, 2.0), (1, 3.0), (1, 4.0), *[(3, float(i)) for i in range(16)]]


def test_checks(spark):
    t = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (9.0, "c"), (None, None)], "x double, s string")
    train = t.where("x < 5")
    flags = Recipe().add(more_steps.check_range(["x"], action="flag"), more_steps.check_missing(["s"], "flag"), more_steps.check_new_values(["s"], "flag")).prep(train)
    assert [c for c in flags.bake(t).columns if c.endswith("_failed")] == ["x_failed", "s_failed"]
    assert [r.x_failed for r in flags.bake(t).collect()] == [False, False, True, False]
    with pytest.raises(Exception, match="check_new_values fails for s"):
        Recipe().add(more_steps.check_new_values(["s"])).prep(train).bake(t).collect()
    with pytest.raises(ValueError):
        more_steps.check_missing(["s"], "ignore")


def test_tree_of_one_column(spark):
    rows = [(float(i), 10.0 if i < 30 else 20.0 if i < 60 else 0.0) for i in range(100)] + [(None, 5.0), (7.0, None)]
    t = spark.createDataFrame(rows, "x double, y double")
    out = Recipe().add(tree_steps.step_dt_features("y", ["x"], 2)).prep(t).bake(t)
    assert {(r.x < 30, r.x < 60, r.x_dt) for r in out.where("x IS NOT NULL").collect()} == {(True, True, 10.0), (False, True, 20.0), (False, False, 0.0)}
    assert out.where("x IS NULL").first().x_dt is None
    for step in (tree_steps.step_dt_discretiser("y", ["x"]), tree_steps.step_splitwise("y", ["x"])):
        empty = t.where("false")
        assert Recipe().add(step).prep(empty).bake(empty).count() == 0
        nulls = t.withColumn("x", F.lit(None).cast("double"))
        assert Recipe().add(step).prep(nulls).bake(nulls).count() == t.count()


def test_more_values_than_bins(spark):
    t = spark.range(5000).select((F.col("id") / 7).alias("x"), (F.col("id") >= 2500).cast("double").alias("y"))
    known = Recipe().add(tree_steps.step_splitwise("y", ["x"])).prep(t).steps[0].known
    assert abs(known["x"] - 2500 / 7) < 5000 / 7 / 200


def test_forest_steps_keep_what_matters(spark):
    t = spark.range(2000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).withColumn("y", F.col("a") * 10)
    for step in (tree_steps.step_select_probe("y", probes=20, trees=10), tree_steps.step_boruta("y", rounds=7, trees=5), tree_steps.step_filter_rf_importance("y", top_n=1)):
        assert Recipe().add(step).prep(t).bake(t).columns == ["a", "y"]


def test_specifications(spark):
    with pytest.raises(ValueError):
        specs.ModelSpec("svm_linear")
    with pytest.raises(ValueError):
        specs.ModelSpec("rand_forest", args={"leaves": 3})
    t = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).alias("g"), F.col("id").alias("fold")).withColumns({"y": F.col("x") * (F.col("g") + 1), "fold": F.col("fold") % 4})
    with pytest.raises(ValueError):
        specs.Flow(specs.ModelSpec("rand_forest", args={"trees": tune()}), "y", ("x",)).fit(t)
    flow = specs.Flow(specs.ModelSpec("linear_reg"), "y", ("x",))
    groups = specs.fit_groups(flow, t, "g")
    got = specs.predict_groups(groups, t, "g")
    assert got.where(F.abs(F.col("y") - F.col("`.pred`")) > 1e-6).count() == 0 and got.count() == 200
    with pytest.raises(ValueError):
        specs.predict_groups(groups, t.withColumn("g", F.lit(9)), "g")
    some = specs.fit_groups(flow, t, "g", min_group_size=500)
    assert list(some) == [None]
    classes = specs.Flow(specs.ModelSpec("decision_tree", "classification"), "high", ("x",))
    scored = specs.tune_flows({"tree": classes}, [], specs.splits_of_folds(t.withColumn("high", (F.col("x") >= 5).cast("int"))), ["accuracy"])
    assert {r.value for r in scored.collect()} == {1.0}


def test_reconciled_sums_agree(spark):
    base = spark.createDataFrame([("p", None, 10.0), ("p", "a", 3.0), ("p", "b", 4.0), ("q", "a", 1.0), (None, "a", 7.0)], "p string, c string, `.pred` double")
    rows = {(r.p, r.c): r[".pred"] for r in ST.reconcile_ols(base, ["p"], ["c"]).collect()}
    assert rows == {("p", None): 9.0, ("p", "a"): 4.0, ("p", "b"): 5.0, ("q", "a"): 1.0}


def test_nothing_censored(spark):
    t = spark.createDataFrame([(float(i), 1, 0.5) for i in range(1, 11)], "time double, event int, s double")
    assert {r.g for r in survival.censoring(t, "time", "event").collect()} == {1.0}
    assert survival.brier_survival(t, "time", "event", {5.0: "s"}).first().value == pytest.approx(0.25)
    assert survival.censoring(t.where("false"), "time", "event").count() == 0


def test_trees_read_partitions_of_bounded_rows(spark, monkeypatch):
    """F4, F8, F9, F10: a task reads a partition of the rows as objects, so its rows are bounded and not its file's."""
    from tidelark.operators import learners

    t = spark.range(1000, numPartitions=1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit("z").alias("other"))
    parts = learners.dealt(t, ["y", "x"], 100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) <= 110 and sum(r["count"] for r in parts) == 1000
    assert learners.dealt(t, ["y", "x"], 1000).rdd.getNumPartitions() == 1
    seen = []
    monkeypatch.setattr(learners, "dealt", lambda df, columns: seen.append(columns) or df)
    for fit in (learners.boost_tree, learners.bag_tree, learners.rand_forest):
        fit(t, "y", ["x"], trees=2)
    assert seen == [["y", "x"]] * 3


def test_boruta_deals_its_rows_once(spark, monkeypatch):
    """rounds share the rows that were dealt and kept; none of them stay kept."""
    from tidelark.operators import learners

    calls, kept = [], learners.dealt
    monkeypatch.setattr(learners, "dealt", lambda df, columns: calls.append(columns) or kept(df, columns))
    t = spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    Recipe().add(tree_steps.step_boruta("y", ["x"], rounds=2, trees=2)).prep(t)
    assert calls == [["y", "x"]]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
