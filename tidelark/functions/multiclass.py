"""Metrics of any number of classes: one pass over the rows gives counts of (truth, estimate), a row for two classes at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a class: tp, truth t, estimate e and the rows n.
PER_CLASS = {
    "precision": lambda tp, t, e, n: (tp, e),
    "ppv": lambda tp, t, e, n: (tp, e),
    "recall": lambda tp, t, e, n: (tp, t),
    "sens": lambda tp, t, e, n: (tp, t),
    "spec": lambda tp, t, e, n: (n - t - e + tp, n - t),
    "npv": lambda tp, t, e, n: (n - t - e + tp, n - e),
    "f_meas": lambda tp, t, e, n: (2 * tp, t + e),
    "detection_prevalence": lambda tp, t, e, n: (e, n),
}


def conf_mat(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """truth, estimate and n of every pair that occurs; rows with a null in either are left out."""
    there = df.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())
    return there.groupBy(F.col(truth).alias("truth"), F.col(estimate).alias("estimate")).agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(df: DataFrame, truth: str, estimate: str, estimator: str = "macro") -> DataFrame:
    """Rows (metric, value): accuracy, kap, mcc, and those of each class averaged.

    ``macro`` is the mean over classes (where a metric is not defined the class
    is left out), ``macro_weighted`` weighs them by their true rows, ``micro``
    sums numerators and denominators first.
    """
    cells = conf_mat(df, truth, estimate)
    t = cells.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("estimate"), F.col("n")).otherwise(0)).alias("tp"))
    e = cells.groupBy(F.col("estimate").alias("c")).agg(F.sum("n").alias("e"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double").alias(name)
    each = t.join(e, "c", "full").select("c", zero("t"), zero("tp"), zero("e"))
    each = each.withColumn("n", F.sum("t").over(Window.partitionBy()))  # a row a class
    tp, tt, ee, n = map(F.col, ("tp", "t", "e", "n"))

    def average(parts: tuple[Column, Column]) -> Column:
        a, b = parts
        if estimator == "micro":
            return F.try_divide(F.sum(a), F.sum(b))
        ratio = F.try_divide(a, b)
        return F.avg(ratio) if estimator == "macro" else F.try_divide(F.sum(ratio * tt), F.sum(F.when(ratio.isNotNull(), tt)))

    ratio = {k: f(tp, tt, ee, n) for k, f in PER_CLASS.items()}
    wide = {k: average(v) for k, v in ratio.items()}
    wide["j_index"] = wide["sens"] + wide["spec"] - 1
    wide["bal_accuracy"] = (wide["sens"] + wide["spec"]) / 2
    chance = F.sum(tt * ee) / F.max(n * n)
    wide["accuracy"] = F.sum(tp) / F.max(n)
    wide["kap"] = F.try_divide(wide["accuracy"] - chance, 1 - chance)
    spread = F.sqrt((F.max(n * n) - F.sum(ee * ee)) * (F.max(n * n) - F.sum(tt * tt)))
    wide["mcc"] = F.try_divide(F.max(n) * F.sum(tp) - F.sum(tt * ee), spread)
    out = each.agg(*[c.alias(k) for k, c in wide.items()])
    return out.unpivot([], list(wide), "metric", "value")


def roc_areas(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """roc_aunu and roc_aunp: areas under the curve of each class against the rest, averaged evenly or by the classes' shares.

    ``scores`` has the column of each class's probability.  The counts of
    distinct scores are summed up by class.
    """
    long = df.select(F.col(truth).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(p).cast("double").alias("s")) for c, p in scores.items()])).alias("e"))
    counts = long.groupBy("e.c", "e.s").agg(F.sum((F.col("y") == F.col("e.c")).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.withColumn("b", below).groupBy("c").agg(F.try_divide(F.sum(F.col("p") * (F.col("b") + (F.col("n") - F.col("p")) / 2)), F.sum("p") * F.sum(F.col("n") - F.col("p"))).alias("auc"), F.sum("p").alias("p"))
    return each.agg(F.avg("auc").alias("roc_aunu"), F.try_divide(F.sum(F.col("auc") * F.col("p")), F.sum("p")).alias("roc_aunp")).unpivot([], ["roc_aunu", "roc_aunp"], "metric", "value")


def probability_scores(df: DataFrame, truth: str, scores: dict[str, str], costs: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """mn_log_loss, brier_class, classification_cost and ranked_prob_score of any number of classes.

    A cost is 1 off the diagonal unless ``costs`` (truth, estimate) says
    otherwise; ranks of classes are their places in ``scores``.
    """
    names = list(scores)
    p = {c: F.col(scores[c]).cast("double") for c in names}
    hit = {c: (F.col(truth) == c).cast("double") for c in names}
    add = lambda parts: sum(parts[1:], parts[0])
    tiny = 2.220446049250313e-16
    right = add([hit[c] * F.least(F.greatest(p[c], F.lit(tiny)), F.lit(1 - tiny)) for c in names])
    cost = add([hit[t] * p[e] * float((costs or {}).get((t, e), float(t != e))) for t in names for e in names])
    ranked = add([add([p[c] - hit[c] for c in names[: i + 1]]) ** 2 for i in range(len(names) - 1)]) / (len(names) - 1)
    wide = df.where(F.col(truth).isin(names)).agg(F.avg(-F.log(right)).alias("mn_log_loss"), F.avg(add([(p[c] - hit[c]) ** 2 for c in names]) / 2).alias("brier_class"), F.avg(cost).alias("classification_cost"), F.avg(ranked).alias("ranked_prob_score"))
    return wide.unpivot([], wide.columns, "metric", "value")
