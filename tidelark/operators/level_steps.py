"""Steps over levels of text columns, checks of classes, and a filter by the area under the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.recipe import Step
from ..plans.selectors import all_nominal, all_numeric


def levels(df: DataFrame, cs: list[str], most: int = 10_000) -> dict[str, list]:
    """The sorted training levels; raises beyond ``most``, as each becomes a literal of the plan."""
    out = {}
    for c in cs:
        rows = df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{c} has more than {most} levels")
        out[c] = sorted(r[0] for r in rows)
    return out


def step_string2factor(columns=None, levels_: list[str] | None = None) -> Step:
    """Values that are no level (those given, or those of the training data) become null."""
    learn = (lambda df, cs: dict.fromkeys(cs, list(levels_))) if levels_ else levels
    return Step("string2factor", columns, all_nominal(), None, learn, lambda df, cs, k: df.withColumns({c: F.when(F.col(c).isin(k[c]), F.col(c)) for c in cs}) if cs else df)


def step_factor2string(columns=None) -> Step:
    return Step("factor2string", columns, all_nominal(), project=lambda df, cs, k: df.withColumns({c: F.col(c).cast("string") for c in cs}) if cs else df)


def step_unorder(columns=None) -> Step:
    """Levels have no order here, so the values stay as they are."""
    return Step("unorder", columns, all_nominal())


def step_dummy_multi_choice(columns, prefix: str | None = None, threshold: float = 0.0) -> Step:
    """A 0/1 column for each level that any of the columns takes; levels in fewer than ``threshold`` of the rows add to ``other``."""

    def learn(df, cs):
        taken = F.array_distinct(F.array_compact(F.array(*map(F.col, cs))))
        counts = df.select(F.explode(taken).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        rows = df.count()
        return {"levels": sorted(r["v"] for r in counts.where(F.col("n") >= threshold * rows).limit(10_000).collect())}

    def project(df, cs, k):
        name = prefix or cs[0]
        taken = F.array_compact(F.array(*map(F.col, cs)))
        new = {f"{name}_{v}": F.array_contains(taken, v).cast("int") for v in k["levels"]}
        if threshold > 0:
            new[f"{name}_other"] = (F.size(F.array_except(taken, F.array(*map(F.lit, k["levels"])))) > 0).cast("int")
        return df.withColumns(new).drop(*cs)

    return Step("dummy_multi_choice", columns, None, None, learn, project)


def check_class(columns=None) -> Step:
    """Raises when data that is baked has a column of another type than in training."""

    def project(df, cs, k):
        wrong = {c: t for c, t in df.dtypes if c in k and t != k[c]}
        if wrong:
            raise TypeError(f"columns changed their type: {wrong}, trained on { {c: k[c] for c in wrong} }")
        return df

    return Step("check_class", columns, None, None, lambda df, cs: {c: t for c, t in df.dtypes if c in cs}, project)


def roc_auc_of(df: DataFrame, outcome: str, cs: list[str]) -> DataFrame:
    """column_name and auc of each column as a score of a 0/1 outcome; below a half the other way round."""
    long = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("s")) for c in cs])).alias("e"))
    counts = long.where("e.s IS NOT NULL").groupBy("e.c", "e.s").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = F.try_divide(F.sum(F.col("p") * (F.col("b") + (F.col("n") - F.col("p")) / 2)), F.sum("p") * F.sum(F.col("n") - F.col("p")))
    return counts.withColumn("b", below).groupBy(F.col("c").alias("column_name")).agg(F.greatest(auc, 1 - auc).alias("auc"))


def step_filter_roc_auc(outcome: str, columns=None, threshold: float | None = None, top_n: int | None = None) -> Step:
    """Columns whose area under the curve is below ``threshold``, or not among the ``top_n``, go; ties in order of name."""

    def learn(df, cs):
        cs = [c for c in cs if c != outcome]
        order = sorted(((-(r["auc"] or 0.0), r["column_name"]) for r in roc_auc_of(df, outcome, cs).collect()))  # a row a column
        known = {c: -a for a, c in order}
        keep = [c for a, c in order if threshold is None or -a >= threshold][:top_n]
        return {"auc": known, "drop": [c for c in cs if c not in keep]}

    return Step("filter_roc_auc", columns, all_numeric(), None, learn, lambda df, cs, k: df.drop(*k["drop"]))
