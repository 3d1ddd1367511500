"""Mixing sources to target weights by systematic sampling.

Sources take shares of a total number of words in proportion to weights; a
source's target stops at ``cap`` times its size, and the excess is shared again
by weight until no target is above.  Within a source every document expects
``target / size`` copies; along the documents in order of size the expected
copies are summed up, one random offset is added (drawn for each source from
the seed), and a document is emitted once for each whole number that its
stretch of the sum crosses.  As neighbours in that
order are alike in size, the words taken come within about one document of the
target.

The sum is distributed: rows are dealt out by ranges of (source, size, id), so
a hot source fills many partitions; each partition counts its rows by source,
and the running totals of those counts (a row for each partition and source in
it) give each row its place.

Defined results: a null text has size 0, a null source is a source of its own,
sorted last; null ids sort first among equal sizes; a source of size 0 has
target 0 and takes nothing.  Repeated rows are separate documents; ties of size
and id have equal chances and texts of any length count by their words alone.
An empty table gives no rows.  Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, quoted, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """__source, source_size and target of each source of ``sized`` (columns __source, __size).

    With the sources in order of cap over weight, the first k are capped where
    the rest, sharing what is left, stay below the next one's cap.  One row a
    source is all that the running sums see.
    """
    sums = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    # names compare by code point: by their UTF-8 bytes
    rank = F.row_number().over(Window.orderBy(F.col("__source").cast("binary").asc_nulls_last()))
    cycle = F.array(*map(F.lit, weights))
    ranked = sums.withColumn("__w", F.get(cycle, (rank - 1) % len(weights)).cast("double")).withColumn("__cap", (F.col("source_size") * cap).cast("double"))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").cast("binary").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum(F.col("source_size").cast("double")).over(every) * share[0] / share[1]
    level = (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("__level", level)
    # the first source that stays below its cap sets the level of all
    fits = F.min(F.when(F.col("__level") < F.col("__cap") / F.col("__w"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("__level")))).over(every)["__level"]
    target = F.when(fits.isNull() | (F.col("__cap") / F.col("__w") <= fits), F.col("__cap")).otherwise(fits * F.col("__w"))
    return levelled.select("__source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random start of a source: 32 bits of the digest of seed and name, as a fraction of 1; the null source has the seed's own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 42) -> DataFrame:
    """``rows`` (columns __id, __source, __size and row) with __source_size, __target and __copies; each row goes through one shuffle."""
    spark = rows.sparkSession
    order = [F.col("__source").asc_nulls_last(), F.col("__size"), F.col("__id").asc_nulls_first()]
    # a partition and place for each row, fixed by writing them
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    dealt = written(dealt, "mixture").withColumn("__part", F.shiftright("__row", 33))
    spans = dealt.groupBy("__part", "__source").agg(F.min("__row").alias("__from"), F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("__ahead", ahead)
    targets = source_targets(dealt, weights, share, cap)
    plan = spans.withColumnRenamed("__source", "__s").join(targets, F.col("__s").eqNullSafe(F.col("__source"))).select(F.col("__part").alias("__p"), "__s", "__from", "__ahead", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), offset(F.col("__s"), seed).alias("__offset"))
    plan = written(plan, "mixture-plan")
    placed = dealt.join(plan, (F.col("__part") == F.col("__p")) & F.col("__source").eqNullSafe(F.col("__s")))
    place = F.col("__ahead") + F.col("__row") - F.col("__from")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    crossed = lambda n: F.floor(rate * n + F.col("__offset"))
    return placed.select("__id", "__size", "row", "__source_size", "__target", (crossed(place + 1) - crossed(place)).alias("__copies"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    return docs.select(quoted(id_col).alias("__id"), quoted(source_col).cast("string").alias("__source"), word_count(quoted(text_col)).alias("__size"), row.alias("row"))


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; texts are read once and not moved."""
    # written before rows are dealt by ranges, which looks at them twice
    sized = written(_keyed(docs, id_col, text_col, source_col, F.lit(None).cast("int")), "sizes")
    out = with_copies(sized, **options)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its copies say, with the columns as they are."""
    out = with_copies(_keyed(docs, id_col, text_col, source_col, F.struct(*[quoted(c) for c in docs.columns])), **options)
    many = out.where(F.col("__copies") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))))
    return many.select("row.*")
