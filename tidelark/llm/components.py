"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_scratch, written_at


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, itself left out."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _shrunk(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the connectivity of ``edges`` within each batch and no cycles there."""

    def forest(batches):
        for pdf in batches:
            u, v = local_forest(pdf["u"].to_numpy(), pdf["v"].to_numpy())
            yield pd.DataFrame({"u": u, "v": v})

    return edges.mapInPandas(forest, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the smallest node of u's component, for every node but those smallest.

    ``edges`` has long columns u and v in any order.  Alternating large-star
    and small-star steps: every node's neighbours are tied to the smallest of
    them.  Minima are aggregated before the shuffle; the joins that send them
    back are equi-joins whose large side AQE can split at a hub.  Each round is
    written to the shared folder, the one before it deleted.  Rounds go on until
    one changes no edge: each ties some node to a smaller one, so they end, as
    a rule after about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    turned = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path = written_at(_shrunk(turned.distinct()).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new, new_path = written_at(small, "edges")
        drop_scratch(spark, path)
        now, path = new, new_path
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if seen == mark or seen[0] == 0:
            return now
        mark = seen
