"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit i is set if more than half of its word
shingles' hashes have it set.  Texts whose fingerprints differ in ``radius``
bits or fewer are linked; components of links are groups.

Covering: every bit gets a nonzero vector of radius + 1 binary digits, and each
of the 2**(radius + 1) - 1 nonzero vectors v gives a table whose mask keeps the
bits with odd inner product with v.  Any ``radius`` vectors leave some v
orthogonal to them all, so every pair within the radius agrees on the mask of
some table: no link is lost.

Equal fingerprints are collapsed first.  Buckets are compared as blocks of at
most ``block`` fingerprints, in numpy, and a pair of blocks yields a spanning
forest of its links, not the links: as many rows as fingerprints.

Defined results: a null or empty text has fingerprint 0, linked like any other.
A null id takes part; a component's id is its smallest id that isn't null.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from ._common import quoted, small_batches, written
from .components import components, local_forest


def masks(radius: int) -> list[int]:
    """The bit masks of the covering tables.

    Each of the 64 bits gets a nonzero vector of ``radius + 1`` digits.  Any
    choice covers; of 200 seeded ones the choice whose lightest mask keeps most
    bits is taken, so that no table's buckets are crowded by chance.
    """
    width = radius + 1
    last = (1 << width) - 1
    best: list[int] = []
    for seed in range(200):
        order = random.Random(seed).sample(range(1, last + 1), last)
        vectors = [order[i % last] for i in range(64)]
        made = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, last + 1)]
        if not best or min(m.bit_count() for m in made) > min(m.bit_count() for m in best):
            best = made
    return best


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 1:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    stop = end[shingle - 1 :].tolist()
    hashes = np.fromiter((h(line[s:e], seed) for s, e in zip(start, stop, strict=True)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        count += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprints as signed 64-bit integers."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def of(col: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle, seed) for t in col.to_pylist()], np.uint64).view(np.int64), pa.int64())

    return of(text)


def near_pairs_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the radius, within ``a`` or, with ``b``, between the two."""
    found_u, found_v = [], []
    x = a.view(np.uint64)
    y = x if b is None else b.view(np.uint64)
    for i in range(0, len(x), 256):
        near = np.bitwise_count(x[i : i + 256, None] ^ y[None, :]) <= radius
        r, c = np.nonzero(near)
        if b is None:
            r, c = r[c > r + i], c[c > r + i]
        if len(r):
            u, v = local_forest(x[i + r].view(np.int64), y[c].view(np.int64))
            found_u.append(u)
            found_v.append(v)
    if not found_u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_forest(np.concatenate(found_u), np.concatenate(found_v))


def links(fingerprints: DataFrame, radius: int = 2, block: int = 512) -> DataFrame:
    """Edges (u, v) between the fingerprints of column ``fp`` (distinct), with the components of all links within the radius."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = fingerprints.select("fp", table.alias("b")).select("fp", "b.t", "b.key")
    counts = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = written(rows.join(counts, ["t", "key"]), "buckets")

    def compare(pdf_a: np.ndarray, pdf_b: np.ndarray | None) -> pd.DataFrame:
        u, v = near_pairs_forest(pdf_a, pdf_b, radius)
        return pd.DataFrame({"u": u, "v": v})

    # buckets of one block, several to a batch: a list is at most `block` long
    lists = full.where(F.col("n") <= block).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def small(batches):
        for batch in batches:
            us, vs = [], []
            col = batch.column(0)
            values, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            pairs = np.diff(at) == 2
            a, b = values[at[:-1][pairs]], values[at[:-1][pairs] + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
            us.append(np.maximum(a, b)[near])
            vs.append(np.minimum(a, b)[near])
            for s, e in zip(at[:-1][~pairs].tolist(), at[1:][~pairs].tolist(), strict=True):
                u, v = near_pairs_forest(values[s:e], None, radius)
                us.append(u)
                vs.append(v)
            u, v = local_forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    edges = lists.mapInArrow(small, "u long, v long")
    # larger buckets: every pair of blocks is a group of two blocks at most
    k = F.ceil(F.col("n") / (block // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    large = full.where(F.col("n") > block).withColumn("k", k).withColumn("mine", mine)
    sent = large.select("fp", "t", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    sent = sent.select("fp", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"))

    def block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, second = pdf["fp"].to_numpy(), pdf["second"].to_numpy()
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        return compare(fp, None) if i == j else compare(fp[~second], fp[second])

    return edges.unionByName(sent.groupBy("t", "key", "i", "j").applyInPandas(block_pair, "u long, v long"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id of every row of ``docs``."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("__text"))
    prints = written(rows.select("doc_id", simhash(docs, F.col("__text"), shingle).alias("fp")), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tied = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(tied, distinct["fp"] == tied["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(rooted.join(smallest, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of texts whose five-word shingles are 0.8 alike; see ``near_copies``."""
    return near_copies.drop_near_copies(docs, id_col=id_col, text_col=text_col)
