"""Document fingerprints: exact digests of canonical texts, in DataFrame functions only.

A text's canonical form is its compatibility normalisation (NFKC), case folding
and runs of white space made one space.  Its fingerprint is 128 bits of xxhash
of that form.  Texts with equal hashes are compared byte by byte, so that a
collision would show: it gets a number behind the hash.

Likeness of two texts is 1 if their canonical forms are the same bytes, else 0:
an exact digest knows nothing between.

Defined results: a null text counts as empty.  Rows with equal ids follow each
other by the hashes of their texts; null ids come last.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, quoted, written


def _icu(class_name: str, method: str, text: Column, flag: bool) -> Column:
    return F.reflect(F.lit(class_name), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """The canonical form; ASCII texts need no normalisation.  Not for null."""
    plain = F.length(text) == F.octet_length(text)
    nfkc = lambda c: _icu("com.ibm.icu.text.Normalizer", "compose", c, True)
    folded = nfkc(_icu("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text), True))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"(?U)\s+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit("wide"), form)))


def _boundaries(rows: DataFrame, key: str, ranges: int) -> list[int]:
    """Ids that part the rows into about equal ranges; at most 65,535 of them."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    return sorted(set(rows.agg(F.percentile_approx(key, at, min(10 * ranges, 1_000_000))).first()[0] or []))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are at most ``key``, by two looks at about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.from_json(F.lit(json.dumps([x[0] for x in fine])), "array<bigint>")
    nested = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    block = F.size(F.filter(coarse, lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(F.get(nested, block - 1), lambda b: b <= key)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 4096) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending order of ids, after the last the first.

    Ranges of ids, about equal in rows, are sorted apart from each other; only
    the first row of each range (a row a range) crosses to the range before.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    n, some = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return rows.withColumn("next_text", F.lit(""))
    ranges = min(65_536, max(2 * partitions(spark), math.ceil(n / rows_a_range)))  # two a partition even out
    bounds = _boundaries(rows, "doc_id", ranges)
    key = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_range_of(F.col("doc_id"), bounds) + 1).cast("int")
    dealt = rows.withColumn("__range", key).withColumn("__hash", F.xxhash64("text"))
    down = Window.partitionBy("__range").orderBy(F.col("doc_id").desc_nulls_last(), "__hash")
    # the first text of each range and the range that needs it
    top = rows.withColumn("__range", key)
    heads = top.groupBy("__range").agg(F.max("doc_id").alias("__id"))
    before = F.coalesce(F.lag("__range").over(Window.orderBy(F.col("__range").desc())), F.min("__range").over(Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(heads.select("__range", "__id", before.alias("__before")), "range-heads")
    ids = [r for r in heads.collect()]  # a row a range
    wanted = sorted(r["__id"] for r in ids if r["__id"] is not None)
    chosen = F.col("doc_id").isin(wanted)
    if some < n:
        chosen = chosen | F.col("doc_id").isNull()
    first_text = top.where(chosen).groupBy("__range", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("__t"))
    heads = heads.join(first_text, (heads["__range"] == first_text["__range"]) & heads["__id"].eqNullSafe(first_text["doc_id"])).select(F.col("__before").alias("__range"), F.col("__t.text").alias("__head"))
    return dealt.withColumn("__next", F.lead("text").over(down)).join(heads, "__range").select("doc_id", "text", F.coalesce("__next", "__head").alias("next_text"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points
    replaced by the first as many of the next document.
    """
    pairs = with_next(docs, id_col, text_col)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = pairs.select("doc_id", "text", "next_text", size.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = rows.select("*", canonical(F.col("text")).alias("__a"), canonical(F.col("edited")).alias("__b"), canonical(F.col("next_text")).alias("__c"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), wide_hash(F.col("__a")).alias("fingerprint"), wide_hash(F.col("__b")).alias("edited_fingerprint"), same("__a", "__b").alias("near_edited"), same("__a", "__c").alias("near_next"))


#: Bits of the filter that says which hashes may occur more than once: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def _filter_of(hashes: DataFrame, name: str) -> DataFrame:
    """Rows of ``FILTER_BITS / 32768`` bitmaps at most, with the bits of all values of a hash column."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    return hashes.select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def _may_hold(rows: DataFrame, name: str, bitmaps: DataFrame) -> DataFrame:
    """The rows whose hash may be among those of ``_filter_of``."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmaps), "__bucket")
    return marked.where(F.get(F.array(*[F.shiftright(byte, i).bitwiseAND(1) for i in range(8)]), (bit % 8).cast("int")) == 1).drop("__bucket", "__bits")


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """doc_id, hash, fingerprint, group_id (smallest id of an equal canonical text) and group_size.

    Only hashes and ids are grouped.  Inside each hash that occurs more than
    once, canonical texts are compared byte by byte with the one of the
    smallest id: the members of a bucket go to salted blocks, to each of which
    that one text is sent, so no task gets a whole hot bucket.  A filter of
    fixed size keeps the texts of all other hashes from being moved.  Texts
    that differ (a collision) are told apart by a second digest.  One row for
    each distinct id and hash.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), canonical(F.coalesce(quoted(text_col), F.lit(""))).alias("__form"))
    keyed = rows.withColumn("hash", wide_hash(F.col("__form")))
    hashed = written(keyed.select("doc_id", "hash"), "hashes")
    counts = written(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("__n"), F.min("doc_id").alias("__first")).where(F.col("__n") > 1), "buckets")
    texts = _may_hold(keyed, "hash", _filter_of(counts, "hash")).join(counts, "hash")
    blocks = F.ceil(F.col("__n") / block).cast("long")
    members = texts.select("doc_id", "hash", "__form", F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks).alias("__block"))
    # a bucket without ids has no smallest one; its rows stand for themselves
    lead = texts.where(F.col("doc_id") == F.col("__first")).groupBy("hash").agg(F.min("__form").alias("__lead"), F.first(blocks).alias("__blocks"))
    lead = lead.select("hash", "__lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block"))
    odd = members.join(lead, ["hash", "__block"]).where(F.col("__form") != F.col("__lead"))
    odd = written(odd.select("doc_id", "hash", F.concat("hash", F.lit("-"), F.substring(F.sha2(F.col("__form").cast("binary"), 256), 1, 16)).alias("__own")).distinct(), "collisions")
    named = hashed.distinct().join(odd, ["doc_id", "hash"], "left").select("doc_id", "hash", F.coalesce("__own", "hash").alias("fingerprint"))
    sizes = hashed.join(odd, ["doc_id", "hash"], "left").groupBy(F.coalesce("__own", "hash").alias("fingerprint")).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id")).where(F.col("group_size") > 1)
    sizes = written(sizes, "groups")  # so that the join reads both sides anew and can split a hot group
    return named.join(sizes, "fingerprint", "left").select("doc_id", "hash", "fingerprint", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprint_pairs`` with the group of each document; one row for each row of ``docs``."""
    pairs = fingerprint_pairs(docs, id_col, text_col)
    groups = fingerprint_groups(docs, id_col, text_col).withColumnRenamed("doc_id", "__id").withColumnRenamed("fingerprint", "__named")
    both = pairs.join(groups, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("hash")))
    return both.select("doc_id", "n_chars", "edited_sha256", F.col("__named").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")
