"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, langid, mixing, quality, secret_scan, simhash, token_files, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_through_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(n) for n, c in secret_scan.digest(F.col("secrets")).items()])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_nearest_neighbours, op2_mixture, op3_simhash, op4_quality, op5_token_files, op6_secrets, op7_toxicity, op8_bpe, op9_language, op10_fingerprints)
    return {f.__name__: f for f in every}


ORACLES = {
    "op2_mixture": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM sums),
        levels AS (SELECT *, ((SELECT sum(source_size) FROM sums)::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER b, 0)) AS level
            FROM ranked WINDOW b AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        chosen AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level < cap / w),
        targets AS (SELECT r.source, r.source_size, CASE WHEN c.level IS NULL OR r.cap / r.w <= c.level THEN r.cap ELSE c.level * r.w END AS target FROM ranked r CROSS JOIN chosen c),
        placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
            ('0x' || substr(md5('42:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
            row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, ((floor(rate * n + start) - floor(rate * (n - 1) + start)) * size)::BIGINT AS taken FROM placed
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
