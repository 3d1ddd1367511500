"""Language ID: multinomial naive Bayes over hashed character n-grams.

Lower-cased letters and the gaps between words form n-grams of 1 to 4
characters, hashed to buckets.  The smoothed log-probabilities of the buckets
by language are a matrix that is broadcast; a batch of texts is scored by
gathering its rows and adding them up by text.  The prior of a language is its
share of all documents learned from; the language is that of the largest
posterior, and the score is the posterior at a temperature of the square root
of the number of letters, as n-grams are not independent.

Defined results: a null text, or one without a letter, gets ``und`` and score
0.  Ties go to the language that sorts first.  A null id is predicted for but
never learned from; of rows with equal ids one is learned from.  Very long
texts are read whole, in pieces that share the words between them.  Without
training rows every row gets ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fold, one_by_id, quoted, small_batches
from ._points import LETTER, Points, pieces

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Words that two pieces of a long text share: more than an n-gram can span.
OVERLAP = 4


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # bucket x language
    prior: np.ndarray


def _grams(texts: list[str]):
    """For each order the bucket of each n-gram that holds a letter, and the number of its text."""
    x = Points(texts)
    letter = x.among(LETTER)
    codes = np.where(letter, x.codes, 32)
    gap = np.flatnonzero(~letter[1:] & ~letter[:-1]) + 1  # a run of gaps counts once
    keep = np.ones(len(codes), bool)
    keep[gap] = False
    kept = np.cumsum(keep)
    first, last = kept[x.first - 1], kept[x.last - 1]
    x.hashed(codes[keep])
    solid = letter[keep]
    for n in ORDERS:
        m = len(solid) - n + 1
        if m <= 0:
            continue
        h = x.gram(n, BITS, n)
        ok = solid[:m].copy() if n == 1 else solid[:m] | solid[1 : m + 1]
        yield n, h, ok, first, last, solid


def _by_text(values: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows ``[first - 1, last - n + 1)``: the n-grams within each text and the gap before it."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    a = np.clip(first - 1, 0, len(values))
    b = np.clip(last - n + 1, a, len(values))
    return total[b] - total[a]


def log_likelihood(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood by text and language, and the number of letters of each text."""
    k = len(model.languages)
    out, letters = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for at, run, sign in pieces(texts, words=OVERLAP):
        for n, h, ok, first, last, solid in _grams(run):
            rows = model.log_prob[h]
            rows[~ok] = 0
            np.add.at(out, at, _by_text(rows, first, last, n) * sign[:, None])
            if n == 1:
                np.add.at(letters, at, _by_text(solid[:, None].astype(np.int32), first, last, 1)[:, 0].astype(np.int64) * sign)
    return out, letters


def gram_counts(texts) -> np.ndarray:
    """How often each bucket's n-grams occur within the texts."""
    size = 1 << BITS
    out = np.zeros(size)
    for _, run, sign in pieces(texts, words=OVERLAP):
        for n, h, ok, first, last, _ in _grams(run):
            weight = np.zeros(len(h) + 1)  # that of the text an n-gram lies in; 0 between texts
            start = np.clip(first - 1, 0, len(h))
            np.add.at(weight, start, sign)
            np.add.at(weight, np.clip(last - n + 1, start, len(h)), -sign)
            out += np.bincount(h[ok], weights=np.cumsum(weight)[:-1][ok], minlength=size)
    return out


def train(texts: list[str], langs: list[str], documents: dict[str, int] | None = None, smoothing: float = 0.5) -> LanguageModel:
    """``documents`` has the number of documents of each language, by default those given."""
    names = sorted(set(langs), key=lambda s: s.encode("utf-8", "surrogatepass"))
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    counts = np.stack([gram_counts(t for t, lang in zip(texts, langs, strict=True) if lang == name) for name in names]) + smoothing
    log_prob = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    n = np.array([(documents or {}).get(name) or langs.count(name) for name in names], float)
    return LanguageModel(names, np.ascontiguousarray(log_prob), np.log(n / n.sum()))


def fit(docs: DataFrame, per_lang: int = 400, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns n-grams from at most ``per_lang`` documents of each language (those
    with the smallest id hashes) whose ``crc32(id) mod folds`` is not
    ``held_out``, and priors from all of these."""
    spark = docs.sparkSession
    known = docs.select(quoted(id_col).cast("long").alias("__id"), quoted(lang_col).cast("string").alias("__lang")).where(F.col("__lang").isNotNull() & (fold("__id", folds) != held_out))
    counts = {r[0]: r[1] for r in known.groupBy("__lang").count().collect()}  # a row a language
    if not counts:
        return train([], [])
    # ids whose hashes are low enough for about twice per_lang a language, of which the lowest are taken
    share = spark.createDataFrame([(name, 2.0 * per_lang / n) for name, n in counts.items()], "__lang string, __share double")
    low = known.join(F.broadcast(share), "__lang").where(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < F.col("__share") * (1 << 40)).distinct()
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)), "__id"))
    ids = low.withColumn("__r", rank).where(F.col("__r") <= per_lang).select("__id").distinct()
    rows = docs.where(quoted(lang_col).isNotNull()).select(quoted(id_col).cast("long").alias("__id"), F.struct(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text")).alias("__row"))
    sample = one_by_id(rows.join(F.broadcast(ids), "__id"))  # ids: per_lang a language at most
    return train(sample["text"].fillna("").tolist(), sample["lang"].tolist(), counts)


def predict_language(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior probability, tempered by
    the number of letters) of every row."""
    spark = docs.sparkSession
    model = model or fit(docs, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(col: pa.Array) -> pa.Array:
        m = shared.value
        texts = col.to_pylist()
        names = ["und"] * len(texts)
        score = np.zeros(len(texts))
        if m.languages:
            z, letters = log_likelihood(texts, m)
            z += m.prior
            best = z.argmax(1)
            p = np.exp((z - z.max(1, keepdims=True)) / np.sqrt(np.maximum(1, letters))[:, None])
            p /= p.sum(1, keepdims=True)
            known = letters > 0
            names = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("__text"))
    out = rows.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), predict("__text").alias("__p"))
    return out.select("doc_id", "held_out", "__p.lang_pred", "__p.score")
