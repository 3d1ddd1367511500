"""Quality: a factorisation machine of second order, trained and scored in numpy.

Features of a text: its words (runs between white space, lower-cased, hashed)
with damped counts, a few statistics of its structure, and metadata columns
(the number of characters that the table states).  The score is

    b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so all pairs of features interact through vectors of ``rank`` numbers, at a
cost linear in the number of features: no pair is ever formed.

Defined results: a null text counts as empty; null metadata as 0; a null id is
scored but never trained on.  Without labelled rows of both classes every score
is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, quoted, small_batches
from ._points import LETTER, SPACE, Points, Table, pieces, runs

BITS = 15
UPPER = Table(str.isupper)
DIGIT = Table(str.isdigit)
#: Numbers that describe the structure of a text, in this order.
STATISTICS = ("log words", "letters", "digits", "symbols", "capitals", "word length", "lines a word", "distinct words", "words with symbols", "words of symbols")


@dataclass
class QualityModel:
    bias: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of each hashed word (distinct within its text, values of unit length), and a row of STATISTICS by text."""
    texts = list(texts)
    rows = len(texts)
    sums = np.zeros((rows, 9))
    keys, counts = [], []
    for at, run, _ in pieces(texts):
        at = np.asarray(at)
        x = Points(run)
        raw = Points(run, lower=False)
        space, letter = x.among(SPACE), x.among(LETTER)
        s, e = runs(~space)
        text_of = np.searchsorted(x.first, s, "right") - 1
        x.hashed()
        key, n = np.unique(at[text_of].astype(np.int64) << BITS | x.hash(s, e, BITS, 3), return_counts=True)
        keys.append(key)
        counts.append(n)
        edge = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        symbol = edge(~letter & ~space & ~x.among(DIGIT))
        odd = symbol[e] - symbol[s]
        word = lambda values: np.bincount(text_of, weights=values, minlength=len(run))
        of = lambda p, mask: (c := edge(mask))[p.last] - c[p.first]
        np.add.at(sums, at, np.stack([word(np.ones(len(s))), of(x, letter), of(x, x.among(DIGIT)), symbol[x.last] - symbol[x.first], of(raw, raw.among(UPPER)), word(e - s), of(x, x.codes == 10), word(odd > 0), word(odd == e - s)], 1))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((rows, len(STATISTICS)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(counts))
    text, bucket = key >> BITS, key & ((1 << BITS) - 1)
    value = np.sqrt(n)
    length = np.sqrt(np.bincount(text, weights=value**2, minlength=rows))
    words, chars = np.maximum(1, sums[:, 0]), np.maximum(1, sums[:, 5])
    distinct = np.bincount(text, minlength=rows)
    dense = np.stack([np.log1p(sums[:, 0]), sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / np.maximum(1, sums[:, 1]), chars / words, sums[:, 6] / words, distinct / words, sums[:, 7] / words, sums[:, 8] / words], 1)
    return text, bucket, value / length[text], dense


def _dense(statistics: np.ndarray, metadata: np.ndarray, model: QualityModel) -> np.ndarray:
    return np.clip((np.concatenate([statistics, metadata], 1) - model.centre) / model.scale, -4, 4)


def decision(texts: list[str], metadata: np.ndarray, model: QualityModel) -> np.ndarray:
    """The machine's raw score of each text."""
    text, bucket, value, statistics = features(texts)
    n, size = len(statistics), 1 << BITS
    dense = _dense(statistics, metadata, model)
    out = model.bias + np.bincount(text, weights=model.w[bucket] * value, minlength=n) + dense @ model.w[size:]
    for f in range(model.v.shape[1]):
        vx = model.v[bucket, f] * value
        dx = dense * model.v[size:, f]
        total = np.bincount(text, weights=vx, minlength=n) + dx.sum(1)
        squares = np.bincount(text, weights=vx * vx, minlength=n) + (dx * dx).sum(1)
        out += 0.5 * (total * total - squares)
    return out


def train(texts: list[str], metadata: np.ndarray, labels: np.ndarray, rank: int = 4, epochs: int = 60, rate: float = 0.05, seed: int = 11) -> QualityModel:
    """Adam on the weighted log loss of the whole sample; both classes weigh alike."""
    labels = np.asarray(labels, int)
    rng = np.random.default_rng(seed)
    size, d = 1 << BITS, len(STATISTICS) + metadata.shape[1]
    text, bucket, value, statistics = features(texts)
    raw = np.concatenate([statistics, metadata], 1)
    model = QualityModel(0.0, np.zeros(size + d), rng.normal(0, 0.05, (size + d, rank)), raw.mean(0) if len(raw) else np.zeros(d), (raw.std(0) if len(raw) else np.ones(d)) + 1e-9)
    seen = np.zeros(size + d, bool)
    seen[bucket] = True
    seen[size:] = True
    model.v[~seen] = 0
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    dense = _dense(statistics, metadata, model)
    n = len(labels)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.w, model.v)]
    for step in range(1, epochs + 1):
        vx = [model.v[bucket, f] * value for f in range(rank)]
        dx = [dense * model.v[size:, f] for f in range(rank)]
        totals = [np.bincount(text, weights=a, minlength=n) + c.sum(1) for a, c in zip(vx, dx, strict=True)]
        squares = [np.bincount(text, weights=a * a, minlength=n) + (c * c).sum(1) for a, c in zip(vx, dx, strict=True)]
        z = model.bias + np.bincount(text, weights=model.w[bucket] * value, minlength=n) + dense @ model.w[size:] + 0.5 * sum(t * t - q for t, q in zip(totals, squares, strict=True))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weight
        gw = np.concatenate([np.bincount(bucket, weights=g[text] * value, minlength=size), dense.T @ g]) + 2e-5 * model.w
        gv = np.stack([np.concatenate([np.bincount(bucket, weights=g[text] * value * (totals[f][text] - vx[f]), minlength=size), (dense * (totals[f][:, None] - dx[f])).T @ g]) for f in range(rank)], 1) + 2e-5 * model.v
        for par, gr, (m, v) in zip((model.w, model.v), (gw, gv), state, strict=True):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            par -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        model.bias -= rate * 4 * g.sum()
        model.v[~seen] = 0
    return model


def fit(docs: DataFrame, labels: DataFrame, metadata_cols: tuple[str, ...] = ("n_chars",), per_class: int = 2500, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", **options) -> QualityModel:
    """Fits on at most ``per_class`` labelled documents of each class whose ``crc32(id) mod folds`` is not 0."""
    rows = labelled_sample(docs, labels, label, per_class, fold("__id", folds) != 0, [text_col, *metadata_cols], id_col)
    return train(rows[text_col].fillna("").tolist(), _metadata([rows[c].to_numpy(dtype=float, na_value=0) for c in metadata_cols], len(rows)), rows["__y"].to_numpy(), **options)


def _metadata(columns: list[np.ndarray], n: int) -> np.ndarray:
    return np.stack([np.log1p(np.maximum(0, np.nan_to_num(c))) for c in columns], 1) if columns else np.zeros((n, 0))


def quality_score(docs: DataFrame, text: Column, metadata: list[Column], model: QualityModel) -> Column:
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(col: pa.Array, meta: pa.Array) -> pa.Array:
        z = decision(col.to_pylist(), _metadata([meta.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(meta.type.num_fields)], len(col)), shared.value)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    return score(text, F.struct(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(metadata)]))


def score_quality(docs: DataFrame, labels: DataFrame, metadata_cols: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(docs, labels, metadata_cols, id_col=id_col, text_col=text_col, folds=folds, **options)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("__text"), *[quoted(c).alias(f"__m{i}") for i, c in enumerate(metadata_cols)])
    score = quality_score(docs, F.col("__text"), [F.col(f"__m{i}") for i in range(len(metadata_cols))], model)
    out = rows.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
