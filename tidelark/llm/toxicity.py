"""Toxicity: bags of subwords, embedded, averaged and put into a linear softmax.

A word is a run of letters, lower-cased.  Its subwords are its character
n-grams of 3 to 5 (with a mark at either end) and the word itself, hashed to
buckets with an embedding each.  A word's vector is the mean of its subwords',
a window's the mean of its words', and a linear softmax turns it into classes;
embeddings and softmax are trained together in numpy.  A misspelling that was
never seen shares most n-grams with the word that it stands for.

A document is scored by its most toxic window of ``window`` words, as a few
words among thousands would vanish in the mean of the whole text.  Every window
of the whole text counts, whichever word it begins with.

As both steps are linear, the softmax margin of a bucket is one number: scoring
gathers a number for each subword, not a vector, with the same result.

Defined results: a null or empty text, or one without letters, has nothing
toxic in it and score 0.  A null id is scored but never trained on; repeated
rows are scored alike and learned from once.  Very long texts are read whole,
in pieces that share the words of a window.  Without labelled rows of both
classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, quoted, small_batches
from ._points import LETTER, Points, pieces, runs

BITS = 17
ORDERS = (3, 4, 5)


@dataclass
class ToxicityModel:
    """``margin[bucket]``: toxic minus clean logit of a subword."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    window: int

    @property
    def margin(self) -> np.ndarray:
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)


def _subwords(texts: list[str]):
    """Words of a chunk: text number and span, then bucket and word number of each subword."""
    x = Points(texts)
    letter = x.among(LETTER)
    s, e = runs(letter)
    codes = np.where(letter, x.codes, 32)
    x.hashed(codes)
    word_at = np.zeros(len(codes) + 1, np.int32)
    word_at[s] = 1
    word_at = np.cumsum(word_at, dtype=np.int32) - 1
    stop = np.full(len(codes), len(codes), np.int64)  # the next position without a letter
    stop[~letter] = np.flatnonzero(~letter)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    buckets, owners = [x.hash(s, e, BITS, 1)], [np.arange(len(s), dtype=np.int32)]
    for n in ORDERS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        inside = letter[1 : m + 1] & (stop[1 : m + 1] - np.arange(m) >= n - 1)
        buckets.append(x.gram(n, BITS, n)[inside])
        owners.append(word_at[1 : m + 1][inside])
    text_of = np.searchsorted(x.first, s, "right") - 1
    return x, s, e, text_of, np.concatenate(buckets), np.concatenate(owners)


def _window_starts(number: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows and the words behind their last, of words that stand in order of their texts."""
    i = np.arange(len(number))
    last = np.searchsorted(number, number, "right")
    start = np.flatnonzero((i + window <= last) | (np.searchsorted(number, number, "left") == i))
    return start, np.minimum(start + window, last[start])


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(values)))


def window_margins(texts: list[str], margin: np.ndarray, window: int) -> np.ndarray:
    """The largest mean margin of any window of each text; minus infinity without words."""
    texts = list(texts)
    best = np.full(len(texts), -np.inf)
    for at, run, sign in pieces(texts, words=window - 1):
        _, s, _, text_of, bucket, owner = _subwords(run)
        if not len(s):
            continue
        later = np.append(sign[1:] < 0, False)  # pieces that go on with a text
        total = _running(np.bincount(owner, weights=margin[bucket], minlength=len(s)) / np.bincount(owner, minlength=len(s)))
        start, end = _window_starts(text_of, window)
        of = text_of[start]
        counts = (sign[of] > 0) & ~(later[of] & (end - start < window))
        start, end = start[counts], end[counts]
        np.maximum.at(best, np.asarray(at)[text_of[start]], (total[end] - total[start]) / (end - start))
    return best


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its text and its number; of each distinct word the buckets, and where they begin."""
    number, keys, buckets, sizes, known = [], [], [], [], np.zeros(0, np.int64)
    for at, run, sign in pieces(texts, 1 << 18):
        x, s, e, text_of, bucket, owner = _subwords(run)
        key = x.hash(s, e, 62, 2)
        keys.append(key)
        number.append(np.asarray(at, np.int32)[text_of])
        # only the first meeting of a word gives its subwords
        new, where = np.unique(key, return_index=True)
        fresh = ~np.isin(new, known, assume_unique=True)
        word = np.full(len(s), -1, np.int64)
        word[where[fresh]] = np.arange(int(fresh.sum()))
        mine = word[owner]
        order = np.argsort(mine[mine >= 0], kind="stable")
        buckets.append(bucket[mine >= 0][order].astype(np.int32))
        sizes.append(np.bincount(mine[mine >= 0], minlength=int(fresh.sum())))
        known = np.concatenate((known, new[fresh]))
    order = np.argsort(known)
    token = order[np.searchsorted(known, np.concatenate(keys), sorter=order)].astype(np.int32) if len(known) else np.zeros(0, np.int32)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(number) if number else np.zeros(0, np.int32), token, np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(size)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of spans, one after the other, and the span each is of."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes), of


def train(texts: list[str], labels: np.ndarray, dim: int = 8, window: int = 3, epochs: int = 40, warm: int = 3, hard: int = 3, batch: int = 128, rate: float = 40.0, toxic_share: float = 0.4, seed: int = 1) -> ToxicityModel:
    """Stochastic descent on the cross entropy, of embeddings, softmax and bias together.

    For ``warm`` epochs an example is the mean of a whole text; then it is one
    of the windows that the model itself finds worst, one of a toxic text and
    ``hard`` of a clean one, chosen anew each epoch.  The rate falls to nothing
    in even steps.  Steps are not scaled by feature, so an n-gram moves by how
    many texts agree on it.  ``toxic_share`` of the loss is the toxic class's.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, int)
    number, token, bucket, at = _vocabulary(texts)
    if not len(token) or len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros((1 << BITS, dim), np.float32), np.zeros((dim, 2), np.float32), np.array([50.0, -50.0]), window)
    n_sub = np.diff(at)
    E = np.zeros((1 << BITS, dim))
    E[np.unique(bucket)] = rng.normal(0, 0.02, (len(np.unique(bucket)), dim))
    W = np.array([-0.5, 0.5]) + rng.normal(0, 0.1, (dim, 2))
    b = np.zeros(2)
    start, end = _window_starts(number, window)
    whole = np.searchsorted(number, np.arange(len(labels) + 1))
    for epoch in range(epochs):
        if epoch < warm:
            some = np.flatnonzero(np.diff(whole))
            first, size, y = whole[:-1][some], np.diff(whole)[some], labels[some]
        else:
            word = np.add.reduceat((E @ (W[:, 1] - W[:, 0]))[bucket], at[:-1]) / n_sub
            total = _running(word[token])
            mean = (total[end] - total[start]) / (end - start)
            order = np.lexsort((-mean, number[start]))
            of = number[start][order]
            worst = order[np.arange(len(order)) - np.searchsorted(of, of) < np.where(labels[of] == 1, 1, hard)]
            first, size, y = start[worst], (end - start)[worst], labels[number[start[worst]]]
        toxic = int(y.sum())
        weight = np.where(y == 1, toxic_share / max(1, toxic), (1 - toxic_share) / max(1, len(y) - toxic)) * len(y)
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            where, of = _spans(first[part], size[part])
            used, back = np.unique(token[where], return_inverse=True)
            share = np.zeros((len(part), len(used)))
            np.add.at(share, (of, back), 1 / size[part][of])
            where, owner = _spans(at[used], n_sub[used])
            sub, mine = np.unique(bucket[where], return_inverse=True)
            vectors = np.add.reduceat(E[sub][mine], np.concatenate(([0], np.cumsum(n_sub[used])))[:-1], axis=0) / n_sub[used][:, None]
            mean = share @ vectors
            z = mean @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(2)[y[part]]) * weight[part][:, None] / len(part)
            each = ((share.T @ (g @ W.T)) / n_sub[used][:, None])[owner]
            move = np.stack([np.bincount(mine, weights=each[:, d], minlength=len(sub)) for d in range(dim)], 1)
            E[sub] -= step * (move + 1e-3 * E[sub])
            W -= 0.05 * mean.T @ g
            b -= 0.1 * g.sum(0)
    return ToxicityModel(E.astype(np.float32), W.astype(np.float32), b, window)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", **options) -> ToxicityModel:
    """Fits on at most ``per_class`` labelled documents of each class whose ``crc32(id) mod folds`` is not 0."""
    rows = labelled_sample(docs, labels, label, per_class, fold("__id", folds) != 0, [text_col], id_col)
    return train(rows[text_col].fillna("").tolist(), rows["__y"].to_numpy(), **options)


def toxicity_score(docs: DataFrame, text: Column, model: ToxicityModel) -> Column:
    """Probability of the toxic class, of any text column of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.margin, model.window, float(model.bias[1] - model.bias[0])))

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        margin, window, bias = shared.value
        z = window_margins(col.to_pylist(), margin, window) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, repeated rows included."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, **options)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("__text"))
    out = rows.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), toxicity_score(docs, F.col("__text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", training_docs: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay as they are.

    The classifier learns from ``training_docs``, by default ``docs`` themselves.
    """
    model = fit(training_docs if training_docs is not None else docs, labels, id_col=id_col, text_col=text_col, **options)
    name = "__score"
    while name in docs.columns:
        name += "_"
    scored = docs.withColumn(name, toxicity_score(docs, quoted(text_col), model))
    return scored.where(F.col(name) < threshold).select(*[quoted(c) for c in docs.columns])
