"""Document quality by regularised quadratic discriminant analysis.

Every whole text is reduced to some transformed statistics.  Each class has a mean and a covariance
that is shrunk towards the pooled covariance and its diagonal; the Cholesky factors are computed
once and the score is the logistic of the difference of log densities (Mahalanobis distances and
log determinants) plus the log prior odds.  Moments are sums over all labelled rows, added up by
Spark; only sums of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk


@dataclass(frozen=True)
class QualityParams:
    """``pool``: weight of the pooled covariance in each class; ``diagonal``: weight of its diagonal;
    ``floor``: variance added to every statistic; ``threshold``: least score of the label 1."""

    pool: float = 0.1
    diagonal: float = 0.05
    floor: float = 1e-3
    threshold: float = 0.3


_KIND = np.zeros(256, dtype=np.int64)  # 0 other symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 5, 6
_KIND[[33, 39, 44, 45, 46, 58, 59, 63]] = 7
STATISTICS = [
    "log_words", "word_length", "word_length_spread", "symbols", "lower", "upper", "digits", "multibyte", "blanks",
    "lines", "punctuation", "distinct_words", "top_word", "repeated_pairs", "symbol_ends",
]


#: Every text is counted as if it had these more bytes and words of ordinary prose, so that the
#: shares of very short texts stay near the ordinary.
PRIOR_BYTES = 120 * np.array([0.0, 0.75, 0.03, 0.002, 0.04, 0.145, 0.008, 0.025])
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_SQUARE, PRIOR_DISTINCT, PRIOR_TOP = 20, 6.0, 45.0, 0.8, 0.05


def statistics(array: pa.Array) -> np.ndarray:
    """One row of :data:`STATISTICS` per text; an empty text has the prior's."""
    raw, bounds = tk.text_bytes(array)
    rows = len(bounds) - 1
    doc = np.repeat(np.arange(rows), np.diff(bounds))
    kinds = np.bincount(doc * 8 + _KIND[raw], minlength=rows * 8).reshape(rows, 8) + PRIOR_BYTES
    w = tk.words(array)
    count = np.diff(w.offsets)
    n = count + PRIOR_WORDS
    length = w.ends - w.starts
    mean = (np.bincount(w.doc, weights=length, minlength=rows) + PRIOR_WORDS * PRIOR_LENGTH) / n
    square = (np.bincount(w.doc, weights=length.astype(float) ** 2, minlength=rows) + PRIOR_WORDS * PRIOR_SQUARE) / n
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    ends = np.bincount(w.doc, weights=_KIND[w.data[w.ends - 1]] == 0, minlength=rows) / n
    pairs = tk.windows(w.hashes, 2)
    distinct, top, again = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for k in np.flatnonzero(count):
        lo, hi = w.offsets[k], w.offsets[k + 1]
        ordered = np.sort(w.hashes[lo:hi])
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        distinct[k], top[k] = len(cuts) - 1, np.diff(cuts).max()
        if hi - lo > 2:
            two = np.sort(pairs[lo : hi - 1])
            again[k] = np.count_nonzero(two[1:] == two[:-1])
    distinct, top, again = (distinct + PRIOR_DISTINCT * PRIOR_WORDS) / n, (top + PRIOR_TOP * PRIOR_WORDS) / n, again / n
    share = kinds / kinds.sum(axis=1, keepdims=True)
    small = lambda x: np.log(x + 0.002)
    return np.column_stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(spread), small(share[:, 0]), share[:, 1], small(share[:, 2]), small(share[:, 3]), share[:, 4], share[:, 5],
            small(share[:, 6]), small(share[:, 7]), distinct, small(top), small(again), small(ends),
        ]
    )


def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            found = statistics(part.column(1))
            lists = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(lists), pa.array(found.ravel()))], names=["doc", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` and ``x``, the statistics of each whole text; null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_statistic_batches, f"doc {kind}, x array<double>")


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(STATISTICS) + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(1).to_numpy(zero_copy_only=False)
        x = np.column_stack([np.ones(batch.num_rows), np.array(batch.column(0).flatten().to_numpy()).reshape(batch.num_rows, -1)])
        for k in np.unique(label):
            m = x[label == k].T @ x[label == k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, k, dtype=np.int32)), pa.array(np.arange(size * size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "cell", "value"])


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and the log prior odds of label 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(-0.5 * (z * z).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -700, 700)))


def fit_moments(moments: np.ndarray, p: QualityParams) -> Discriminant:
    """From the sums of (1, x)(1, x)' of label 0 and label 1; a class without rows takes the other's shape."""
    counts = moments[:, 0, 0]
    pooled_mean = moments[:, 0, 1:].sum(axis=0) / max(counts.sum(), 1)
    means = np.array([m[0, 1:] / m[0, 0] if m[0, 0] else pooled_mean for m in moments])
    scatter = np.array([m[1:, 1:] - m[0, 0] * np.outer(c, c) for m, c in zip(moments, means, strict=True)])
    pooled = scatter.sum(axis=0) / max(counts.sum(), 1)
    eye = np.eye(len(pooled))
    factors, log_dets = [], []
    for s, n in zip(scatter, counts, strict=True):
        own = s / n if n else pooled
        mixed = (1 - p.pool) * own + p.pool * pooled
        mixed = (1 - p.diagonal) * mixed + p.diagonal * mixed * eye + p.floor * eye
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), float(np.log((counts[1] + 1) / (counts[0] + 1))))


def train(stats: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Discriminant:
    """``stats(doc, x)`` and ``labels(doc, label)``; the lowest of several labels of one id counts,
    null labels are left out, values above 0 mean 1."""
    size = len(STATISTICS) + 1
    marks = labels.where("doc is not null and label is not null").groupBy("doc").agg(F.min((F.col("label") > 0).cast("int")).alias("label"))
    sums = stats.join(marks, "doc").select("x", "label").mapInArrow(_moment_batches, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value"))
    moments = np.zeros((2, size * size))
    for label, cell, value in sums.collect():
        moments[label, cell] = value
    return fit_moments(moments.reshape(2, size, size), p)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column(1).flatten().to_numpy()).reshape(batch.num_rows, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc", "score"])


def _text_batches(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(statistics(part.column(1))))], names=["doc", "score"])


def score_texts(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", p: QualityParams = QualityParams()) -> DataFrame:
    """As :func:`score`, straight from the texts in one pass; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lambda b: _text_batches(b, model), f"doc {kind}, score double")
    return scored.withColumnRenamed("doc", id_col).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def accepted(text: Column, model: Discriminant, p: QualityParams = QualityParams()) -> Column:
    """``predicted`` of :func:`score_texts` as a column, for filters of rows that themselves stay out of Python."""
    return tk.marked(text, lambda texts: model.scores(statistics(texts)) >= p.threshold)


def score(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", p: QualityParams = QualityParams()) -> DataFrame:
    """Per row: ``id_col``, ``score`` in 0 to 1 (higher: label 1 likelier) and ``predicted``.

    Empty and null texts are scored by the prior's statistics; repeated rows come back each; very long
    texts are read whole; an empty table gives an empty result.
    """
    kind = stats.schema["doc"].dataType.simpleString()
    scored = stats.mapInArrow(lambda b: _score_batches(b, model), f"doc {kind}, score double")
    return scored.withColumnRenamed("doc", id_col).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
