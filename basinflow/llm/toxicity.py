"""Toxicity by a chain of linear classifiers.

Labelled categories are predicted one after the other, the verdict last.  Each linear model sees the
words of the text and the log-odds that the earlier models gave; in training those come from
out-of-fold predictions, so that a later model learns how far an earlier one can be trusted on texts
it has not seen.

Features are whole words and word beginnings (runs of letters, A-Z as a-z), present or absent.  All
those are kept that tell one of the categories apart beyond chance, by the G statistic over a bounded
sample of labelled rows.  Scoring reads every whole text once, in array form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.llm.sampling import bounded
from basinflow.sources.shared import discard, materialise


@dataclass(frozen=True)
class ToxicityParams:
    """``sample`` bounds the labelled rows that are learned from; a feature needs a G statistic of
    ``least_g`` for one of the categories (30: chance one in 2e7).  ``prefixes`` are the lengths of word
    beginnings in bytes; ``folds``, ``steps`` and ``ridge`` govern the fits."""

    sample: int = 20_000
    least_g: float = 30.0
    prefixes: tuple[int, ...] = (5,)
    folds: int = 3
    steps: int = 100
    ridge: float = 1e-4
    threshold: float = 0.5


LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def word_features(array: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and word beginning; a feature may repeat within a row."""
    raw, bounds = tk.text_bytes(array)
    data = tk.LOWER[raw]
    starts, ends = tk.runs(LETTER[data], bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    rows, features = [row], [tk.span_hashes(data, starts, ends)]
    for k in prefixes:
        some = ends - starts >= k
        rows.append(row[some])
        features.append(tk.mix64(tk.span_hashes(data, starts[some], starts[some] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(features)


class Vocabulary:
    """Positions of the kept features; a small bit table drops most other words at once."""

    def __init__(self, features: np.ndarray) -> None:
        self.features = np.sort(features.astype(np.uint64))
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, position) of the kept features."""
        some = self.maybe[(features & np.uint64(0xFFFF)).astype(np.int64)]
        rows, features = rows[some], features[some]
        at = np.minimum(np.searchsorted(self.features, features), max(0, len(self.features) - 1))
        hit = self.features[at] == features if len(self.features) else np.zeros(len(features), dtype=bool)
        size = max(1, len(self.features))
        pair = np.unique(rows[hit] * size + at[hit])
        return pair // size, pair % size


def summed(to: np.ndarray, values: np.ndarray, at: np.ndarray, size: int, block: int = 1 << 19) -> np.ndarray:
    """``values[at]`` added up at the places ``to``, a block at a time: what is held besides stays small."""
    total = np.zeros(size)
    for k in range(0, len(to), block):
        total += np.bincount(to[k : k + block], weights=values[at[k : k + block]], minlength=size)
    return total


@dataclass
class LinearModel:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def log_odds(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return self.bias + dense @ self.dense + summed(rows, self.weights, cols, len(dense))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int, p: ToxicityParams) -> LinearModel:
    """Ridge logistic regression on sparse 0/1 features and dense columns, by adaptive gradient steps."""
    rate = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
    model = LinearModel(np.zeros(size), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    squares = [np.full(size, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
    for _ in range(p.steps if len(y) else 0):
        off = (sigmoid(model.log_odds(rows, cols, dense)) - y) / len(y)
        steps = [summed(cols, off, rows, size) + p.ridge * model.weights, dense.T @ off + p.ridge * model.dense, off.sum()]
        squares = [s + g * g for s, g in zip(squares, steps, strict=True)]
        moves = [0.5 * g / np.sqrt(s) for s, g in zip(squares, steps, strict=True)]
        model = LinearModel(model.weights - moves[0], model.dense - moves[1], model.bias - float(moves[2]))
    return model


@dataclass
class Chain:
    """Models in order; each reads the log-odds of those before it."""

    vocabulary: Vocabulary
    models: list[LinearModel]

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, count: int) -> np.ndarray:
        odds = np.zeros((count, 0))
        for model in self.models:
            odds = np.column_stack([odds, squash(model.log_odds(rows, cols, odds))])
        return sigmoid(odds)


def squash(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds, -12, 12)


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, vocabulary: Vocabulary, p: ToxicityParams) -> Chain:
    """Fit one model per column of ``labels`` (0/1, NaN where unknown), earlier columns first."""
    count, size = len(labels), len(vocabulary.features)
    part = (tk.mix64(np.arange(count, dtype=np.uint64)) % np.uint64(p.folds)).astype(np.int64)
    odds, models = np.zeros((count, 0)), []

    def fitted(keep: np.ndarray, y: np.ndarray) -> LinearModel:
        place, some = np.cumsum(keep, dtype=rows.dtype) - 1, keep[rows]
        return fit_linear(place[rows[some]], cols[some], odds[keep], y[keep], size, p)

    for y in labels.T:
        known = ~np.isnan(y)
        models.append(fitted(known, y))
        out_of_fold = np.zeros(count)
        for k in range(p.folds):
            out_of_fold[part == k] = fitted(known & (part != k), y).log_odds(rows, cols, odds)[part == k]
        odds = np.column_stack([odds, squash(out_of_fold)])
    return Chain(vocabulary, models)


def _count_batches(batches: Iterator[pa.RecordBatch], p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    """For each category, in how many texts whose label is known a feature occurs, and of label 1."""
    for batch in batches:
        for part in tk.slices(batch, "text"):
            rows, features = word_features(part.column(0), p.prefixes)
            order = np.lexsort((rows, features))
            rows, features = rows[order], features[order]
            once = np.ones(len(rows), dtype=bool)
            once[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
            found, at = np.unique(features[once], return_inverse=True)
            for category, label in enumerate(_label_matrix(part.column(1)).T):
                known = ~np.isnan(label)
                n = np.bincount(at, weights=known[rows[once]], minlength=len(found)).astype(np.int64)
                hits = np.bincount(at, weights=np.where(known, label, 0)[rows[once]], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), category, dtype=np.int32)), pa.array(n), pa.array(hits)], names=["feature", "category", "n", "hits"])


def _label_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _find_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            rows, cols = vocabulary.find(*word_features(part.column(0), p.prefixes))
            at = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(cols.astype(np.int32))), part.column(2)], names=["labels", "found", "hash"])


def _score_batches(batches: Iterator[pa.RecordBatch], chain: Chain, names: list[str], p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            rows, cols = chain.vocabulary.find(*word_features(part.column(1), p.prefixes))
            found = chain.probabilities(rows, cols, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in found.T)], names=["doc", *names])


def train(labelled: DataFrame, text_col: str, categories: list[str], p: ToxicityParams = ToxicityParams()) -> Chain:
    """Learn from ``labelled`` (at most ``p.sample`` rows): 0/1 ``categories`` in chain order.

    A null label leaves the row out of that category's model alone.  No rows, or one class, give the
    base rate."""
    rows = labelled.select(F.col(text_col).alias("text"), F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"))
    sample = materialise(rows, "toxicity-sample")
    marks = [F.element_at("labels", k + 1) for k in range(len(categories))]
    totals = sample.agg(*[x for m in marks for x in (F.count(m), F.coalesce(F.sum(m), F.lit(0)))]).first()
    counted = sample.select("text", "labels").mapInArrow(lambda b: _count_batches(b, p), "feature long, category int, n long, hits long")
    table = counted.groupBy("feature", "category").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    every, ones = (F.element_at(F.array(*[F.lit(float(x)) for x in totals[k::2]]), F.col("category") + 1) for k in (0, 1))
    table = table.withColumns({"every": every, "ones": ones}).where("n > 0")
    g = F.lit(0.0)
    for seen, among in (("hits", "ones"), ("n - hits", "every - ones")):
        for observed, expected in ((seen, f"n * ({among}) / every"), (f"{among} - ({seen})", f"(every - n) * ({among}) / every")):
            g = g + F.expr(f"CASE WHEN ({observed}) > 0 AND ({expected}) > 0 THEN 2 * ({observed}) * ln(({observed}) / ({expected})) ELSE 0D END")
    kept = table.where(g >= p.least_g).select("feature").distinct().toArrow().column(0).to_numpy()
    vocabulary = Vocabulary(kept.view(np.uint64))
    found = sample.select("text", "labels", F.xxhash64("text")).mapInArrow(lambda b: _find_batches(b, vocabulary, p), "labels array<int>, found array<int>, hash long").toArrow()
    discard(sample)
    found = found.sort_by("hash").combine_chunks()  # the same on every run
    labels = [_label_matrix(x) for x in found.column("labels").chunks if len(x)]
    labels = np.concatenate([np.zeros((0, len(categories))), *labels])
    lists = found.column("found").chunks
    cols = np.concatenate([np.zeros(0, dtype=np.int32), *[x.flatten().to_numpy() for x in lists]])
    counts = np.concatenate([np.zeros(0, dtype=np.int32), *[x.value_lengths().to_numpy() for x in lists]])
    del found, lists
    return fit_chain(np.repeat(np.arange(len(counts), dtype=np.int32), counts), cols, labels, vocabulary, p)


def score(docs: DataFrame, chain: Chain, categories: list[str], id_col: str = "doc_id", text_col: str = "text", p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``p_<category>`` each, ``score`` (the last one) and ``toxic``.

    A null or empty text, and one without letters, gets the base rate.  Repeated rows come back each;
    other columns are ignored; an empty table gives an empty result.
    """
    names = [f"p_{c}" for c in categories[:-1]] + ["score"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, " + ", ".join(f"{n} double" for n in names)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lambda b: _score_batches(b, chain, names, p), schema)
    return scored.withColumnRenamed("doc", id_col).withColumn("toxic", F.col("score") >= p.threshold)


def rejected(text: Column, chain: Chain, p: ToxicityParams = ToxicityParams()) -> Column:
    """``toxic`` of :func:`score` as a column, for filters of rows that themselves stay out of Python."""

    def mark(texts: pa.Array) -> np.ndarray:
        rows, cols = chain.vocabulary.find(*word_features(texts, p.prefixes))
        return chain.probabilities(rows, cols, len(texts))[:, -1] >= p.threshold

    return tk.marked(text, mark)


#: Label columns in chain order.
CATEGORIES = ["quality", "toxic"]


def train_on_labels(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Chain:
    """Chain over the labels of the documents: ``quality`` and, with its odds, ``toxic``.

    ``labels(doc_id, quality, toxic)`` marks some documents, of which the ``p.sample`` with the smallest
    hash of the id are learned from.  Of several labels for one id the highest counts, of several texts
    the one with the smallest hash; rows without an id or a label ``toxic`` are left out, a null ``quality``
    from its model alone.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in CATEGORIES])
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded(marks, "doc_id", p.sample)), "doc_id")
    rows = rows.groupBy("doc_id", *CATEGORIES).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    return train(rows.select("text", *[(F.col(c) > 0).alias(c) for c in CATEGORIES]), "text", CATEGORIES, p)
