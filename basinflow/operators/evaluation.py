"""Comparing clusters with classes, on the sparse contingency table ``n`` per (truth, pred).

Every measure is worked out from the contingency and its marginals, so nothing larger than the table
of distinct (class, cluster) pairs is shuffled after the first partial aggregation.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.functions.vectors import ln_factorial
from basinflow.operators.knn import Knn, knn_by_cell, knn_exact
from basinflow.operators.modes import dense_index
from basinflow.sources.shared import materialise


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``truth, pred, n``: rows per pair of labels; rows with a null label are left out."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).cast("long").alias("truth"), F.col(pred).cast("long").alias("pred")).agg(F.count("*").alias("n"))


def encoded(table: DataFrame) -> DataFrame:
    """``row, col, n``: labels renumbered from 0 in their order."""
    rows, cols = dense_index(table, "truth", "row"), dense_index(table, "pred", "col")
    return table.join(rows, "truth").join(cols, "pred").select("row", "col", "n")


def dense_cost(table: DataFrame, num_classes: int) -> DataFrame:
    """``row, col, n`` of the full square of ``num_classes`` labels taken as they are, zeros included."""
    square = table.sparkSession.range(num_classes * num_classes).select((F.col("id") / num_classes).cast("long").alias("truth"), (F.col("id") % num_classes).alias("pred"))
    return square.join(table, ["truth", "pred"], "left").select(F.col("truth").alias("row"), F.col("pred").alias("col"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def maximum_assignment(gain: np.ndarray) -> np.ndarray:
    """Column for each row of a gain matrix with no more rows than columns, largest total.

    Shortest augmenting paths with potentials; the inner step runs over all columns at once.
    """
    rows, cols = gain.shape
    cost = gain.max(initial=0) - gain
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for row in range(rows):
        shortest, back, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, dtype=bool)
        at, base, sink, last = row, 0.0, -1, -1
        while sink < 0:
            reach = base + cost[at] - u[at] - v
            better = ~done & (reach < shortest)
            shortest[better], back[better] = reach[better], last
            col = int(np.where(done, np.inf, shortest).argmin())
            base, done[col], last = shortest[col], True, col
            if owner[col] < 0:
                sink = col
            else:
                at = owner[col]
        path = np.flatnonzero(done)
        u[row] += base
        matched = path[owner[path] >= 0]
        u[owner[matched]] += base - shortest[matched]
        v[path] -= base - shortest[path]
        while sink >= 0:
            before = back[sink]
            owner[sink] = row if before < 0 else owner[before]
            sink = before
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


#: Cells of the largest matrix that is assigned in one task (1 GB).
MOST_CELLS = 1 << 27


def _assign(table: pd.DataFrame) -> pd.DataFrame:
    truth, row = np.unique(table["truth"], return_inverse=True)
    pred, col = np.unique(table["pred"], return_inverse=True)
    if len(truth) * len(pred) > MOST_CELLS:
        raise ValueError(f"{len(truth)} classes and {len(pred)} clusters are more than one task can assign")
    gain = np.zeros((len(truth), len(pred)))
    gain[row, col] = table["n"]
    if len(truth) <= len(pred):
        pairs = [(pred[c], truth[r]) for r, c in enumerate(maximum_assignment(gain))]
    else:
        pairs = [(pred[c], truth[r]) for c, r in enumerate(maximum_assignment(gain.T))]
    return pd.DataFrame(pairs, columns=["pred", "truth"]).sort_values("truth").assign(position=range(len(pairs)))


def optimal_assignment(table: DataFrame, whole_cells: int = MOST_CELLS) -> DataFrame:
    """``pred, truth, position``: a one-to-one map from clusters to classes with most rows in agreement.

    The smaller of the two label sets is mapped whole; ``position`` counts by class.  Up to ``whole_cells`` pairs of a
    class and a cluster (counted before anything is gathered) one task solves the matrix.  Larger tables stay
    sparse, see :func:`sparse_assignment`.  Of several best maps one is returned.
    """
    classes, clusters = table.agg(F.count_distinct("truth"), F.count_distinct("pred")).first()
    if classes * clusters > whole_cells:
        return sparse_assignment(table)
    return table.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_assign, "pred long, truth long, position int")


def _certain_pairs(left: DataFrame) -> DataFrame:
    """``truth, pred`` of pairs that some best map has: each the other's largest count, and no less than the next
    largest of both together (exchanging the pair for those two would gain nothing)."""
    top = lambda own, other: left.groupBy(own).agg(F.max(F.struct("n", (-F.col(other)).alias("c"))).alias("t")).select(own, (-F.col("t.c")).alias(other), F.col("t.n").alias("n"))
    mutual = materialise(top("truth", "pred").join(top("pred", "truth").select("truth", "pred"), ["truth", "pred"]), "mutual")
    nexts = []
    for own, other in (("truth", "pred"), ("pred", "truth")):
        rest = left.join(mutual.select(own, F.col(other).alias("taken")), own).where(F.col(other) != F.col("taken"))
        nexts.append(rest.groupBy(own).agg(F.max("n").alias(f"next_{own}")))
    both = mutual.join(nexts[0], "truth", "left").join(nexts[1], "pred", "left")
    return both.where(F.col("n") >= F.coalesce("next_truth", F.lit(0)) + F.coalesce("next_pred", F.lit(0))).select("truth", "pred")


def _parts(left: DataFrame) -> DataFrame:
    """``truth, part``: the smallest class that each class is connected with through clusters, in rounds."""
    labels = materialise(left.select("truth", F.col("truth").alias("part")).distinct(), "parts")
    while True:
        near = left.join(labels, "truth").groupBy("pred").agg(F.min("part").alias("part"))
        least = left.join(near, "pred").groupBy("truth").agg(F.min("part").alias("part"))
        jump = labels.select(F.col("truth").alias("part"), F.col("part").alias("further"))
        moved = labels.withColumnRenamed("part", "old").join(least, "truth").join(jump, "part", "left").select("truth", "old", F.least("part", F.coalesce("further", "part")).alias("part"))
        moved = materialise(moved, "parts")
        if moved.where("old <> part").isEmpty():
            return moved.select("truth", "part")
        labels = moved.select("truth", "part")


def sparse_assignment(table: DataFrame, rounds: int = 64) -> DataFrame:
    """:func:`optimal_assignment` of a table of many labels, from the pairs that occur.

    Rounds of joins take the pairs that are certain to be in a best map and strike their labels, until there are none
    (or ``rounds`` are over).  What is left falls into connected parts, each solved by a task of its own; only
    a single part of more than :data:`MOST_CELLS` cells is an error.  Labels without a partner of positive count are
    then paired in their order, until the smaller set is used up.
    """
    table = materialise(table.select("truth", "pred", "n"), "assigned-from")
    left, found = table.where("n > 0"), []
    for _ in range(rounds):
        certain = materialise(_certain_pairs(left), "certain")
        if certain.isEmpty():
            break
        found.append(certain)
        left = materialise(left.join(certain.select("truth"), "truth", "left_anti").join(certain.select("pred"), "pred", "left_anti"), "undecided")
    solved = left.join(_parts(left), "truth").groupBy("part").applyInPandas(_assign, "pred long, truth long, position int")
    found.append(materialise(solved.join(left.select("truth", "pred"), ["truth", "pred"], "left_semi").select("truth", "pred"), "solved"))
    pairs = functools.reduce(DataFrame.unionByName, found)
    rest = [dense_index(table.join(pairs.select(c), c, "left_anti").select(c), c, "nth") for c in ("truth", "pred")]
    pairs = materialise(pairs.unionByName(rest[0].join(rest[1], "nth").select("truth", "pred")), "assigned")
    return pairs.join(dense_index(pairs, "truth", "position"), "truth").select("pred", "truth", F.col("position").cast("int").alias("position"))


def accuracies(table: DataFrame, by: str, whole_cells: int = MOST_CELLS) -> DataFrame:
    """``by, accuracy``: :func:`clustering_accuracy` for each value of a column of few values; tables small enough for one
    task are groups, the others are worked on one by one."""
    sizes = table.groupBy(by).agg(F.count_distinct("truth").alias("classes"), F.count_distinct("pred").alias("clusters")).collect()
    large = [r[by] for r in sizes if r["classes"] * r["clusters"] > whole_cells]
    shape = f"{by} {table.schema[by].dataType.simpleString()}, pred long, truth long"
    small = table.where(~F.col(by).isin(large)) if large else table
    pairs = small.groupBy(by).applyInPandas(lambda g: _assign(g).assign(**{by: g[by].iloc[0]})[[by, "pred", "truth"]], shape)
    for value in large:
        pairs = pairs.unionByName(sparse_assignment(table.where(F.col(by) == value)).select(F.lit(value).alias(by), "pred", "truth"))
    hits = table.join(pairs.withColumn("hit", F.lit(True)), [by, "pred", "truth"], "left")
    return hits.groupBy(by).agg((F.lit(100.0) * F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def clustering_accuracy(table: DataFrame) -> DataFrame:
    """``accuracy``: percent of rows whose cluster maps to their class; null without rows."""
    hits = table.join(optimal_assignment(table).select("pred", "truth", F.lit(True).alias("hit")), ["pred", "truth"], "left")
    return hits.agg((F.lit(100.0) * F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def subgroup_id(superclass: Column, subgroup: Column, num_subgroups: int) -> Column:
    return superclass * num_subgroups + subgroup


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``agreement``: share of rows on which two labellings are equal."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def cluster_count(df: DataFrame, column: str) -> DataFrame:
    """``clusters``: number of distinct labels."""
    return df.agg(F.count_distinct(column).alias("clusters"))


def _agg(df: DataFrame, by: Sequence[str], *values: Column) -> DataFrame:
    return df.groupBy(*by).agg(*values) if by else df.agg(*values)


def _with(df: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the one row (for each value of ``by``, which number few) of another table."""
    return df.join(F.broadcast(one), list(by)) if by else df.join(F.broadcast(one))


def _marginals(table: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    total = _agg(table, by, F.sum("n").alias("total"))
    return table.groupBy(*by, "truth").agg(F.sum("n").alias("a")), table.groupBy(*by, "pred").agg(F.sum("n").alias("b")), total


def _pairs_of(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """``ari``: 1 when both labellings are trivial or equal in every pair."""
    rows, cols, total = _marginals(table)
    both = table.agg(F.sum(_pairs_of(F.col("n"))).alias("both"))
    each = rows.agg(F.sum(_pairs_of(F.col("a"))).alias("pa")).join(F.broadcast(cols.agg(F.sum(_pairs_of(F.col("b"))).alias("pb")))).join(F.broadcast(both)).join(F.broadcast(total))
    expected = F.col("pa") * F.col("pb") / _pairs_of(F.col("total"))
    most = (F.col("pa") + F.col("pb")) / 2
    return each.select(F.when((_pairs_of(F.col("total")) == 0) | (most == expected), F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def _entropy(marginal: DataFrame, size: str, total: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    share = F.col(size) / F.col("total")
    return _agg(_with(marginal, total, by), by, (-F.sum(share * F.ln(share))).alias(name))


def mutual_information(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``mi, h_true, h_pred, total`` in nats: mutual information and both entropies (as the other measures with ``by``: for
    each value of those columns, say thresholds)."""
    rows, cols, total = _marginals(table, by)
    joined = _with(table.join(rows, [*by, "truth"]).join(cols, [*by, "pred"]), total, by)
    mi = _agg(joined, by, F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    entropies = _with(_entropy(rows, "a", total, "h_true", by), _entropy(cols, "b", total, "h_pred", by), by)
    return _with(_with(mi, entropies, by), total, by).select(*by, F.greatest("mi", F.lit(0.0)).alias("mi"), "h_true", "h_pred", "total")


def normalized_mutual_information(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``nmi`` over the mean of the entropies; 1 when both labellings have a single label."""
    mean = (F.col("h_true") + F.col("h_pred")) / 2
    return mutual_information(table, by).select(*by, F.when(mean == 0, F.lit(1.0)).otherwise(F.col("mi") / mean).alias("nmi"))


def expected_mutual_information(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``emi``: expected mutual information of random labellings with the same label sizes.

    Equal sizes are counted together: n rows allow no more than sqrt(2 n) distinct sizes a side.
    """
    rows, cols, total = _marginals(table, by)
    a = rows.groupBy(*by, "a").agg(F.count("*").alias("a_labels"))
    b = _agg(cols.groupBy(*by, "b").agg(F.count("*").alias("b_labels")), by, F.collect_list(F.struct("b", "b_labels")).alias("sizes"))
    each = _with(_with(a, b, by), total, by).select(*by, "a", "a_labels", "total", F.explode("sizes").alias("other")).select(*by, "a", "a_labels", "total", "other.b", "other.b_labels")
    low, high, piece = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("total")), F.least("a", "b"), F.lit(1 << 16)
    each = each.withColumn("from", F.explode(F.sequence(low, high, piece)))  # no row holds a long sequence
    term = each.withColumn("n", F.explode(F.sequence(F.col("from"), F.least(high, F.col("from") + (1 << 16) - 1))))
    log = ln_factorial
    ways = log(F.col("a")) + log(F.col("b")) + log(F.col("total") - F.col("a")) + log(F.col("total") - F.col("b"))
    ways = ways - log(F.col("total")) - log(F.col("n")) - log(F.col("a") - F.col("n")) - log(F.col("b") - F.col("n")) - log(F.col("total") - F.col("a") - F.col("b") + F.col("n"))
    gain = F.col("n") / F.col("total") * F.ln(F.col("total").cast("double") * F.col("n") / (F.col("a").cast("double") * F.col("b")))
    return _agg(term, by, F.coalesce(F.sum(F.col("a_labels") * F.col("b_labels") * gain * F.exp(ways)), F.lit(0.0)).alias("emi"))


def adjusted_mutual_information(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ami`` with the arithmetic mean of the entropies; 1 when both labellings are trivial."""
    both = _with(mutual_information(table, by), expected_mutual_information(table, by), by)
    mean = (F.col("h_true") + F.col("h_pred")) / 2
    gap = mean - F.col("emi")
    tiny = F.lit(float(np.finfo(float).eps))
    safe = F.when(gap < 0, F.least(gap, -tiny)).otherwise(F.greatest(gap, tiny))
    return both.select(*by, F.when(mean == 0, F.lit(1.0)).otherwise((F.col("mi") - F.col("emi")) / safe).alias("ami"))


def clustering_metrics(df: DataFrame, pred: str, superclass: str, subgroup: str, num_subgroups: int, prefix: str = "") -> DataFrame:
    """``metric, value``: ARI, AMI, NMI, ``Cluster_Acc/<position>`` and ``Cluster_Acc/Total`` (shares).

    Classes are ``superclass * num_subgroups + subgroup``; a class that no row has is left out;
    ``prefix/`` goes before each name.
    """
    table = materialise(contingency(df.withColumn("class", subgroup_id(F.col(superclass), F.col(subgroup), num_subgroups)), "class", pred), "contingency")
    named = [adjusted_rand(table).withColumnRenamed("ari", "value"), adjusted_mutual_information(table).withColumnRenamed("ami", "value"), normalized_mutual_information(table).withColumnRenamed("nmi", "value")]
    parts = [x.select(F.lit(name).alias("metric"), "value") for name, x in zip(("ARI", "AMI", "NMI"), named, strict=True)]
    hits = optimal_assignment(table).join(table, ["pred", "truth"], "left").select("truth", "position", F.coalesce("n", F.lit(0)).alias("hits"))
    hits = hits.join(table.groupBy("truth").agg(F.sum("n").alias("size")), "truth")
    parts.append(hits.select(F.concat(F.lit("Cluster_Acc/"), F.col("position").cast("string")).alias("metric"), (F.col("hits") / F.col("size")).alias("value")))
    parts.append(hits.agg(F.sum("hits").alias("hits")).join(F.broadcast(table.agg(F.sum("n").alias("size")))).select(F.lit("Cluster_Acc/Total").alias("metric"), (F.col("hits") / F.col("size")).alias("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return prefixed(whole, prefix)


def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
    """Metric names with ``prefix/`` before each, or unchanged for an empty prefix."""
    return metrics.withColumn("metric", F.concat(F.lit(f"{prefix}/"), "metric")) if prefix else metrics


def k_centre_labels(points: DataFrame, roots: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``i, centre``: the nearest of the points that are roots of ``roots(i, root)``, ties to the smaller id."""
    centres = points.join(roots.select(F.col("root").alias(id_col)).distinct(), id_col, "left_semi")
    return knn_exact(points, Knn(1), centres, id_col, vector_col).select("i", F.col("j").alias("centre"))


def k_centre_labels_by_cell(points: DataFrame, roots: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``cell, i, centre``: :func:`k_centre_labels` for each of the ``cells`` clusterings ``roots(cell, i, root)``."""
    centres = roots.select("cell", F.col("root").alias(id_col)).distinct().join(points.select(id_col, vector_col), id_col)
    return knn_by_cell(points, centres, cells, Knn(1), id_col, vector_col).select("cell", "i", F.col("j").alias("centre"))
