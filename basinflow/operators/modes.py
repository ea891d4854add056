"""Mode seeking on a directed neighbour graph ``edges(i, rk, j)`` with ``density(i, f)``.

Only a vertex's own list is read, and only strictly denser neighbours count: loops and plateaus link
nothing.  Ragged and empty lists are fine; listed neighbours without a density are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.sources.shared import materialise

#: Vertices whose chains one task follows (two numbers each); more of them take rounds of joins.
ONE_TASK = 1 << 20
#: Rows that share a key from which on its partner is broadcast: at most one key for so many rows.
HOT_ROWS = 1 << 18


def uphill_edges(edges: DataFrame, density: DataFrame) -> DataFrame:
    """``i, rk, j, fi, fj`` of the edges to a strictly denser neighbour."""
    own, other = density.select("i", F.col("f").alias("fi")), density.select(F.col("i").alias("j"), F.col("f").alias("fj"))
    return edges.select("i", "rk", "j").join(other, "j").join(own, "i").where("fj > fi").select("i", "rk", "j", "fi", "fj")


def steepest_parents(uphill: DataFrame, density: DataFrame) -> DataFrame:
    """``i, parent``: the densest uphill neighbour, the first in list order on ties; a maximum is its own."""
    best = uphill.groupBy("i").agg(F.max_by("j", F.struct("fj", -F.col("rk"))).alias("parent"))
    return density.select("i").join(best, "i", "left").select("i", F.coalesce("parent", "i").alias("parent"))


def local_maxima(uphill: DataFrame, density: DataFrame) -> DataFrame:
    """``i, f`` of the vertices without an uphill edge."""
    return density.join(uphill.select("i"), "i", "left_anti").select("i", "f")


def join_unique(rows: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, in which a key occurs once; rows without a partner are left out.

    Keys that ``hot_rows`` rows or more share are joined where those rows are: their partners, at most one for
    ``hot_rows`` rows, are broadcast, so no task gets all rows of a key.  ``rows`` is read twice.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") >= hot_rows).select(key, F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    common = marked.where("is_hot").drop("is_hot").join(F.broadcast(table.join(hot.select(key), key, "left_semi")), key)
    return common.unionByName(marked.where("is_hot is null").drop("is_hot").join(table, key))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends of all chains of a table of pointers held whole."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ids, to = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    order = np.argsort(ids)
    ids, at = ids[order], np.searchsorted(ids[order], to[order])
    while (further := at[at]).tobytes() != at.tobytes():
        at = further
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[at])], names=["i", "root"])


def seek_modes(parents: DataFrame, one_task: int = ONE_TASK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``i, root``: the end of each vertex's chain of parents ``(i, parent)``, by pointer doubling.

    Up to ``one_task`` vertices are followed by one task.  Beyond, each round halves the chains that are left.
    Vertices that have arrived leave the rounds; what others are looked up in holds only vertices that
    somebody still points to, a set that shrinks from round to round, so no round reads what has arrived
    before.  A round is one write; roots that many point to are broadcast.  ``i`` may be of any type beyond
    ``one_task`` vertices; only flags and one count reach the driver.
    """
    moving = materialise(parents.select("i", F.col("parent").alias("root"), (F.col("i") == F.col("parent")).alias("ends")), "pointers")
    if one_task and moving.limit(one_task + 1).count() <= one_task:
        return moving.select("i", "root").coalesce(1).mapInArrow(_follow, "i long, root long")
    arrived, look, moving = moving.where("ends").select("i", "root"), moving, moving.where("NOT ends")
    while not moving.isEmpty():
        to = look.select(F.col("i").alias("root"), F.col("root").alias("next"), "ends")
        moved = materialise(join_unique(moving.select("i", "root"), to, "root", hot_rows).select("i", F.col("next").alias("root"), "ends"), "pointers")
        arrived, moving = arrived.unionByName(moved.where("ends").select("i", "root")), moved.where("NOT ends")
        pointed = moving.select(F.col("root").alias("i")).distinct()
        look = materialise(moved.unionByName(look.where("ends")).join(pointed, "i", "left_semi"), "pointed-at")
    return arrived


def mode_seeking(edges: DataFrame, density: DataFrame) -> DataFrame:
    """``i, root`` for every vertex: the local maximum that steepest ascent leads to (threshold 0)."""
    uphill = uphill_edges(edges, density)
    return seek_modes(steepest_parents(uphill, density))


def dense_index(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column, numbered from 0 in their order, without one task seeing them all.

    Values are range-partitioned and written; counts per partition (one row each) give every
    partition its first number.
    """
    spread = values.select(column).distinct().repartitionByRange(column)
    held = materialise(spread.withColumn("part", F.spark_partition_id()), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return held.join(F.broadcast(firsts), "part").select(column, (F.col("first") + nth - 1).alias(name))


def labelled(roots: DataFrame) -> DataFrame:
    """``i, root, label``: roots renumbered 0, 1, ... in their order."""
    return roots.join(dense_index(roots, "root", "label"), "root").select("i", "root", "label")


def cluster_sizes(roots: DataFrame) -> DataFrame:
    """``root, size``."""
    return roots.groupBy("root").agg(F.count("*").alias("size"))


def in_order(f: Column, i: Column) -> Column:
    """Sort key of the sweep: densest first, then the smaller id."""
    return F.struct(-f, i)
