"""Topological fine-tuning: move points so that the wanted components stand out and the others fade.

The pairing of births and deaths is constant in small steps, so the loss depends on the points through
the densities alone, and those are closed forms of the neighbour distances.  Each step is a handful of
joins on the neighbour table: pairs give a derivative per density, densities one per distance, and
distances one per coordinate.  Only vertices that are a birth or a death contribute.

Neighbours are not searched anew in each step.  Every point keeps a list of ``k + spare`` nearest ones of an earlier
step and how far the last of them was.  What is not on the list was farther than that, and has come no nearer than
the point's and the farthest other point's way since; while the ``k``-th distance on the list is below that
bound the list has the exact neighbours.  Only points for which it is not are searched for again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.functions.vectors import doubles, pnorm
from basinflow.operators import density, persistence
from basinflow.operators.knn import Knn, knn_exact, merged
from basinflow.sources.shared import materialise


@dataclass(frozen=True)
class AdamW:
    """Step size, decay rates of both moments, and weight decay of the optimiser."""

    lr: float = 1e-2
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    weight_decay: float = 1e-2


def point_gradient(points: DataFrame, knn: DataFrame, by_density: DataFrame, dim: int, q: float, p: float = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``i, gradient``: derivative of the loss by the coordinates of every point that it depends on.

    ``by_density(i, gradient)`` is the derivative by the log densities, ``knn`` the un-rooted distances
    they come from.  Coinciding neighbours have an infinite density that no small step changes: they
    contribute nothing.
    """
    measure = knn.join(by_density, "i").groupBy("i").agg(F.avg(F.pow("dist", F.lit(float(q)))).alias("measure"), F.count("*").alias("k"), F.first("gradient").alias("g")).where("measure > 0")
    by_dist = F.col("g") * F.lit(-float(dim)) / F.col("measure") / F.col("k") * F.pow("dist", F.lit(float(q - 1)))
    ends = knn.join(measure, "i").where("i <> j").select("i", "j", by_dist.alias("w"))
    vectors = points.select(F.col(id_col).alias("i"), doubles(F.col(vector_col)).alias("a"))
    both = ends.join(vectors, "i").join(vectors.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")
    slope = F.zip_with("a", "b", lambda x, y: F.col("w") * p * F.pow(F.abs(x - y), F.lit(float(p - 1))) * F.signum(x - y))
    moved = both.select("i", "j", slope.alias("s"))
    parts = moved.select("i", F.posexplode("s")).unionByName(moved.select(F.col("j").alias("i"), F.posexplode(F.transform("s", lambda x: -x))))
    sums = parts.groupBy("i", "pos").agg(F.sum("col").alias("x"))
    return sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("gradient"))


def adamw_step(state: DataFrame, gradient: DataFrame, step: int, o: AdamW = AdamW()) -> DataFrame:
    """``i, x, m, v`` after one step from ``state`` of the same columns; points without a gradient have 0."""
    rows = state.join(gradient, "i", "left").withColumn("g", F.coalesce("gradient", F.transform("x", lambda _: F.lit(0.0))))
    rows = rows.withColumn("m", F.zip_with(F.col("m"), F.col("g"), lambda m, g: o.beta1 * m + (1 - o.beta1) * g))
    rows = rows.withColumn("v", F.zip_with(F.col("v"), F.col("g"), lambda v, g: o.beta2 * v + (1 - o.beta2) * g * g))
    move = F.zip_with(F.col("m"), F.col("v"), lambda m, v: o.lr * (m / (1 - o.beta1**step)) / (F.sqrt(v / (1 - o.beta2**step)) + o.eps))
    return rows.select("i", F.zip_with(F.col("x"), move, lambda x, d: x * (1 - o.lr * o.weight_decay) - d).alias("x"), "m", "v")


@dataclass
class NeighbourLists:
    """Lists ``i, j`` of the ``k + spare`` nearest points and the distance ``reach`` of the last one, as of the places ``i, x``
    in ``since`` (all of one step, or later for points searched again: then ``reach`` has been lowered to match)."""

    k: int
    spare: int
    lists: DataFrame | None = None
    since: DataFrame | None = None
    searched: tuple[int, int] = (0, 0)  # points searched for, and points in all, over all steps

    def _search(self, asked: DataFrame, state: DataFrame, names: str) -> tuple[DataFrame, DataFrame]:
        """The exact neighbours ``i, rk, j, dist`` (squared) and ``i, j, reach, was``, with ``was`` the ``k``-th distance; a list
        that holds every point reaches everything."""
        found = materialise(knn_exact(asked, Knn(self.k + self.spare), state, id_col="i", vector_col="x"), names)
        ends = found.groupBy("i").agg(F.sqrt(F.max("dist")).alias("last"), F.count("*").alias("n"), F.sqrt(F.max(F.when(F.col("rk") <= self.k, F.col("dist")))).alias("was"))
        reach = F.when(F.col("n") < self.k + self.spare, F.lit(math.inf)).otherwise(F.col("last"))
        lists = materialise(found.select("i", "j").join(ends.select("i", reach.alias("reach"), "was"), "i"), names)
        return found.where(F.col("rk") <= self.k), lists

    def _anew(self, state: DataFrame) -> DataFrame:
        """Neighbours and lists of all points as of now; what the search measured is not measured again."""
        near, self.lists = self._search(state, state, "lists")
        self.since = state.select("i", "x")
        return near

    def nearest(self, state: DataFrame) -> DataFrame:
        """``i, rk, j, dist`` (squared distances) of the exact ``k`` nearest points of ``state(i, x)``."""
        if self.lists is None:
            near = self._anew(state)
            self.searched = (0, state.count())
            return near
        places = state.select("i", "x")
        way = materialise(places.join(self.since.select("i", F.col("x").alias("x0")), "i").select("i", pnorm(F.col("x"), F.col("x0")).alias("way")), "ways")
        rows, farthest = way.agg(F.count("*"), F.coalesce(F.max("way"), F.lit(0.0))).first()
        ends = self.lists.groupBy("i").agg(F.first("reach").alias("reach"), F.first("was").alias("was")).join(way, "i")
        bound = (F.col("reach") - F.col("way") - F.lit(farthest)) * (1 - 1e-9)
        # where the last k-th distances let expect that most lists fall short, they are not measured first: both ways are exact
        if 2 * ends.where((F.col("reach") < F.lit(math.inf)) & (F.col("was") >= bound)).count() > rows:
            self.searched = (self.searched[0] + rows, self.searched[1] + rows)
            return self._anew(state)
        each = self.lists.join(places.select("i", F.col("x").alias("a")), "i").join(places.select(F.col("i").alias("j"), F.col("x").alias("b")), "j")
        each = each.select("i", "j", pnorm(F.col("a"), F.col("b"), 2, False).alias("dist"))
        near = materialise(merged(each, self.k, ["i"]), "near")
        kth = near.groupBy("i").agg(F.max(F.sqrt("dist")).alias("kth"))
        doubtful = materialise(kth.join(ends, "i").where((F.col("reach") < F.lit(math.inf)) & (F.col("kth") >= bound)).select("i"), "doubtful")
        again = doubtful.count()
        self.searched = (self.searched[0] + again, self.searched[1] + rows)
        if not again:
            return near
        if 2 * again > rows:
            return self._anew(state)
        found, fresh = self._search(state.join(doubtful, "i", "left_semi"), state, "lists")
        # their reach holds for the places of now; as of ``since`` others may have come nearer by their way till now
        earlier = fresh.join(way, "i").select("i", "j", (F.col("reach") - F.col("way") - F.lit(farthest)).alias("reach"), "was")
        self.lists = materialise(self.lists.join(doubtful, "i", "left_anti").unionByName(earlier), "lists")
        return materialise(near.join(doubtful, "i", "left_anti").unionByName(found), "near")


def fine_tune(points: DataFrame, dim: int, k: int, n_components: int, iters: int, q: float = 2, o: AdamW = AdamW(), spare: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[dict[str, float]]]:
    """The moved points ``(id, vector)`` after ``iters`` steps, and the losses before each step.

    Every step's state is written to the shared folder; three sums a step reach the driver.  Neighbour lists have
    ``spare`` entries more than ``k``; the result does not depend on it.
    """
    x = doubles(F.col(vector_col))
    zero = F.transform(x, lambda _: F.lit(0.0))
    state = materialise(points.select(F.col(id_col).alias("i"), x.alias("x"), zero.alias("m"), zero.alias("v")), "tuned")
    history, kept = [], NeighbourLists(k, spare)
    for step in range(1, iters + 1):
        knn = kept.nearest(state)
        dens = materialise(density.log_density(knn, dim, q), "density")
        _, pairs = persistence.cluster_h0(knn.select("i", "rk", "j"), dens, [math.inf])
        ranked = materialise(persistence.persistence_pairs(pairs, dens), "pairs")
        history.append(persistence.losses(ranked, n_components).first().asDict())
        slopes = point_gradient(state, knn, persistence.persistence_gradient(ranked, n_components), dim, q, id_col="i", vector_col="x")
        state = materialise(adamw_step(state, slopes, step, o), "tuned")
    return state.select(F.col("i").alias(id_col), F.col("x").alias(vector_col)), history
