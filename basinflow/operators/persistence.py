"""0-dimensional persistence: merging the basins of a density under a threshold, and what follows.

The sweep over vertices from the densest down is sequential, but clusters only ever merge whole, so
the non-greedy form contracts exactly:

1. every vertex shares the fate of its mode, found by pointer doubling over all vertices;
2. only vertices whose uphill neighbours lie in two basins or more ("saddles") can merge anything;
3. of the saddles that see the same basins only the first matters: if it did not merge them, their
   persistence there had reached the threshold, and it only grows.

A few saddles are swept by one task per threshold.  Beyond ``one_task`` of them the merge tree of the
infinite threshold is built in rounds, for all thresholds at once:

* The first saddle at which a cluster meets another is where it dies if it sees a higher root there, however
  far the others have got, since roots only get higher.  So in every round each cluster looks at its first
  saddle alone, and all that die there are contracted together.  Of equal heights the one that the saddle lists
  first stays; that is decided once the saddle is the first one of all clusters that it sees.
* At a threshold exactly the roots of smaller persistence merge.  A root that dies at a saddle of two basins
  follows the other basin.  A saddle of more basins is a node of its own that its dying roots follow; it
  leads to the highest of the clusters that its basins belong to, known once those are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import modes
from basinflow.operators.density import checked
from basinflow.sources.shared import materialise

MERGES = "tau double, kind string, a long, b long, persistence double"


def saddles(uphill: DataFrame, roots: DataFrame) -> DataFrame:
    """``i, f, basins``: vertices whose uphill neighbours lie in several basins, in list order."""
    seen = uphill.join(roots.select(F.col("i").alias("j"), "root"), "j")
    order = F.array_sort(F.collect_list(F.struct("rk", "root")))
    grouped = seen.groupBy("i").agg(F.first("fi").alias("f"), F.array_distinct(F.transform(order, lambda s: s["root"])).alias("basins"))
    return grouped.where(F.size("basins") >= 2)


class Forest:
    """Union-find over node numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top:
            self.up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[a] = b
        return a != b


#: Saddles, each with the basins it sees, that one task sweeps for a threshold; more of them take rounds.
ONE_TASK = 1 << 16


def first_saddles(found: DataFrame) -> DataFrame:
    """The first of the saddles ``i, f, basins`` that see the same basins."""
    first = F.min_by(F.struct("i", "f", "basins"), modes.in_order(F.col("f"), F.col("i")))
    return found.groupBy(F.array_sort("basins").alias("seen")).agg(first.alias("at")).select("at.*")


def _sweep(tau: float, vertices: Sequence[tuple[int, float, list[int]]], height: dict[int, float]) -> list[tuple]:
    """Merge basins at saddles in order; rows of :data:`MERGES`."""
    forest, rows = Forest(), []
    for vertex, f, basins in vertices:
        seen = list(dict.fromkeys(forest.find(b) for b in basins))
        top = max(seen, key=lambda r: height[r])  # the first in list order on ties
        for root in seen:
            if root != top and height[root] - f < tau:
                forest.up[root] = top
                rows.append((tau, "pair", root, vertex, height[root] - f))
    return rows + [(tau, "root", b, forest.find(b), None) for b in height]


def merge_basins(found: DataFrame, maxima: DataFrame, taus: Sequence[float], one_task: int = ONE_TASK) -> DataFrame:
    """Rows of :data:`MERGES` for each threshold: kind ``pair`` has birth ``a`` and death ``b``, kind
    ``root`` has mode ``a`` and the root ``b`` of its cluster.  Modes that stay alone may be left out."""
    kept = materialise(first_saddles(found), "saddles")
    if kept.limit(one_task + 1).count() > one_task:
        return merges_of_tree(merge_tree(kept, maxima, one_task), maxima, taus)
    height = kept.select(F.explode("basins").alias("i")).distinct().join(maxima, "i")
    rows = kept.select("i", "f", "basins").unionByName(height.select("i", "f", F.lit(None).cast("array<long>").alias("basins")))
    each = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        is_mode = group["basins"].isna()
        height = dict(zip(group["i"][is_mode].tolist(), group["f"][is_mode].tolist(), strict=True))
        ordered = group[~is_mode].sort_values(["f", "i"], ascending=[False, True])
        vertices = [(i, f, list(b)) for i, f, b in zip(ordered["i"].tolist(), ordered["f"].tolist(), ordered["basins"], strict=True)]
        return pd.DataFrame(_sweep(float(group["tau"].iloc[0]), vertices, height), columns=["tau", "kind", "a", "b", "persistence"])

    return each.groupBy("tau").applyInPandas(run, MERGES)


# --- the merge tree in rounds -------------------------------------------------------------------

TREE = "birth long, death long, persistence double, other long, basins array<long>"
DEATHS = f"{TREE}, root long, target long"
#: A saddle and, for each of its basins, the root of the cluster that it is in and that root's height; basins
#: of clusters that died there are left out of ``comps``.
CONTRACTED = "i long, f double, basins array<long>, comps array<long>, heights array<double>"


def _death(i: int, f: float, basins: Sequence[int], comps: Sequence[int], height: float, root: int, target: int) -> tuple:
    other = next((b for b, c in zip(basins, comps, strict=True) if c != root), None) if len(basins) == 2 else None
    return (root, i, height - f, other, None if other is not None else list(basins), root, target)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The roots that die at saddles which are the first of the clusters ``picked`` by them."""
    for batch in batches:
        rows = []
        for i, f, basins, comps, heights, picked in batch[["i", "f", "basins", "comps", "heights", "picked"]].itertuples(index=False):
            height = dict(zip(comps.tolist(), heights.tolist(), strict=True))
            top = max(height, key=height.__getitem__)  # the first in list order on ties
            settled = len(picked) == len(height)
            for root in picked.tolist():
                if root != top and (height[root] < height[top] or settled):
                    rows.append(_death(i, f, basins.tolist(), comps.tolist(), height[root], root, top))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in DEATHS.split(", ")])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All deaths at the few saddles that are left, swept in order."""
    held = pd.concat([pd.DataFrame(columns=["i", "f", "basins", "comps", "heights"]), *batches])
    forest, known, rows = Forest(), {}, []
    for i, f, basins, comps, heights in held.sort_values(["f", "i"], ascending=[False, True])[["i", "f", "basins", "comps", "heights"]].itertuples(index=False):
        known.update(zip(comps.tolist(), heights.tolist(), strict=True))
        now = [forest.find(c) for c in comps.tolist()]
        top = max(now, key=known.__getitem__)  # the first in list order on ties
        for root in dict.fromkeys(now):
            if root != top:
                rows.append(_death(i, f, basins.tolist(), now, known[root], root, top))
                forest.up[root] = top
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in DEATHS.split(", ")])


def _contracted(rows: DataFrame) -> DataFrame:
    """Rows of :data:`CONTRACTED` that still see two clusters, the first for each set of clusters."""
    seen = F.array_sort(F.array_distinct("comps"))
    first = F.min_by(F.struct(*[x.split()[0] for x in CONTRACTED.split(", ")]), modes.in_order(F.col("f"), F.col("i")))
    return rows.withColumn("seen", seen).where(F.size("seen") > 1).groupBy("seen").agg(first.alias("at")).select("at.*")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of :data:`CONTRACTED` with each cluster ``comp`` replaced by its ``root`` and that root's ``height``.

    A cluster that ``died`` at a saddle leaves its list, so the others keep their order there."""
    each = materialise(rows.select("i", "f", "basins", F.posexplode("comps").alias("pos", "comp")), "basins-seen")
    named = modes.join_unique(each, labels, "comp").where("died IS NULL OR died <> i")
    order = F.array_sort(F.collect_list(F.struct("pos", "root", "height")))
    whole = named.groupBy("i").agg(F.first("f").alias("f"), F.first("basins").alias("basins"), order.alias("o"))
    return whole.select("i", "f", "basins", F.transform("o", lambda x: x["root"]).alias("comps"), F.transform("o", lambda x: x["height"]).alias("heights"))


def merge_tree(kept: DataFrame, maxima: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``birth, death, persistence, other, basins``: where every root that ever dies does so at the infinite
    threshold, and what it follows: the ``other`` basin of a saddle of two, or the list of a saddle of more.

    ``kept`` are saddles ``i, f, basins``, ``maxima`` the modes ``i, f``.  Rounds go on until ``one_task`` saddles are
    left, which one task finishes.  Each round contracts every cluster whose first saddle shows a higher
    root, and so at least half of each run of clusters that wait for one another at random heights.
    """
    labels = maxima.select(F.col("i").alias("comp"), F.col("i").alias("root"), F.col("f").alias("height"), F.lit(None).cast("long").alias("died"))
    rows = kept.select("i", "f", "basins", F.col("basins").alias("comps"))
    left = materialise(_contracted(_relabelled(rows, labels)), "contracted")
    found = []
    while left.limit(one_task + 1).count() > one_task:
        each = left.select("i", "f", F.explode(F.arrays_zip("comps", "heights")).alias("c")).select("i", "f", "c.comps", "c.heights")
        firsts = each.groupBy(F.col("comps").alias("comp")).agg(F.min_by("i", modes.in_order(F.col("f"), F.col("i"))).alias("i"), F.first("heights").alias("height"))
        firsts = materialise(firsts, "first-saddles")
        picked = left.join(firsts.groupBy("i").agg(F.collect_list("comp").alias("picked")), "i")  # a saddle's own clusters
        deaths = materialise(picked.mapInPandas(_decide, DEATHS), "deaths")
        to = firsts.join(deaths.select(F.col("root").alias("comp"), "target"), "comp", "left")
        ends = modes.seek_modes(to.select(F.col("comp").alias("i"), F.coalesce("target", "comp").alias("parent")))
        tops = firsts.select(F.col("comp").alias("root"), "height")
        died = deaths.select(F.col("root").alias("comp"), F.col("death").alias("died"))
        labels = ends.join(tops, "root").select(F.col("i").alias("comp"), "root", "height").join(died, "comp", "left")
        left = materialise(_contracted(_relabelled(left, labels)), "contracted")
        found.append(deaths)
    found.append(materialise(left.coalesce(1).mapInPandas(_finish, DEATHS), "deaths"))
    return functools.reduce(DataFrame.unionByName, found).drop("root", "target")


def merges_of_tree(tree: DataFrame, maxima: DataFrame, taus: Sequence[float]) -> DataFrame:
    """Rows of :data:`MERGES` for every threshold from the merge tree.

    Nodes are (threshold, vertex) pairs, modes and saddles of more than two basins.  Pointers are doubled,
    saddles whose basins' clusters are known are turned into pointers, and again, until none is left.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("tau")) for k, t in enumerate(taus)])).alias("cell")
    dying = tree.select("*", cells).where(F.col("persistence") < F.col("cell.tau")).select("birth", "death", "persistence", "other", "basins", "cell.k", "cell.tau")
    dying = materialise(dying, "dying")
    node = lambda v: F.struct(F.col("k"), F.col(v).alias("v"))
    forks = materialise(dying.where("basins is not null").groupBy("k", F.col("death").alias("s")).agg(F.first("basins").alias("basins")), "forks")
    followed = dying.select(node("birth").alias("i"), F.struct("k", F.coalesce("other", "death").alias("v")).alias("parent"))
    named = dying.select(node("other").alias("i")).where("i.v is not null").unionByName(forks.select(node("s").alias("i"))).unionByName(forks.select("k", F.explode("basins").alias("b")).select(node("b").alias("i")))
    fixed = named.distinct().join(followed.select("i"), "i", "left_anti").select("i", F.col("i").alias("parent"))
    ends = modes.seek_modes(followed.unionByName(fixed), one_task=0)
    height = maxima.select(F.col("i").alias("t"), F.col("f").alias("height"))
    while not forks.isEmpty():
        each = forks.select("k", "s", F.posexplode("basins").alias("pos", "b")).select("k", "s", "pos", node("b").alias("i"))
        seen = each.join(ends, "i").select("k", "s", "pos", F.col("root.v").alias("t")).where("s <> t").join(height, "t", "left")  # no height: a fork
        best = F.max_by("t", F.struct(F.coalesce("height", F.lit(-math.inf)), -F.col("pos")))
        chosen = seen.groupBy("k", "s").agg(best.alias("t"), (F.count_distinct("t") == 1).alias("one"), F.count_if(F.col("height").isNull()).alias("open"))
        chosen = materialise(chosen.where("one OR open = 0").select("k", "s", "t"), "turned")
        turned = chosen.select(node("s").alias("i"), F.struct("k", F.col("t").alias("v")).alias("parent"))
        rest = ends.join(turned.select("i"), "i", "left_anti").select("i", F.col("root").alias("parent"))
        ends = modes.seek_modes(rest.unionByName(turned), one_task=0)
        forks = materialise(forks.join(chosen.select("k", "s"), ["k", "s"], "left_anti"), "forks")
    pairs = dying.select("tau", F.lit("pair").alias("kind"), F.col("birth").alias("a"), F.col("death").alias("b"), "persistence")
    back = F.element_at(F.array(*[F.lit(float(t)) for t in taus]), F.col("i.k") + 1)
    moved = dying.select(node("birth").alias("i")).join(ends, "i")
    roots = moved.select(back.alias("tau"), F.lit("root").alias("kind"), F.col("i.v").alias("a"), F.col("root.v").alias("b"), F.lit(None).cast("double").alias("persistence"))
    return pairs.unionByName(roots)


def cluster_h0(edges: DataFrame, density: DataFrame, taus: Sequence[float], one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """Clusters and persistence pairs of a neighbour graph for every threshold.

    Returns ``assignment(tau, i, root)`` and ``pairs(tau, birth, death, persistence)``; a root that
    survives has a null death and persistence.  Merging needs a persistence strictly below the
    threshold; ties in density are broken by the smaller id in the sweep and by list order among
    neighbours.  Densities of null or NaN are an error; an empty graph gives empty tables.
    """
    density = materialise(checked(density), "density")
    uphill = materialise(modes.uphill_edges(edges, density), "uphill")
    roots = materialise(modes.seek_modes(modes.steepest_parents(uphill, density)), "roots")
    merges = materialise(merge_basins(saddles(uphill, roots), modes.local_maxima(uphill, density), taus, one_task), "merges")
    grid = [float(t) for t in taus]
    place = F.array_position(F.array(*[F.lit(t) for t in grid]), F.col("tau")).cast("int")
    moved = merges.where("kind = 'root' and a <> b").groupBy(F.col("a").alias("root")).agg(F.map_from_entries(F.collect_set(F.struct(place, F.col("b")))).alias("final"))
    ends = roots.where("i = root").select("root").join(moved, "root", "left")  # a row for each mode
    whole = modes.join_unique(roots, ends, "root").select("i", "root", "final", F.explode(F.array(*[F.lit(t) for t in grid])).alias("tau"))
    assignment = whole.select("tau", "i", F.coalesce(F.try_element_at("final", place), "root").alias("root"))
    finite = merges.where("kind = 'pair'").select("tau", F.col("a").alias("birth"), F.col("b").alias("death"), "persistence")
    maxima = roots.where("i = root").select("i", F.explode(F.array(*[F.lit(t) for t in grid])).alias("tau"))
    infinite = maxima.join(finite.select("tau", F.col("birth").alias("i")), ["tau", "i"], "left_anti")
    pairs = finite.unionByName(infinite.select("tau", F.col("i").alias("birth"), F.lit(None).cast("long").alias("death"), F.lit(None).cast("double").alias("persistence")))
    return assignment, pairs


def pairs_below(pairs: DataFrame, tau: float) -> DataFrame:
    """The finite pairs at a threshold, from the finite pairs of the infinite threshold."""
    return pairs.where((F.col("persistence") < tau) & F.col("death").isNotNull())


def cluster_counts(pairs: DataFrame, taus: Sequence[float]) -> DataFrame:
    """``tau, clusters`` for every threshold from one run at the infinite threshold: the number of
    modes less the pairs whose persistence lies below it."""
    counts = [F.count(F.when(F.col("death").isNull() | ~(F.col("persistence") < F.lit(float(t))), 1)).alias(f"c{k}") for k, t in enumerate(taus)]
    rows = [F.struct(F.lit(float(t)).alias("tau"), F.col(f"c{k}").alias("clusters")) for k, t in enumerate(taus)]
    return pairs.agg(*counts).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def _greedy_sweep(group: pd.DataFrame) -> pd.DataFrame:
    """Every vertex joins the neighbouring cluster whose root is densest at that time."""
    tau = float(group["tau"].iloc[0])
    group = group.sort_values(["f", "i"], ascending=[False, True])
    height = dict(zip(group["i"].tolist(), group["f"].tolist(), strict=True))
    forest, rows = Forest(), []
    for i, f, near in zip(group["i"].tolist(), group["f"].tolist(), group["near"], strict=True):
        seen = list(dict.fromkeys(forest.find(j) for j in near))
        if not seen:
            continue
        top = max(seen, key=lambda r: height[r])
        for root in seen:
            if root != top and height[root] - f < tau:
                forest.up[root] = top
                rows.append((tau, "pair", root, i, height[root] - f))
        forest.up[i] = top
    return pd.DataFrame(rows + [(tau, "root", i, forest.find(i), None) for i in height], columns=["tau", "kind", "a", "b", "persistence"])


def cluster_h0_greedy(edges: DataFrame, density: DataFrame, taus: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """As :func:`cluster_h0`, but a vertex joins the neighbouring cluster with the densest root.

    At an infinite threshold every cluster that a vertex sees becomes one, whichever it joins first, so
    where all densities are finite that threshold takes the contracted form of :func:`cluster_h0`.  At
    others the choice depends on the merges so far and nothing contracts, but nothing crosses from one
    connected part of the graph to another either, and those are the clusters at the infinite threshold: each
    part is swept by a task of its own per threshold, with its vertices and uphill lists.  A part must fit
    a worker; with infinite densities the whole graph counts as one part.
    """
    density = materialise(checked(density), "density")
    if not density.where(F.abs("f") == F.lit(math.inf)).isEmpty():
        return _swept_greedily(edges, density, density.select("i", F.lit(0).cast("long").alias("part")), taus)
    assignment, pairs = cluster_h0(edges, density, [math.inf])
    swept = [t for t in taus if t != math.inf]
    if not swept:
        return assignment, pairs
    found = _swept_greedily(edges, density, assignment.select("i", F.col("root").alias("part")), swept)
    return tuple(a.unionByName(b) for a, b in zip(found, (assignment, pairs), strict=True)) if math.inf in taus else found


def _swept_greedily(edges: DataFrame, density: DataFrame, parts: DataFrame, taus: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """``assignment`` and ``pairs`` of :func:`cluster_h0_greedy`, one group for each threshold and part."""
    uphill = modes.uphill_edges(edges, density)
    order = F.array_sort(F.collect_list(F.struct("rk", "j")))
    lists = uphill.groupBy("i").agg(F.transform(order, lambda s: s["j"]).alias("near"))
    rows = density.join(parts, "i").join(lists, "i", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    each = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    merges = materialise(each.groupBy("tau", "part").applyInPandas(_greedy_sweep, MERGES), "merges")
    assignment = merges.where("kind = 'root'").select("tau", F.col("a").alias("i"), F.col("b").alias("root"))
    finite = merges.where("kind = 'pair'").select("tau", F.col("a").alias("birth"), F.col("b").alias("death"), "persistence")
    infinite = assignment.where("i = root").select("tau", F.col("i").alias("birth"), F.lit(None).cast("long").alias("death"), F.lit(None).cast("double").alias("persistence"))
    return assignment, finite.unionByName(infinite)


def tau_grid(tau_min: float, tau_max: float, num: int) -> list[float]:
    """Evenly spaced thresholds, and infinity."""
    return [*np.linspace(tau_min, tau_max, num).tolist(), math.inf]


def persistence_pairs(pairs: DataFrame, density: DataFrame) -> DataFrame:
    """``birth, death, birth_density, death_density, persistence, rank``: pairs with their densities.

    Finite pairs are ranked from 1 by persistence, largest first, then by birth and death; surviving
    roots have a null death, death density, persistence and rank.
    """
    at = density.select(F.col("i").alias("birth"), F.col("f").alias("birth_density"))
    to = density.select(F.col("i").alias("death"), F.col("f").alias("death_density"))
    both = pairs.select("birth", "death").join(at, "birth").join(to, "death", "left").withColumn("persistence", F.col("birth_density") - F.col("death_density"))
    finite = both.where("death is not null")
    keyed = finite.withColumn("key", F.struct((-F.col("persistence")).alias("p"), "birth", "death"))
    rank = modes.dense_index(keyed, "key", "nth").select("key", (F.col("nth") + 1).alias("rank"))
    ranked = keyed.join(rank, "key").drop("key")
    return ranked.unionByName(both.where("death is null").withColumn("rank", F.lit(None).cast("long"))).select("birth", "death", "birth_density", "death_density", "persistence", "rank")


def components(sorted_pairs: DataFrame) -> DataFrame:
    """``position, birth``: surviving roots by id, then births of finite pairs by rank."""
    infinite = sorted_pairs.where("death is null").select("birth")
    nth = modes.dense_index(infinite, "birth", "position").select("position", "birth")
    survivors = infinite.agg(F.count("*").alias("n"))
    finite = sorted_pairs.where("death is not null").join(F.broadcast(survivors)).select((F.col("rank") - 1 + F.col("n")).alias("position"), "birth")
    return nth.unionByName(finite)


def rank_curve(sorted_pairs: DataFrame) -> DataFrame:
    """``x, persistence``: finite persistences against their place among all components."""
    survivors = sorted_pairs.agg(F.count(F.when(F.col("death").isNull(), 1)).alias("n"))
    return sorted_pairs.where("death is not null").join(F.broadcast(survivors)).select((F.col("rank") + F.col("n")).alias("x"), "persistence")


def diagram(sorted_pairs: DataFrame, inf_delta: float = 0.08) -> DataFrame:
    """``birth, x, y, infinite``: points of the persistence diagram.

    Surviving roots are drawn at ``inf_delta`` of the range of deaths below the lowest death.
    """
    lims = sorted_pairs.agg(F.min("death_density").alias("lo"), F.max("death_density").alias("hi"))
    y = F.coalesce("death_density", F.col("lo") - F.lit(inf_delta) * (F.col("hi") - F.col("lo")))
    return sorted_pairs.join(F.broadcast(lims)).select("birth", F.col("birth_density").alias("x"), y.alias("y"), F.col("death").isNull().alias("infinite"))


def losses(sorted_pairs: DataFrame, n_components: int) -> DataFrame:
    """``saliency, shrinkage, loss``: the ``n_components - 1`` largest persistences are to grow, the
    rest to shrink; 0 where there is none."""
    top, rest = (F.coalesce(F.sum(F.when(c, F.col("persistence"))), F.lit(0.0)) for c in (F.col("rank") <= n_components - 1, F.col("rank") >= n_components))
    return sorted_pairs.agg((-top).alias("saliency"), rest.alias("shrinkage")).withColumn("loss", F.col("saliency") + F.col("shrinkage"))


def top_components(sorted_pairs: DataFrame, top_k: int) -> DataFrame:
    """``birth`` of the first ``top_k`` components."""
    return components(sorted_pairs).where(F.col("position") < top_k).select("birth")


def persistence_gradient(sorted_pairs: DataFrame, n_components: int) -> DataFrame:
    """``i, gradient``: derivative of the loss with respect to each vertex's density.

    The pairing is constant in small steps, so every pair adds its sign at its birth and takes it
    away at its death.
    """
    sign = F.when(F.col("rank") <= n_components - 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    finite = sorted_pairs.where("death is not null").select("birth", "death", sign.alias("s"))
    ends = finite.select(F.col("birth").alias("i"), F.col("s").alias("g")).unionByName(finite.select(F.col("death").alias("i"), (-F.col("s")).alias("g")))
    return ends.groupBy("i").agg(F.sum("g").alias("gradient"))

