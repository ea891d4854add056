"""Layouts in the plane: t-SNE and UMAP as rounds over blocks of points.

Both start from the k nearest neighbours of every point, in a table, and from principal components.  Points are
dealt to blocks.  In a round a block's task holds its own points with the list of their neighbours, where those
neighbours were when the round began, and a summary of the whole layout of bounded size; it takes several
small steps and writes its points.  Neighbour lists point away from a point, k of them; the pull of the points that
list it comes as one spring (a weight and a weighted target, summed by Spark), so a point that very many
list is no larger than any other.  No task and no message grows with the table, but for the number of blocks.

t-SNE: entropy-calibrated neighbour probabilities; repulsion of all points at once by the kernel's sums on
a grid (charges summed by Spark, spread by fast Fourier transforms, read back by interpolation).
UMAP: fuzzy union of local neighbourhoods; sampled attraction, repulsion from a bounded sample of the layout.
"""

from __future__ import annotations

import math
from abc import abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.functions.vectors import usable
from basinflow.operators.knn import Knn, knn_exact
from basinflow.operators.reduction import PrincipalComponents, Reducer
from basinflow.sources.shared import discard, materialise
from basinflow.sources.tables import sample_rows

STATE = "block int, i long, x double, y double, vx double, vy double, js array<long>, ws array<double>"
#: What a block writes: its points (spring null), and the springs by which they pull others (js null).
WRITTEN = f"{STATE}, spring double"


# --- neighbour weights --------------------------------------------------------------------------


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one matrix, infinite beyond their ends, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), max(1, sizes.max(initial=0))), np.inf)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out, sizes


def entropy_weights(dist: np.ndarray, sizes: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise probabilities exp(-beta * dist) whose entropy is ln(perplexity), beta by bisection.

    Rows of no more than ``perplexity`` entries are as even as their distances allow."""
    gaps = dist - dist.min(axis=1, keepdims=True, initial=np.inf)
    gaps[~np.isfinite(gaps)] = np.inf
    low, high = np.full(len(dist), -60.0), np.full(len(dist), 60.0)
    scale = np.where(np.isfinite(gaps), gaps, 0).sum(axis=1) / np.maximum(sizes, 1)
    scale[scale == 0] = 1.0
    for _ in range(60):
        middle = (low + high) / 2
        p = np.exp(-gaps * (np.exp(middle) / scale)[:, None])
        total = p.sum(axis=1)
        entropy = np.log(np.maximum(total, 1e-300)) + (p * np.where(np.isfinite(gaps), gaps, 0)).sum(axis=1) * np.exp(middle) / scale / np.maximum(total, 1e-300)
        wide = entropy > math.log(perplexity)
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return p / np.maximum(total, 1e-300)[:, None]


def fuzzy_weights(dist: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Memberships exp(-(dist - nearest) / sigma) that add up to log2 of the number of neighbours in each row."""
    near = dist.min(axis=1, keepdims=True, initial=np.inf)
    gaps = np.maximum(dist - np.where(np.isfinite(near), near, 0), 0)
    target = np.log2(np.maximum(sizes, 2))
    scale = np.where(np.isfinite(gaps), gaps, 0).sum(axis=1) / np.maximum(sizes, 1)
    scale[scale == 0] = 1.0
    low, high = np.full(len(dist), -30.0), np.full(len(dist), 30.0)
    for _ in range(50):
        middle = (low + high) / 2
        p = np.exp(-gaps / (np.exp(middle) * scale)[:, None])
        wide = p.sum(axis=1) > target
        low, high = np.where(wide, low, middle), np.where(wide, middle, high)
    return p


def neighbour_weights(graph: DataFrame, weigh) -> DataFrame:
    """``i, j, w`` of ``graph(i, j, dist)`` without loops; ``weigh(distances, sizes)`` sees one row a point."""
    lists = graph.where("i <> j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("dist", "j"))).alias("n"))  # k at most
    rows = lists.select("i", F.transform("n", lambda s: s["j"]).alias("js"), F.transform("n", lambda s: s["dist"]).alias("ds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist, sizes = padded(batch.column(2))
                w = weigh(dist, sizes)[np.arange(dist.shape[1])[None, :] < sizes[:, None]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(w))], names=["i", "js", "ws"])

    weighed = rows.mapInArrow(run, "i long, js array<long>, ws array<double>")
    return weighed.select("i", F.explode(F.arrays_zip("js", "ws")).alias("e")).select("i", F.col("e.js").alias("j"), F.col("e.ws").alias("w"))


# --- what a block does --------------------------------------------------------------------------


@dataclass
class Block:
    """Points of a block in the order of their ids, and their edges ``src`` (row) to ``dst`` (row of ``where``), which
    holds the block's own points first and then those of other blocks."""

    ids: np.ndarray
    where: np.ndarray
    speed: np.ndarray
    springs: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weights: np.ndarray

    @property
    def own(self) -> np.ndarray:
        return self.where[: len(self.ids)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of edge values by point."""
        return np.stack([np.bincount(self.src, weights=c, minlength=len(self.ids)) for c in values.T], axis=1)


def block_of(points: pa.Table, halo: pa.Table) -> tuple[Block, pa.Table]:
    points = points.sort_by("i").combine_chunks()
    column = lambda t, c: t.column(c).to_numpy()
    ids = column(points, "i")
    others = halo.sort_by("j") if halo.num_rows else halo
    names = np.concatenate([ids, column(others, "j")]) if halo.num_rows else ids
    sides = ((points, "x", "y"), (others, "hx", "hy"))[: 1 + (halo.num_rows > 0)]
    places = [np.stack([column(t, x), column(t, y)], axis=1) for t, x, y in sides]
    js, lists = points.column("js").chunk(0), points.column("ws").chunk(0)
    order = np.argsort(names, kind="stable")
    targets = js.flatten().to_numpy()
    dst = order[np.searchsorted(names[order], targets)]
    src = np.repeat(np.arange(len(ids)), np.diff(js.offsets.to_numpy()))
    springs = np.stack([np.nan_to_num(column(points, c).astype(float)) for c in ("sw", "sx", "sy")], axis=1)
    speed = np.stack([column(points, c) for c in ("vx", "vy")], axis=1)
    return Block(ids, np.concatenate(places), speed, springs, src, dst, lists.flatten().to_numpy()), points


def written(block: Block, points: pa.Table, pull: np.ndarray) -> pa.Table:
    """The block's points, and what they pull others with: ``pull`` is each edge's weight now."""
    n, m = len(block.ids), len(pull)
    far = block.where[block.src] * pull[:, None]
    number = points.column("block").to_numpy()[:1]
    both = lambda own, edge: pa.array(np.concatenate([own, edge]))
    targets = points.column("js").chunk(0).flatten().to_numpy()
    nothing = lambda k: pa.nulls(m, k)
    lists = [pa.concat_arrays([points.column(c).chunk(0), nothing(k)]) for c, k in (("js", pa.list_(pa.int64())), ("ws", pa.list_(pa.float64())))]
    columns = [pa.array(np.repeat(number, n + m)), both(block.ids, targets), both(block.own[:, 0], far[:, 0]), both(block.own[:, 1], far[:, 1]), both(block.speed[:, 0], np.zeros(m)), both(block.speed[:, 1], np.zeros(m)), *lists, pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(pull)])]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in WRITTEN.split(", ")])


def _round(move, summary, number: int, n: int):
    """What a block's task does in a round."""

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        block, rows = block_of(own, others)
        return written(block, rows, move(block, summary, number, n))

    return run


class Layout(Reducer):
    """A layout of the plane from ``k`` neighbours, in ``rounds`` of ``steps`` steps; blocks have about ``block_rows`` points.

    ``fit_transform`` gives ``id, reduced`` for every usable vector with an id (of repeated ids one counts).  The same
    seed and table give the same layout for the same number of blocks, up to rounding.
    """

    def __init__(self, k: int = 15, rounds: int = 20, steps: int = 15, block_rows: int = 50_000, seed: int = 47, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        super().__init__(vector_col)
        self.k, self.rounds, self.steps, self.block_rows, self.seed, self.id_col = k, rounds, steps, block_rows, seed, id_col

    @abstractmethod
    def weights(self, graph: DataFrame, n: int) -> DataFrame:
        """``i, j, w``: directed pulls; each counts at both ends."""

    @abstractmethod
    def summary(self, state: DataFrame, n: int):
        """What every block gets to know of the whole layout; of bounded size."""

    @abstractmethod
    def move(self, block: Block, summary, round_no: int, n: int) -> np.ndarray:
        """Take the steps of a round in place; returns the weight of each edge's pull at the end."""

    @property
    @abstractmethod
    def spread(self) -> float:
        """Standard deviation of the first component at the start."""

    def start(self, x: DataFrame) -> DataFrame:
        """``i, x, y``: two principal components, scaled."""
        rows = x.where(F.col(self.id_col).isNotNull() & usable(F.col(self.vector_col))).dropDuplicates([self.id_col])
        plane = PrincipalComponents(2, self.vector_col).fit_transform(rows).select(F.col(self.id_col).cast("long").alias("i"), F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))
        plane = materialise(plane, "plane")
        mx, my, size = plane.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x")).first()
        scale = self.spread / (size or 1.0)
        jitter = lambda salt: (F.pmod(F.xxhash64("i", F.lit(self.seed + salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * (0.02 * self.spread)
        return plane.select("i", ((F.col("x") - mx) * scale + jitter(1)).alias("x"), ((F.col("y") - my) * scale + jitter(2)).alias("y"))

    def fit(self, x: DataFrame) -> Layout:
        self.layout = None
        graph = materialise(knn_exact(x, Knn(self.k + 1), id_col=self.id_col, vector_col=self.vector_col).select("i", "j", "dist"), "knn")
        start = materialise(self.start(x), "start")
        n = start.count()
        if n < 3:
            self.layout = start
            return self
        blocks = -(-n // self.block_rows)
        pulls = self.weights(graph, n).groupBy("i").agg(F.collect_list(F.struct("j", "w")).alias("e"))
        lists = pulls.select("i", F.transform("e", lambda s: s["j"]).alias("js"), F.transform("e", lambda s: s["w"]).alias("ws"))
        block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("block")
        zero, none = F.lit(0.0), F.array()
        state = start.join(lists, "i", "left").select(block, "i", "x", "y", zero.alias("vx"), zero.alias("vy"), F.coalesce("js", none.cast("array<long>")).alias("js"), F.coalesce("ws", none.cast("array<double>")).alias("ws"))
        state = materialise(state, "layout")
        halo = state.select("block", F.explode("js").alias("j")).where(F.pmod(F.xxhash64("j"), F.lit(blocks)) != F.col("block")).distinct()
        halo = materialise(halo, "halo")
        springs = state.select("i", zero.alias("sw"), zero.alias("sx"), zero.alias("sy")).limit(0)
        for number in range(self.rounds):
            summary = self.summary(state, n)
            points = state.join(springs, "i", "left").groupBy("block")
            seen = halo.join(state.select(F.col("i").alias("j"), F.col("x").alias("hx"), F.col("y").alias("hy")), "j").select("block", "j", "hx", "hy").groupBy("block")
            out = materialise(points.cogroup(seen).applyInArrow(_round(self.move, summary, number, n), WRITTEN), "layout")
            if number:
                discard(state)
            state = out.where("spring is null").drop("spring")
            springs = out.where("spring is not null").groupBy("i").agg(F.sum("spring").alias("sw"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        self.layout = materialise(state.select("i", "x", "y"), "layout")
        return self

    def transform(self, x: DataFrame) -> DataFrame:
        """``x`` with its points of the layout; rows that were not fitted get null (see :meth:`UMAP.place`)."""
        rows = self.layout.select(F.col("i").alias(self.id_col), F.array("x", "y").alias("reduced"))
        return x.join(rows, self.id_col, "left")


# --- t-SNE --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Nodes of a square grid; what lies outside counts at its edge."""

    low: float
    step: float
    nodes: int

    def corners(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Four nodes around each place and their shares."""
        t = np.clip((where - self.low) / self.step, 0, self.nodes - 1.000001)
        cell, rest = t.astype(int), t - t.astype(int)
        at = [(cell[:, 0] + a) * self.nodes + cell[:, 1] + b for a in (0, 1) for b in (0, 1)]
        share = [np.abs(1 - a - rest[:, 0]) * np.abs(1 - b - rest[:, 1]) for a in (0, 1) for b in (0, 1)]
        return np.stack(at, axis=1), np.stack(share, axis=1)

    def charges(self, where: np.ndarray) -> np.ndarray:
        """Number and sums of both coordinates at each node."""
        at, share = self.corners(where)
        values = [np.ones(len(where)), where[:, 0], where[:, 1]]
        return np.stack([np.bincount(at.ravel(), weights=(share * v[:, None]).ravel(), minlength=self.nodes**2) for v in values])

    def kernels(self) -> tuple[np.ndarray, np.ndarray]:
        """Transforms of 1 / (1 + d^2) and its square, for sums over the grid."""
        d = np.minimum(np.arange(2 * self.nodes), 2 * self.nodes - np.arange(2 * self.nodes)) * self.step
        near = 1 / (1 + d[:, None] ** 2 + d[None, :] ** 2)
        return np.fft.rfft2(near), np.fft.rfft2(near**2)

    def fields(self, charges: np.ndarray, where: np.ndarray, kernels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """At each place: the kernel's sum over all charges, and the squared kernel's with both coordinates."""
        n = self.nodes
        waves = [np.fft.rfft2(c.reshape(n, n), s=(2 * n, 2 * n)) for c in charges]
        spread = [np.fft.irfft2(w * k, s=(2 * n, 2 * n))[:n, :n].ravel() for w, k in zip([waves[0], *waves], [kernels[0], *[kernels[1]] * 3], strict=True)]
        at, share = self.corners(where)
        return np.stack([(s[at] * share).sum(axis=1) for s in spread])


class TSNE(Layout):
    """t-distributed stochastic neighbour embedding with ``perplexity`` (at most about a third of ``k``)."""

    def __init__(self, perplexity: float = 10.0, k: int = 30, exaggeration: float = 12.0, most_nodes: int = 256, **how) -> None:
        super().__init__(k=k, **how)
        self.perplexity, self.exaggeration, self.most_nodes = perplexity, exaggeration, most_nodes

    spread = 1e-2

    def weights(self, graph: DataFrame, n: int) -> DataFrame:
        perplexity = self.perplexity
        found = neighbour_weights(graph, lambda dist, sizes: entropy_weights(dist, sizes, perplexity))
        return found.select("i", "j", (F.col("w") / (2.0 * n)).alias("w"))

    def summary(self, state: DataFrame, n: int) -> tuple[Grid, np.ndarray]:
        """The grid over all points and its charges: at most ``most_nodes`` squared nodes, whatever the table."""
        low, high = state.agg(F.least(F.min("x"), F.min("y")), F.greatest(F.max("x"), F.max("y"))).first()
        margin = 0.1 * (high - low) + 2.0
        width = high - low + 2 * margin
        nodes = int(min(self.most_nodes, max(48, 2 * width)))
        grid = Grid(low - margin, width / (nodes - 1), nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, nodes * nodes))
            for batch in batches:
                total += grid.charges(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            some = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], names=["node", "n", "x", "y"])

        sums = state.select("x", "y").mapInArrow(run, "node long, n double, x double, y double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])
        charges = np.zeros((3, nodes * nodes))
        rows = sums.toArrow()
        charges[:, rows.column("node").to_numpy()] = [rows.column(c).to_numpy() for c in ("n", "x", "y")]
        return grid, charges

    def move(self, block: Block, summary: tuple[Grid, np.ndarray], round_no: int, n: int) -> np.ndarray:
        grid, total = summary
        kernels, others = grid.kernels(), total - grid.charges(block.own)
        early = round_no < max(1, self.rounds // 4)
        boost, momentum, rate = (self.exaggeration, 0.5, max(n / self.exaggeration, 50.0)) if early else (1.0, 0.8, max(n / 4, 200.0))
        z = None
        for _ in range(self.steps):
            own = block.own
            fields = grid.fields(others + grid.charges(own), own, kernels)
            z = max(float((fields[0] - 1).mean()) * n, 1e-12)  # every block's mean stands for the whole
            repulsion = (own * fields[1][:, None] - fields[2:].T) / z
            gap = own[block.src] - block.where[block.dst]
            near = block.weights / (1 + (gap**2).sum(axis=1))
            pull = block.sums(gap * near[:, None]) + own * block.springs[:, :1] - block.springs[:, 1:]
            block.speed = momentum * block.speed - rate * 4 * (boost * pull - repulsion)
            longest = np.sqrt((block.speed**2).sum(axis=1, keepdims=True))
            block.speed *= np.minimum(1.0, 5.0 / np.maximum(longest, 1e-12))
            block.where[: len(own)] = own + block.speed
        gap = block.own[block.src] - block.where[block.dst]
        return block.weights / (1 + (gap**2).sum(axis=1))


# --- UMAP ---------------------------------------------------------------------------------------


class UMAP(Layout):
    """Uniform manifold approximation: ``negatives`` points of a sample of ``sample`` repel for each pull."""

    #: The curve 1 / (1 + A d^(2 B)) fitted to a least distance of 0.1.
    A, B = 1.577, 0.8951

    def __init__(self, k: int = 15, negatives: int = 5, sample: int = 4096, **how) -> None:
        super().__init__(k=k, **how)
        self.negatives, self.sample = negatives, sample

    spread = 5.0

    def weights(self, graph: DataFrame, n: int) -> DataFrame:
        """Half of the fuzzy union of both directions, w = a + b - a b, for each: pulls count at both ends."""
        rooted = graph.select("i", "j", F.sqrt("dist").alias("dist"))
        found = materialise(neighbour_weights(rooted, fuzzy_weights), "memberships")
        back = found.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("b"))
        both = found.join(back, ["i", "j"], "left")
        return both.select("i", "j", F.when(F.col("b").isNull(), F.col("w")).otherwise((F.col("w") + F.col("b") - F.col("w") * F.col("b")) / 2).alias("w"))

    def summary(self, state: DataFrame, n: int) -> np.ndarray:
        rows = sample_rows(state.select("i", "x", "y"), self.sample, "i", self.seed).toArrow()
        return np.stack([rows.column("x").to_numpy(), rows.column("y").to_numpy()], axis=1)

    def move(self, block: Block, summary: np.ndarray, round_no: int, n: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, round_no, int(block.ids[0]) & 0x7FFFFFFF])
        chance = block.weights / max(block.weights.max(initial=0), 1e-12)

        def slope(gap: np.ndarray) -> np.ndarray:
            d2 = (gap**2).sum(axis=1)
            return np.where(d2 > 0, 2 * self.A * self.B * np.maximum(d2, 1e-12) ** (self.B - 1) / (1 + self.A * d2**self.B), 0.0)

        for step in range(self.steps):
            rate = 1 - (round_no * self.steps + step) / (self.rounds * self.steps)
            own = block.own
            taken = rng.random(len(chance)) < chance
            src, gap = block.src[taken], own[block.src[taken]] - block.where[block.dst[taken]]
            force = -np.clip(gap * slope(gap)[:, None], -4, 4)
            far = np.repeat(src, self.negatives)
            away = own[far] - summary[rng.integers(0, len(summary), len(far))]
            d2 = (away**2).sum(axis=1)
            push = np.clip(away * (2 * self.B / ((0.001 + d2) * (1 + self.A * d2**self.B)))[:, None], -4, 4)
            moved = np.zeros_like(own)
            for k in (0, 1):
                moved[:, k] = np.bincount(src, weights=force[:, k], minlength=len(own)) + np.bincount(far, weights=push[:, k], minlength=len(own))
            moved -= np.clip(own * block.springs[:, :1] - block.springs[:, 1:], -4, 4)
            block.where[: len(own)] = own + rate * moved
        gap = block.own[block.src] - block.where[block.dst]
        return chance * slope(gap)

    def place(self, x: DataFrame, fitted: DataFrame) -> DataFrame:
        """``id, reduced`` of new rows: the mean of their ``k`` nearest fitted rows' places, by membership."""
        graph = materialise(knn_exact(x, Knn(self.k), fitted.join(self.layout.select(F.col("i").alias(self.id_col)), self.id_col, "left_semi"), self.id_col, self.vector_col), "knn")
        near = graph.groupBy("i").agg(F.min(F.sqrt("dist")).alias("least"), F.avg(F.sqrt("dist")).alias("mean"))
        share = F.exp(-(F.sqrt("dist") - F.col("least")) / F.greatest(F.col("mean") - F.col("least"), F.lit(1e-12)))
        rows = graph.join(near, "i").select("i", "j", share.alias("w")).join(self.layout.select(F.col("i").alias("j"), "x", "y"), "j")
        at = rows.groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
        return at.select(F.col("i").alias(self.id_col), F.array("x", "y").alias("reduced"))


def neighbours_kept(x: DataFrame, reduced: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``kept``: the mean share of a point's ``k`` nearest others that are among its nearest in ``reduced(id, reduced)``."""
    near, there = (knn_exact(df, Knn(k + 1), id_col=id_col, vector_col=c).where("i <> j").select("i", "j") for df, c in ((x, vector_col), (reduced, "reduced")))
    return near.join(there.withColumn("hit", F.lit(1.0)), ["i", "j"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("kept"))
