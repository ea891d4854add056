"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards by their hash, so copies of a vector are one node that carries
its smallest row ids and no shard is larger for them.  A shard is built by one task and stored as one
row of flat arrays: vectors, row ids and, layer by layer, the neighbour lists.  Nodes are ordered by
their level, highest first, so layer ``l`` is simply the first ``n_l`` nodes.

Queries travel in blocks.  Index rows and blocks of one shard meet in one sorted stream, in which a
task holds one graph and one block at a time; a block is searched in lock step on arrays.  What the
shards return is merged by distance.  The walk uses 32-bit products; distances that are returned are
worked out anew in double precision from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.sources.shared import materialise


@dataclass(frozen=True)
class HnswParams:
    """``links`` per node above the ground layer and twice as many on it; ``build`` and ``search`` are
    the beam widths.  There is one shard for each core of the cluster, but each aims at ``least_rows`` rows
    at least and ``most_rows`` at most: with that many unclustered vectors of 64 dimensions in a shard, ``search``
    finds 0.94 of the ten nearest.  ``block`` queries are searched, ``batch`` nodes inserted together."""

    links: int = 16
    build: int = 64
    search: int = 160
    least_rows: int = 4096
    most_rows: int = 1 << 15
    block: int = 256
    batch: int = 128


class Graph:
    """Navigable layers over the rows of ``vectors``; ``layers[l]`` holds the neighbours of the first
    ``len(layers[l])`` nodes, -1 where a list is shorter."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        scale = float(np.abs(vectors).max()) if vectors.size else 1.0
        self.exact, self.scale, self.layers = vectors, scale or 1.0, layers
        self.near = (vectors / self.scale).astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.near, self.near)

    def distances(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each row of ``points`` to its row of ``nodes``; infinite for -1."""
        dots = np.matmul(self.near[nodes], points[:, :, None])[:, :, 0]
        found = np.maximum(self.norms[nodes] - 2 * dots + np.einsum("bd,bd->b", points, points)[:, None], 0)
        return np.where(nodes < 0, np.inf, found)

    def beam(self, points: np.ndarray, entry: np.ndarray, layer: int, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each point the ``width`` nearest nodes that a best-first walk from ``entry`` finds.

        All points advance together: in each round every point expands its ``step`` nearest nodes
        not yet expanded; a point is done when the beam holds none."""
        links = self.layers[layer]
        rows = np.arange(len(points))
        seen = np.zeros((len(points), len(links) + 1), dtype=bool)  # the last column takes the -1s
        seen[:, -1] = True
        seen[rows[:, None], entry] = True
        nodes, dists = ordered(entry, self.distances(points, entry), width)
        opened = np.zeros(nodes.shape, dtype=bool)
        while True:
            todo = ~opened & (nodes >= 0)
            rows = np.flatnonzero(todo.any(axis=1))
            if not len(rows):
                return nodes, dists
            pick = todo[rows] & (np.cumsum(todo[rows], axis=1) <= step)
            opened[rows] |= pick
            at, col = np.nonzero(pick)
            lists = np.full((len(rows), step, links.shape[1]), -1, dtype=np.int64)
            lists[at, np.cumsum(pick, axis=1)[at, col] - 1] = links[nodes[rows[at], col]]
            found = np.sort(lists.reshape(len(rows), -1), axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[rows[:, None], found]] = -1
            seen[rows[:, None], found] = True
            keep = (found >= 0).sum(axis=1).max()
            if not keep:
                continue
            found = np.sort(found, axis=1)[:, -keep:]
            every = np.concatenate([nodes[rows], found], axis=1)
            far = np.concatenate([dists[rows], self.distances(points[rows], found)], axis=1)
            was = np.concatenate([opened[rows], np.zeros(found.shape, dtype=bool)], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            wide = order.shape[1]
            if wide > nodes.shape[1]:
                nodes, dists, opened = (np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=v) for x, v in ((nodes, -1), (dists, np.inf), (opened, False)))
            nodes[rows], dists[rows], opened[rows] = (np.pad(np.take_along_axis(x, order, axis=1), ((0, 0), (0, nodes.shape[1] - wide)), constant_values=v) for x, v in ((every, -1), (far, np.inf), (was, False)))
            nodes[np.isinf(dists)] = -1

    def descend(self, points: np.ndarray, to: int, top: int) -> np.ndarray:
        """Entry node on layer ``to`` for each point: greedy walks from the first node down from ``top``."""
        entry = np.zeros((len(points), 1), dtype=np.int64)
        for layer in range(top, to, -1):
            entry = self.beam(points, entry, layer, 1, 1)[0][:, :1]
        return entry

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (nearest first, -1 where fewer) and their exact Euclidean distances to ``points``."""
        small = (points / self.scale).astype(np.float32)
        nodes, _ = self.beam(small, self.descend(small, 0, len(self.layers) - 1), 0, width)
        exact = np.empty(nodes.shape)
        for k, (point, row) in enumerate(zip(points, nodes, strict=True)):
            exact[k] = np.where(row < 0, np.inf, np.sqrt(((self.exact[row] - point) ** 2).sum(axis=1)))
        return ordered(nodes, exact, width)

    def select(self, base: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours of each ``base``: nearest first, those closer to a neighbour taken
        already than to the base come last."""
        nodes = np.sort(np.where(nodes == base[:, None], -1, nodes), axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
        nodes, far = ordered(nodes, self.distances(self.near[base], nodes), nodes.shape[1])
        points = self.near[nodes]
        norms = self.norms[nodes]
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        taken = np.zeros(nodes.shape, dtype=bool)
        for c in range(nodes.shape[1]):
            covered = (taken[:, :c] & (between[:, c, :c] < far[:, c, None])).any(axis=1)
            taken[:, c] = ~covered & (nodes[:, c] >= 0)
        order = np.argsort(np.where(nodes < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(nodes, order, axis=1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def link(self, layer: int, lo: int, hi: int, candidates: np.ndarray) -> None:
        """Give the new nodes ``lo`` to ``hi`` their neighbours and put them on those nodes' lists."""
        links = self.layers[layer]
        most = links.shape[1]
        new = np.arange(lo, hi)
        links[lo:hi] = self.select(new, candidates, most)
        source, col = np.nonzero(links[lo:hi] >= 0)
        target = links[lo:hi][source, col]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order] + lo
        found, starts, counts = np.unique(target, return_index=True, return_counts=True)
        by_count = np.argsort(counts, kind="stable")
        at = 0
        while at < len(found):
            size = max(1, 40_000 // (most + counts[by_count[min(len(found) - 1, at + 40_000 // most)]]))
            part = by_count[at : at + size]
            widest = counts[part].max()
            slots = starts[part][:, None] + np.arange(widest)
            more = np.where(np.arange(widest) < counts[part][:, None], source[np.minimum(slots, len(source) - 1)], -1)
            links[found[part]] = self.select(found[part], np.concatenate([links[found[part]], more], axis=1), most)
            at += size


def ordered(nodes: np.ndarray, dists: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dists, axis=1, kind="stable")[:, :width]
    nodes, dists = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(dists, order, axis=1)
    return np.where(np.isinf(dists), -1, nodes), dists


def levels_of(hashes: np.ndarray, links: int) -> np.ndarray:
    """Geometric levels drawn from the hash of each node, so that a rebuilt shard is the same."""
    uniform = (tk.mix64(hashes.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(-np.log(1 - uniform) / np.log(links), 30).astype(np.int64)


def build(vectors: np.ndarray, hashes: np.ndarray, p: HnswParams) -> tuple[np.ndarray, Graph]:
    """The order of the nodes (indices into ``vectors``) and the graph over them.

    Nodes are inserted in batches that at most double the graph; members of a batch are candidates
    for each other besides what the walk finds."""
    levels = levels_of(hashes, p.links)
    order = np.lexsort((hashes, -levels))
    levels = levels[order]
    counts = [int(np.count_nonzero(levels >= k)) for k in range(int(levels[0]) + 1)]
    graph = Graph(vectors[order], [np.full((n, p.links * (1 if k else 2)), -1, dtype=np.int32) for k, n in enumerate(counts)])
    lo = 1
    while lo < len(order):
        hi = min(len(order), lo + min(p.batch, lo))
        points = graph.near[lo:hi]
        entry = np.zeros((hi - lo, 1), dtype=np.int64)
        for layer in range(len(counts) - 1, -1, -1):
            own = min(hi, counts[layer]) - lo
            if own < hi - lo:
                rest = max(own, 0)
                entry[rest:] = graph.beam(points[rest:], entry[rest:, :1], layer, 1, 1)[0][:, :1]
            if own <= 0:
                continue
            found, _ = graph.beam(points[:own], entry[:own], layer, p.build)
            near = np.sum(points[:own] ** 2, axis=1)[None, :] - 2 * points[:own] @ points[:own].T
            np.fill_diagonal(near, np.inf)
            beside = np.argsort(near, axis=1, kind="stable")[:, : min(p.links, own - 1)] + lo
            entry[:own] = found[:, :1]
            graph.link(layer, lo, lo + own, np.concatenate([found, beside], axis=1))
        lo = hi
    return order, graph


INDEX = "shard long, dim int, vectors binary, id_ends binary, ids binary, layer_nodes array<int>, layers array<binary>"


def _build_batches(batches: Iterator[pa.RecordBatch], p: HnswParams) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, hash, vec, ids)`` sorted by shard become one row per shard."""
    kept: list[pa.RecordBatch] = []

    def finish() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(kept).combine_chunks()
        vec, ids = (table.column(k).chunk(0) for k in ("vec", "ids"))
        vectors = vec.flatten().to_numpy().reshape(len(vec), -1)
        order, graph = build(vectors, table.column("hash").to_numpy().view(np.uint64), p)
        ids = ids.take(pa.array(order))
        sizes = ids.value_lengths().to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("shard").chunk(0)[:1],
                pa.array([vectors.shape[1]], type=pa.int32()),
                pa.array([graph.exact.tobytes()], type=pa.binary()),
                pa.array([np.cumsum(sizes).tobytes()], type=pa.binary()),
                pa.array([ids.flatten().to_numpy().tobytes()], type=pa.binary()),
                pa.array([[len(x) for x in graph.layers]], type=pa.list_(pa.int32())),
                pa.array([[x.tobytes() for x in graph.layers]], type=pa.list_(pa.binary())),
            ],
            names=[x.split()[0] for x in INDEX.split(", ")],
        )

    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and kept[0].column(0)[0].as_py() != shard[lo]:
                yield from finish()
                kept = []
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield from finish()


def usable(vector: str) -> Column:
    """The vector as doubles if it may take part, else null."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(sound & F.exists(doubles, lambda x: x != 0), F.lit(False)), doubles)


def shard_base(vec: Column) -> Column:
    """Shards of vectors of different lengths never meet."""
    return F.size(vec).cast("long") * (1 << 31)


def build_index(corpus: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", p: HnswParams = HnswParams()) -> tuple[DataFrame, int]:
    """Index every usable row of ``corpus``; returns the index table and the number of shards per length.

    Of equal vectors the ``k + 1`` smallest row ids are held, all that a search for ``k`` can return.
    Rows without an id and vectors that are null, empty, zero or hold null or non-finite values take
    no part."""
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), usable(vector_col).alias("vec")).where("id is not null and vec is not null")
    count, cores = corpus.count(), corpus.sparkSession.sparkContext.defaultParallelism
    shards = min(max(1, count // p.least_rows), max(cores, -(-count // p.most_rows)))
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    nodes = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    dealt = nodes.select((shard_base(F.col("vec")) + F.pmod(F.xxhash64("vec"), F.lit(shards))).alias("shard"), F.xxhash64("vec", F.lit(1)).alias("hash"), "vec", "ids")
    placed = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "hash")
    return materialise(placed.mapInArrow(lambda b: _build_batches(b, p), INDEX), "hnsw"), shards


def _block_batches(batches: Iterator[pa.RecordBatch], p: HnswParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), p.block):
                part = batch.take(pa.array(rows[at : at + p.block]))
                vectors = part.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)], type=pa.int32()), pa.array([vectors.tobytes()], type=pa.binary()), pa.array([part.column(0).to_numpy().tobytes()], type=pa.binary())], names=["dim", "vectors", "ids"])


def nearest_nodes(graph: Graph, vectors: np.ndarray, ends: np.ndarray, k: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the nodes that hold the ``k + 1`` nearest rows, all those at the last distance included.

    A walk need not meet every node at one distance: where it finds several at the last, the shard is
    scanned for the others, at most ``most_rows`` of them."""
    for query, (nodes, dists) in enumerate(zip(*graph.search(vectors, width), strict=True)):
        nodes, dists = nodes[nodes >= 0], dists[nodes >= 0]
        last = dists[min(int(np.searchsorted(np.cumsum(ends[nodes + 1] - ends[nodes]), k + 1)), len(dists) - 1)]
        if np.count_nonzero(dists == last) > 1:
            parts = np.array_split(graph.exact, -(-len(graph.exact) // 4096))
            every = np.concatenate([np.sqrt(((part - vectors[query]) ** 2).sum(axis=1)) for part in parts])
            nodes = np.flatnonzero(every <= last)
            dists = every[nodes]
        yield query, nodes[dists <= last], dists[dists <= last]


def _search_batches(batches: Iterator[pa.RecordBatch], k: int, p: HnswParams) -> Iterator[pa.RecordBatch]:
    """A shard's index row comes first, then its query blocks."""
    graph = ends = ids = None
    for batch in batches:
        for row in range(batch.num_rows):
            x = {n: batch.column(j)[row] for j, n in enumerate(batch.schema.names)}
            vectors = np.frombuffer(x["vectors"].as_py()).reshape(-1, x["dim"].as_py())
            if x["is_query"].as_py() == 0:
                sizes = x["layer_nodes"].as_py()
                layers = [np.frombuffer(raw, dtype=np.int32).reshape(n, -1) for raw, n in zip(x["layers"].as_py(), sizes, strict=True)]
                graph, shard = Graph(vectors, layers), x["shard"].as_py()
                ends = np.concatenate([[0], np.frombuffer(x["id_ends"].as_py(), dtype=np.int64)])
                ids = np.frombuffer(x["ids"].as_py(), dtype=np.int64)
                continue
            if graph is None or shard != x["shard"].as_py():
                continue  # a shard that no vector fell into
            asked = np.frombuffer(x["ids"].as_py(), dtype=np.int64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for query, found, far in nearest_nodes(graph, vectors, ends, k, max(p.search, 2 * k)):
                counts = ends[found + 1] - ends[found]
                at = np.repeat(ends[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                near, score = ids[at], np.repeat(far, counts)
                own = np.flatnonzero((near == asked[query]) & (score == 0))[:1]
                near, score = np.delete(near, own), np.delete(score, own)
                best = np.lexsort((near, score))[:k]
                out.append((np.full(len(best), asked[query]), near[best], score[best]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", p: HnswParams = HnswParams()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows that the shards find for each query.

    Nearest first by Euclidean distance in double precision, ties to the smaller id.  One indexed row
    of a query's own id and vector is its own and left out; other copies stay.  Queries that repeat
    are answered once; unusable ones not at all; with fewer candidates than ``k`` all are returned.
    Other columns are ignored; empty tables give an empty result."""
    asked = queries.select(F.col(id_col).cast("long").alias("id"), usable(vector_col).alias("vec")).where("id is not null and vec is not null").distinct()
    blocks = asked.mapInArrow(lambda b: _block_batches(b, p), "dim int, vectors binary, ids binary")
    base = F.col("dim").cast("long") * (1 << 31)
    blocks = blocks.select(F.explode(F.sequence(base, base + (shards - 1))).alias("shard"), F.lit(1).alias("is_query"), "dim", "vectors", "ids")
    stream = index.withColumn("is_query", F.lit(0)).unionByName(blocks, allowMissingColumns=True)
    stream = stream.repartition(shards, "shard").sortWithinPartitions("shard", "is_query")
    found = stream.mapInArrow(lambda b: _search_batches(b, k, p), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", p: HnswParams = HnswParams()) -> DataFrame:
    """Index ``corpus`` and search it for ``queries``; see :func:`build_index` and :func:`search_index`."""
    index, shards = build_index(corpus, k, id_col, vector_col, p)
    return search_index(index, shards, queries, k, id_col, vector_col, p)
