"""k-nearest-neighbour search as a blocked join.

Corpus rows are dealt to chunks of bounded size; a query row is sent to the chunks it has to be
compared with (all of them in the exact search, those of the cells it probes in the inverted-file
searches).  Rows of one chunk meet in one sorted stream: the chunk's corpus rows come first and are
held as one matrix, then the queries pass by in Arrow batches and are compared with matrix products.
The exact search also deals queries to blocks and works tile by tile (a block against a chunk), so a
small corpus keeps all cores busy and a large set of queries is many tasks of bounded length.
Every chunk yields at most ``k`` rows per query, and a ranked window merges the chunks.  A cell that
holds a third of all rows is simply more chunks, so no task's memory follows the data.

The pruned search is exact too: corpus rows belong to their nearest pivot and lie in rings around it, a
query first searches the ring that it lies in itself, and what it finds there bounds which other rings
can hold anything nearer.  It is the one to use where vectors are clustered or have few dimensions.

The result is the long form ``i, rk, j, dist``: the ``rk``-th neighbour (from 1) of ``i``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinflow.functions.vectors import doubles, normalised, pnorm, usable
from basinflow.sources.shared import materialise
from basinflow.sources.tables import sample_rows

CHUNK_ROWS = 4096
#: The exact search: bytes of corpus vectors that a task holds, and query rows that pass by in one tile.
CHUNK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 20


@dataclass(frozen=True)
class Knn:
    """What is searched: ``k`` neighbours in the ``p``-norm.

    ``root=False`` reports the un-rooted power sum, for p = 2 the squared distance.  With
    ``normalize`` both sides are brought to unit p-norm first.  A point is its own neighbour when a
    table is searched for itself.
    """

    k: int
    p: float = 2
    root: bool = False
    normalize: bool = False


def vectors_of(df: DataFrame, spec: Knn, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of the rows that can be compared: an id, and a vector of finite components."""
    vec = F.col(vector_col)
    vec = normalised(vec, spec.p) if spec.normalize else doubles(vec)
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def power_sums(gaps: np.ndarray, p: float) -> np.ndarray:
    """Power sums (or extreme values) of differences, along the last axis."""
    gaps = np.abs(gaps)
    if math.isinf(p):
        return gaps.max(axis=-1) if p > 0 else gaps.min(axis=-1)
    return np.add.reduce(gaps * gaps if p == 2 else gaps**p, axis=-1)


def best_of_rows(rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest distances of each row, in order, ties to the smaller id."""
    order = np.lexsort((ids, dist, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, dtype=int)
    nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return order[nth < k]


#: A row of rough distances is looked through by the least of every so many entries.
GROUP = 64
#: Queries and columns of a tile of sums of absolute differences (tiles that stay in the processor's cache), and
#: components that are added up in 16 bits.
TILE_ROWS, TILE_COLUMNS, SHORT_SUMS = 32, 4096, 64


def entries_below(rough: np.ndarray, least: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries up to their row's ``limit``; ``least`` has the minima of every row's groups."""
    width = least.shape[1]
    rows, groups = np.nonzero(least <= limit[:, None])
    hit, at = np.nonzero(rough.reshape(len(rough), -1, width)[rows, :, groups] <= limit[rows, None])
    return rows[hit], at * width + groups[hit]


def kth_bound(rough: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """What at least ``k`` entries of each row do not exceed, and few others."""
    held = least if least.shape[1] >= 2 * k else rough
    return np.partition(held, k - 1, axis=1)[:, k - 1]


class Products:
    """Rough squared distances (less the query's own square) by products in single precision, and their largest error.

    Vectors are taken from the corpus's mean and scaled by a power of two, so offsets and units cost no digits.
    """

    def __init__(self, corpus: np.ndarray):
        self.mid, self.most = corpus.mean(axis=0), np.abs(corpus).max()
        rows = corpus - self.mid
        norms = np.einsum("nd,nd->n", rows, rows)
        self.top = norms.max()
        self.sound = bool(1e-200 < self.top < 1e200)
        self.scale = 2.0 ** -math.floor(math.log2(math.sqrt(self.top))) if self.sound else 1.0
        n, dims = rows.shape
        self.side = np.zeros((dims + 1, -(-n // GROUP) * GROUP), dtype=np.float32)
        self.side[dims] = np.inf
        if self.sound:
            self.side[:dims, :n], self.side[dims, :n] = (rows * self.scale).T, norms * self.scale**2
        self.step = max(1, min(256, (4 << 20) // self.side.shape[1]))
        self.out = np.empty((self.step, self.side.shape[1]), dtype=np.float32)  # one for all blocks: fresh pages cost as much as the product

    def rough(self, queries: np.ndarray) -> np.ndarray | None:
        rows = (queries - self.mid) * self.scale
        self.own = np.einsum("nd,nd->n", rows, rows)
        if not self.own.max() < 1e15:
            return None
        left = np.ones((len(rows), len(self.side)), dtype=np.float32)
        left[:, :-1] = -2 * rows
        return np.matmul(left, self.side, out=self.out[: len(left)])

    def limit(self, dist: np.ndarray) -> np.ndarray:
        """What the rough value of a row no farther than ``dist`` cannot exceed."""
        dims, top = len(self.mid), self.top * self.scale**2
        shift = 2.0**-50 * (self.most + np.abs(self.mid).max()) * self.scale + 2.0**-50 * np.sqrt(self.own)  # of a component, by taking the mean
        error = (dims + 8) * 2.0**-23 * (self.own + 2 * top) + 4 * math.sqrt(dims) * shift * (np.sqrt(self.own) + math.sqrt(top)) + dims * shift**2 + 1e-35
        return np.nextafter((dist * self.scale**2 - self.own + error).astype(np.float32), np.float32(np.inf))


class Gaps:
    """Rough sums of absolute differences, in steps of 16-bit codes.

    A code is off by half a step at most, and one that is cut off at the ends comes no farther from others by it, so the
    sum is at most one step for each component above the true one.
    """

    def __init__(self, corpus: np.ndarray):
        n, dims = corpus.shape
        self.mid, self.n = corpus.mean(axis=0), n
        gaps = np.abs(corpus - self.mid)
        reach = min(gaps.max(), 6 * math.sqrt((gaps * gaps).mean(axis=0).max()))
        self.sound = bool(1e-200 < reach < 1e200)
        self.half = min(16_383, 65_535 // (2 * min(dims, SHORT_SUMS)))
        self.unit, self.step = (reach / self.half if self.sound else 1.0), TILE_ROWS
        self.codes = np.zeros((dims, -(-n // GROUP) * GROUP), dtype=np.int16)
        self.codes[:, :n] = self.coded(corpus).T

    def coded(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((vectors - self.mid) / self.unit), -self.half, self.half).astype(np.int16)

    def rough(self, queries: np.ndarray) -> np.ndarray:
        own, (dims, width) = self.coded(queries), self.codes.shape
        sums = np.empty((len(own), width), dtype=np.uint16 if dims <= SHORT_SUMS else np.uint32)
        for at in range(0, width, TILE_COLUMNS):
            held = self.codes[:, at : at + TILE_COLUMNS]
            gap, short = np.empty((len(own), held.shape[1]), dtype=np.int16), np.empty((len(own), held.shape[1]), dtype=np.uint16)
            out = sums[:, at : at + TILE_COLUMNS]
            for lo in range(0, dims, SHORT_SUMS):
                part = out if dims <= SHORT_SUMS else short
                part[:] = 0
                for d in range(lo, min(lo + SHORT_SUMS, dims)):
                    np.subtract(own[:, d : d + 1], held[d], out=gap)
                    np.abs(gap, out=gap)
                    np.add(part, gap.view(np.uint16), out=part)
                if part is short:
                    np.add(out, short, out=out) if lo else np.copyto(out, short)
        sums[:, self.n :] = np.iinfo(sums.dtype).max
        return sums

    def limit(self, dist: np.ndarray) -> np.ndarray:
        return dist / self.unit * (1 + 1e-9) + len(self.codes) * (1 + 1e-9) + 1


def measured(corpus: np.ndarray, queries: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: float) -> np.ndarray:
    """Exact distances of pairs (row of queries, row of corpus), some at a time."""
    step = max(1, (2 << 20) // corpus.shape[1])
    return np.concatenate([power_sums(corpus[cols[at : at + step]] - queries[rows[at : at + step]], p) for at in range(0, max(1, len(rows)), step)])


class Chunk:
    """Corpus rows in a form that many queries can be compared with."""

    def __init__(self, corpus: np.ndarray, ids: np.ndarray, spec: Knn):
        self.corpus, self.ids, self.spec, self.rougher = corpus.astype(float, copy=False), ids, spec, None
        if spec.p in (1, 2) and len(ids) >= max(4 * spec.k, 4 * GROUP):
            self.rougher = Products(self.corpus) if spec.p == 2 else Gaps(self.corpus)
            if not self.rougher.sound:
                self.rougher = None

    def narrow(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Row of the query, row of the corpus and exact distance of all that may be among the ``k`` nearest; None where
        rough distances tell too little."""
        k, n = self.spec.k, len(self.ids)
        rough = self.rougher.rough(block)
        if rough is None:
            return None
        least = rough.reshape(len(rough), GROUP, -1).min(axis=1)
        rows, cols = entries_below(rough, least, kth_bound(rough, least, k))
        if len(rows) > len(block) * (8 * k + n // 32):
            return None
        rows, cols = rows[cols < n], cols[cols < n]
        dist = measured(self.corpus, block, rows, cols, self.spec.p)
        best = best_of_rows(rows, self.ids[cols], dist, k)
        rows, cols = entries_below(rough, least, self.rougher.limit(dist[best].reshape(len(block), k)[:, -1]))
        if len(rows) > len(block) * (8 * k + n // 32):
            return None
        rows, cols = rows[cols < n], cols[cols < n]
        return rows, cols, measured(self.corpus, block, rows, cols, self.spec.p)

    def plain(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`narrow`, in double precision throughout."""
        k, n = self.spec.k, len(self.ids)
        if self.spec.p == 2 and n > 4 * k:
            norms = np.einsum("nd,nd->n", self.corpus, self.corpus)
            rough = norms[None, :] - 2 * block @ self.corpus.T
            slack = 1e-10 * (norms.max() + np.einsum("nd,nd->n", block, block))
            rows, cols = np.nonzero(rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None])
            return rows, cols, measured(self.corpus, block, rows, cols, 2)
        rough = power_sums(self.corpus[None, :, :] - block[:, None, :], self.spec.p)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(block), np.inf)
        rows, cols = np.nonzero(rough <= limit[:, None])
        return rows, cols, rough[rows, cols]

    def compare(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, neighbour id and exact distance of the ``k`` nearest for every query."""
        spec, n = self.spec, len(self.ids)
        wide = 1 if spec.p == 2 and n > 4 * spec.k else self.corpus.shape[1]
        slow = max(1, min(256, (4 << 20) // max(1, n * wide)))  # below 32 MB
        step = self.rougher.step if self.rougher else slow
        found = []
        for at in range(0, len(queries), step):
            block = queries[at : at + step]
            got = [(0, self.narrow(block))] if self.rougher else [(0, None)]
            if got[0][1] is None:
                got = [(lo, self.plain(block[lo : lo + slow])) for lo in range(0, len(block), slow)]
            for lo, (rows, cols, dist) in got:
                best = best_of_rows(rows, self.ids[cols], dist, spec.k)
                found.append((rows[best] + at + lo, self.ids[cols[best]], dist[best]))
        rows, near, dist = (np.concatenate(x) for x in zip(*found, strict=True))
        return rows, near, dist ** (1 / spec.p) if spec.root and not math.isinf(spec.p) else dist


def compare(corpus: np.ndarray, ids: np.ndarray, queries: np.ndarray, spec: Knn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, neighbour id and exact distance of the ``k`` nearest for every query.

    Blocks of queries at a time.  For p = 2 products in single precision and for p = 1 sums of 16-bit codes find who may
    be among the ``k`` nearest, within their error; those alone are measured by differences.
    """
    return Chunk(corpus, ids, spec).compare(queries)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Consecutive rows of one (chunk, side): ``(cell, chunk), side, rows``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(int(x) for x in keys[:3, lo]), int(keys[3, lo]), batch.slice(lo, hi - lo)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


FOUND = "cell int, i long, j long, dist double"


def _neighbours(cell: int, ids: np.ndarray, near: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell, dtype=np.int32)), pa.array(ids), pa.array(near), pa.array(dist)], names=["cell", "i", "j", "dist"])


def _search_batches(batches: Iterator[pa.RecordBatch], spec: Knn) -> Iterator[pa.RecordBatch]:
    now, held, chunk = None, [], None
    for key, side, rows in runs_of(batches):
        if key != now:
            now, held, chunk = key, [], None
        if side == 0:
            held.append(rows)
            continue
        if not held:
            continue
        if chunk is None:
            chunk = Chunk(np.concatenate([matrix(x.column(5)) for x in held]), np.concatenate([x.column(4).to_numpy() for x in held]), spec)
            held = held[:1]
        for at in range(0, rows.num_rows, 1024):
            part = rows.slice(at, 1024)
            found, near, dist = chunk.compare(matrix(part.column(5)))
            yield _neighbours(key[1], part.column(4).to_numpy()[found], near, dist)


def stream(corpus: DataFrame, queries: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ``(dim, cell, chunk, side, id, vec)`` with each chunk's corpus before its queries; with ``parts`` chunks are
    dealt in turn to so many partitions."""
    columns = ["dim", "cell", "chunk", "side", "id", "vec"]
    sides = [df.select(F.size("vec").alias("dim"), "cell", "chunk", F.lit(k).alias("side"), "id", "vec") for k, df in enumerate((corpus, queries))]
    both = sides[0].unionByName(sides[1])
    dealt = both.repartition(parts, in_turn(corpus.sparkSession, F.col("chunk"), parts)) if parts else both.repartition(*columns[:3])
    return dealt.sortWithinPartitions(*columns[:4])


def in_turn(spark: SparkSession, number: Column, parts: int) -> Column:
    """A key whose hash deals rows of a ``number`` to partition ``number % parts``, each to its own.

    Numbers themselves collide: of 16 as many hashed to 16 partitions three meet in one and four stay empty.  Where
    partitions are many (beyond 4,096) that evens out, and they are taken as they are.
    """
    if parts > 4096:
        return number
    keys: dict[int, int] = {}
    for lo in itertools.count(0, 16 * parts):
        found = spark.range(lo, lo + 16 * parts).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
        keys = {r["at"]: r["id"] for r in found.collect()} | keys
        if len(keys) == parts:
            break
    return F.element_at(F.array(*[F.lit(keys[k]).cast("int") for k in range(parts)]), (F.pmod(number, F.lit(parts)) + 1).cast("int"))


def merged(found: DataFrame, k: int, by: Sequence[str] = ("i",)) -> DataFrame:
    """The ``k`` nearest of what the chunks found, ranked by distance and then id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("dist", "j"))
    return found.withColumn("rk", rank).where(F.col("rk") <= k).select(*by, "rk", "j", "dist")


def knn_exact(x: DataFrame, spec: Knn, y: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int | None = None) -> DataFrame:
    """The exact ``k`` nearest rows of ``y`` (default: of ``x`` itself) for every row of ``x``.

    Rows without an id and vectors that are null, empty or hold null or non-finite values take no
    part; vectors of different lengths are never neighbours; rows of ``y`` that repeat are neighbours
    each; rows of ``x`` that repeat share one result.  With fewer than ``k`` rows all are returned.

    A chunk holds ``chunk_rows`` rows (None: :data:`CHUNK_BYTES` of vectors).  What is shuffled is the
    queries once per chunk and the corpus once per block of queries.
    """
    asked = vectors_of(x, spec, id_col, vector_col)
    corpus = asked if y is None else vectors_of(y, spec, id_col, vector_col)
    rows, dims = (x if y is None else y).agg(F.count("*"), F.max(F.size(vector_col))).first()
    cell = F.lit(0).alias("cell")
    tiles = _tiles(corpus.select("id", "vec", cell), asked.dropDuplicates(["id"]).select("id", "vec", cell), rows, rows if y is None else x.count(), dims, chunk_rows)
    return merged(tiles.mapInArrow(lambda b: _search_batches(b, spec), FOUND), spec.k)


def knn_by_cell(x: DataFrame, y: DataFrame, cells: int, spec: Knn, id_col: str = "vec_id", vector_col: str = "embedding", cell_col: str = "cell") -> DataFrame:
    """``cell, i, rk, j, dist``: as :func:`knn_exact`, in each of the ``cells`` sets of rows of ``y`` (numbered
    from 0 in ``cell_col``) by itself; one search serves them all."""
    corpus = y.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)) & F.col(cell_col).isNotNull())
    vec = normalised(F.col(vector_col), spec.p) if spec.normalize else doubles(F.col(vector_col))
    corpus = corpus.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.col(cell_col).cast("int").alias("cell"))
    asked = vectors_of(x, spec, id_col, vector_col).dropDuplicates(["id"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    rows, dims = y.agg(F.count("*"), F.max(F.size(vector_col))).first()
    tiles = _tiles(corpus, asked, rows, x.count(), dims, None)
    return merged(tiles.mapInArrow(lambda b: _search_batches(b, spec), FOUND), spec.k, ["cell", "i"])


def _tiles(corpus: DataFrame, asked: DataFrame, rows: int, queries: int, dims: int | None, chunk_rows: int | None) -> DataFrame:
    """The stream of all tiles of a cell: ``asked`` in blocks against ``corpus`` in chunks."""
    spark = corpus.sparkSession
    chunks = max(1, -(-rows // (chunk_rows or max(1, CHUNK_BYTES // (8 * max(1, dims or 1))))))
    each = 4 if rows * queries >> 32 else 2  # tiles a core
    blocks = max(-(-queries // BLOCK_ROWS), -(-each * spark.sparkContext.defaultParallelism // chunks))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = (F.col("block") * chunks + F.col("part")).alias("chunk")
    corpus = corpus.select("id", "vec", "cell", F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)).cast("int").alias("part"), all_of(blocks).alias("block"))
    asked = asked.select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), all_of(chunks).alias("part"))
    parts = min(blocks * chunks, 1 << 16)
    parts = parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) or chunks > 1 else None
    return stream(corpus.select("id", "vec", "cell", tile), asked.select("id", "vec", "cell", tile), parts)


@dataclass(frozen=True)
class InvertedFile:
    """Cells of an inverted file: the ``centres`` of a k-means fitted on at most ``sample`` rows, or given ones."""

    centres: np.ndarray
    spec: Knn

    @staticmethod
    def fit(x: DataFrame, spec: Knn, nlist: int = 100, sample: int = 100_000, seed: int = 47, id_col: str = "vec_id", vector_col: str = "embedding") -> InvertedFile:
        rows = vectors_of(x, spec, id_col, vector_col).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
        return InvertedFile(np.array(KMeans(k=nlist, seed=seed, maxIter=10).fit(rows.select(array_to_vector("vec").alias("features"))).clusterCenters()), spec)

    @staticmethod
    def of_rows(x: DataFrame, spec: Knn, nlist: int, id_col: str = "vec_id", vector_col: str = "embedding") -> InvertedFile:
        """Centres that are rows of the table: the ``nlist`` of them that :func:`sample_rows` gives, by id."""
        rows = sample_rows(vectors_of(x, spec, id_col, vector_col), nlist, "id").orderBy("id")
        return InvertedFile(np.array([r["vec"] for r in rows.collect()]), spec)

    def probe(self, rows: DataFrame, nprobe: int) -> DataFrame:
        """Rows ``(id, vec, cell)``, once for each of their ``nprobe`` nearest cells."""
        centres = self.centres
        near = rows.select("id", "vec").mapInArrow(lambda b: _probe_batches(b, centres, nprobe), "id long, vec array<double>, cells array<int>")
        return near.select("id", "vec", F.explode("cells").alias("cell"))


def _probe_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray, nprobe: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = matrix(batch.column(1))
        far = (centres * centres).sum(axis=1)[None, :] - 2 * vectors @ centres.T
        cells = np.argsort(far, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
        lists = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(lists), pa.array(cells.ravel()))], names=["id", "vec", "cells"])


def _in_cells(x: DataFrame, y: DataFrame | None, file: InvertedFile, nprobe: int, id_col: str, vector_col: str, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Corpus rows with (cell, chunk), and query rows once per chunk of the cells they probe."""
    asked = vectors_of(x, file.spec, id_col, vector_col)
    corpus = materialise(file.probe(asked if y is None else vectors_of(y, file.spec, id_col, vector_col), 1), "cells")
    sizes = F.broadcast(corpus.groupBy("cell").count().select("cell", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")))  # one row per centre
    corpus = corpus.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int"))
    probing = file.probe(asked.dropDuplicates(["id"]), nprobe).join(sizes, "cell")
    return corpus, probing.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def knn_ivf(x: DataFrame, file: InvertedFile, nprobe: int = 1, y: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Neighbours within the ``nprobe`` nearest cells; all cells give the exact result.

    A query whose cells hold fewer than ``k`` rows gets a shorter list.  Rows are used as in
    :func:`knn_exact`; the model's vectors must all have one length.
    """
    corpus, asked = _in_cells(x, y, file, nprobe, id_col, vector_col, chunk_rows)
    spec = file.spec
    return merged(stream(corpus, asked).mapInArrow(lambda b: _search_batches(b, spec), FOUND), spec.k)


@dataclass(frozen=True)
class Codebooks:
    """``2 ** bits`` centres for each sub-vector of the residuals, learned on at most ``sample`` rows."""

    books: np.ndarray  # (sub-vectors, centres, width)

    @staticmethod
    def fit(x: DataFrame, file: InvertedFile, bits: int = 8, width: int = 8, sample: int = 20_000, rounds: int = 8, seed: int = 47, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
        """All books in one job: each sub-vector's sample is a group of at most ``sample`` rows.  The last book may be
        narrower; a book of fewer different rows than centres repeats its last one."""
        rows = vectors_of(x, file.spec, id_col, vector_col).orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(sample)
        centres, count = file.centres, 1 << bits
        dims = centres.shape[1]
        rest = file.probe(rows, 1).mapInArrow(lambda b: _residual_batches(b, centres), "rest array<double>")
        parts = F.explode(F.array(*[F.struct(F.lit(k).alias("book"), F.slice("rest", at + 1, width).alias("part")) for k, at in enumerate(range(0, dims, width))]))
        learned = rest.select(parts.alias("x")).select("x.*").groupBy("book").applyInArrow(lambda t: _learn_book(t, count, rounds), "book int, centres array<double>")
        books = {r["book"]: np.array(r["centres"]).reshape(count, -1) for r in learned.collect()}  # one row for each book
        return Codebooks(np.array([np.pad(books[k], ((0, 0), (0, width - books[k].shape[1]))) for k in sorted(books)]))

    def parts(self, rest: np.ndarray) -> np.ndarray:
        """Sub-vectors of residuals, first by sub-vector; the last is padded with zeros."""
        count, _, width = self.books.shape
        return np.pad(rest, ((0, 0), (0, count * width - rest.shape[1]))).reshape(len(rest), count, width).transpose(1, 0, 2)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distance of each sub-vector of each residual to every centre of its book."""
        parts = self.parts(rest)
        return (parts**2).sum(axis=2)[:, :, None] - 2 * parts @ self.books.transpose(0, 2, 1) + (self.books**2).sum(axis=2)[:, None, :]

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return self.tables(rest).argmin(axis=2).T


def _learn_book(table: pa.Table, count: int, rounds: int) -> pa.Table:
    """``count`` centres of a sub-vector's sample by k-means, from evenly spaced rows in the order of their values."""
    rows = np.unique(matrix(table.column("part").combine_chunks()), axis=0)
    centres = rows[np.minimum(np.arange(count) * max(len(rows), count) // count, len(rows) - 1)]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        sizes = np.bincount(own, minlength=count)
        sums = np.stack([np.bincount(own, weights=column, minlength=count) for column in rows.T], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return pa.table({"book": pa.array(table.column("book").to_numpy()[:1]), "centres": pa.array([centres.ravel()], type=pa.list_(pa.float64()))})


def _residual_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rest = matrix(batch.column(1)) - centres[batch.column(2).to_numpy()]
            lists = np.arange(len(rest) + 1, dtype=np.int32) * rest.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(lists), pa.array(rest.ravel()))], names=["rest"])


#: Rows of a chunk of codes: a byte a sub-vector instead of eight a dimension.
CODE_ROWS = 1 << 17


def _encode_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray, books: Codebooks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes = books.encode(matrix(batch.column(1)) - centres[batch.column(2).to_numpy()])
            wide = codes.astype(np.uint8 if books.books.shape[1] <= 256 else np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([row.tobytes() for row in wide], type=pa.binary())], names=["id", "cell", "code"])


def coded_table(y: DataFrame, file: InvertedFile, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, cell, code``, written once: the index that :func:`knn_ivfpq` searches, one byte for each sub-vector
    (two beyond 256 centres a book).  Vectors are used as in :func:`knn_exact`."""
    rows = file.probe(vectors_of(y, file.spec, id_col, vector_col), 1)
    centres = file.centres
    return materialise(rows.mapInArrow(lambda b: _encode_batches(b, centres, books), "id long, cell int, code binary"), "codes")


#: Queries of a block, whose best rows so far a task of the coded search holds.
CODED_QUERIES = 16_384


def _packed_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a cell in one row for each batch: few rows are what every block of queries is sent."""
    for batch in batches:
        cells, ids, codes = batch.column(1).to_numpy(), batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), dtype=object)
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            yield pa.RecordBatch.from_arrays([pa.array([cell], type=pa.int32()), pa.array([ids[own].tobytes()], type=pa.binary()), pa.array([b"".join(codes[own])], type=pa.binary())], names=["cell", "ids", "codes"])


class CodedBlock:
    """Queries ``id, vec, cells`` and the ``most`` rows of the cells they probe with the least coded distances so far."""

    def __init__(self, rows: pa.Table, centres: np.ndarray, books: Codebooks, most: int):
        self.ids, self.vec, self.centres, self.books = rows.column("id").to_numpy(), rows.column("vec").combine_chunks(), centres, books
        self.queries, self.cells = matrix(self.vec).astype(np.float32).astype(float), matrix(rows.column("cells").combine_chunks())
        self.near, self.dist = np.zeros((len(self.ids), most), dtype=np.int64), np.full((len(self.ids), most), np.inf)

    def see(self, cell: int, ids: np.ndarray, codes: np.ndarray) -> None:
        asking = np.flatnonzero((self.cells == cell).any(axis=1))
        if not len(asking):
            return
        count, most = self.books.books.shape[0], self.dist.shape[1]
        coded = np.concatenate([self.books.books[m, codes[:, m]] for m in range(count)], axis=1)[:, : self.centres.shape[1]]
        held = Products(coded)
        for at in range(0, len(asking), held.step):
            own = asking[at : at + held.step]
            rest = self.queries[own] - self.centres[cell]
            tables = self.books.tables(rest)
            told = lambda r, c: sum(tables[m][r, codes[c, m]] for m in range(count))  # noqa: E731, B023
            rough = held.rough(rest) if held.sound and len(ids) > 2 * most else None
            if rough is None:
                rows, cols = np.indices((len(own), len(ids))).reshape(2, -1)
            else:
                least = rough.reshape(len(rough), GROUP, -1).min(axis=1)
                rows, cols = entries_below(rough, least, kth_bound(rough, least, most))
                rows, cols = rows[cols < len(ids)], cols[cols < len(ids)]
                best = best_of_rows(rows, ids[cols], told(rows, cols), most)
                kth = told(rows[best], cols[best]).reshape(len(own), most)[:, -1]
                rows, cols = entries_below(rough, least, held.limit(np.minimum(kth, self.dist[own, -1])))
                rows, cols = rows[cols < len(ids)], cols[cols < len(ids)]
            rows, near, dist = (np.concatenate(x) for x in ((np.repeat(np.arange(len(own)), most), rows), (self.near[own].ravel(), ids[cols]), (self.dist[own].ravel(), told(rows, cols))))
            best = best_of_rows(rows, near, dist, most)
            self.near[own], self.dist[own] = near[best].reshape(len(own), most), dist[best].reshape(len(own), most)

    def found(self, chunks: int) -> Iterator[pa.RecordBatch]:
        """``id, vec, chunk, js, dists``: a row for each query and chunk of vectors that its rows ``js`` lie in."""
        for at in range(0, len(self.ids), 1024):
            near, dist = self.near[at : at + 1024], self.dist[at : at + 1024]
            rows = np.nonzero(dist < np.inf)[0]
            near, dist = near[dist < np.inf], dist[dist < np.inf]
            part = dealt(near, chunks)
            order = np.lexsort((part, rows))
            rows, part, near, dist = rows[order], part[order], near[order], dist[order]
            cuts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (part[1:] != part[:-1]), [True]])) if len(rows) else np.zeros(1, dtype=int)
            heads, lists = cuts[:-1], pa.array(cuts.astype(np.int32))
            js, dists = (pa.ListArray.from_arrays(lists, pa.array(x)) for x in (near, dist))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[at + rows[heads]]), self.vec.take(pa.array(at + rows[heads])), pa.array(part[heads].astype(np.int32)), js, dists], names=["id", "vec", "chunk", "js", "dists"])


def dealt(ids: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of vectors of every id, whatever steps ids go in."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(chunks)


def _coded_blocks(batches: Iterator[pa.RecordBatch], centres: np.ndarray, books: Codebooks, most: int, chunk_rows: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """Rows ``block, side, cell, id, vec, cells, ids, codes`` in that order: a block's queries, then all codes cell by cell."""
    width = np.uint8 if books.books.shape[1] <= 256 else np.uint16
    now, asked, block, held, cell, rows = None, [], None, [], None, 0

    def see() -> None:
        if held:
            ids, codes = (b"".join(x) for x in zip(*held, strict=True))
            block.see(cell, np.frombuffer(ids, dtype=np.int64), np.frombuffer(codes, dtype=width).reshape(len(ids) // 8, -1))

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(2)]) if batch.num_rows else np.zeros((2, 0))
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]])) if batch.num_rows else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            some = batch.slice(lo, hi - lo)
            if keys[0, lo] != now:
                see()
                if block is not None:
                    yield from block.found(chunks)
                now, asked, block, held, rows = keys[0, lo], [], None, [], 0
            if keys[1, lo] == 0:
                asked.append(some.select(["id", "vec", "cells"]))
                continue
            if not asked:
                continue
            if block is None:
                block = CodedBlock(pa.Table.from_batches(asked), centres, books, most)
            for k in range(some.num_rows):
                if held and (some.column(2)[k].as_py() != cell or rows >= chunk_rows):
                    see()
                    held, rows = [], 0
                cell = some.column(2)[k].as_py()
                held.append((some.column(6)[k].as_py(), some.column(7)[k].as_py()))
                rows += len(held[-1][0]) // 8
    see()
    if block is not None:
        yield from block.found(chunks)


def _dealt_batches(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dealt(batch.column(0).to_numpy(), chunks).astype(np.int32))], names=["id", "vec", "chunk"])


def _measured_batches(batches: Iterator[pa.RecordBatch], spec: Knn) -> Iterator[pa.RecordBatch]:
    """Exact distances of queries ``id, vec, js`` to the rows ``js`` of a chunk, the ``k`` nearest of them."""
    now, held, vectors, ids = None, [], None, None
    for key, side, rows in runs_of(batches):
        if key != now:
            now, held, vectors = key, [], None
        if side == 0:
            held.append(rows)
            continue
        if not held:
            continue
        if vectors is None:
            ids = np.concatenate([x.column(4).to_numpy() for x in held])
            order = np.argsort(ids, kind="stable")
            ids, vectors, held = ids[order], np.concatenate([matrix(x.column(5)) for x in held])[order], held[:1]
        own, asked, lists = rows.column(4).to_numpy(), matrix(rows.column(5)), rows.column(6)
        near, asking = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        asking, at = asking[ids[at] == near], at[ids[at] == near]
        dist = measured(vectors, asked, asking, at, 2)
        best = best_of_rows(asking, ids[at], dist, spec.k)
        yield _neighbours(0, own[asking[best]], ids[at[best]], np.sqrt(dist[best]) if spec.root else dist[best])


def knn_ivfpq(x: DataFrame, file: InvertedFile, books: Codebooks, nprobe: int = 1, y: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CODE_ROWS, rerank: int = 8, codes: DataFrame | None = None) -> DataFrame:
    """Neighbours by product-quantised distances within the ``nprobe`` nearest cells, ordered anew.

    The corpus takes part as the stored ``codes`` of :func:`coded_table` (None: made here).  They are packed and sent to
    every block of queries, whose task goes through them cell by cell, ``chunk_rows`` at a time, and keeps the
    ``rerank * k`` best rows of each query, so they are never shuffled.  Those are measured with their vectors in tiles, a
    block of queries against a chunk of vectors; the distances that order and leave them are exact.  ``rerank=0`` leaves the
    coded distances and fetches nothing.
    Distances are Euclidean, whatever ``p``.  Otherwise as :func:`knn_ivf`; ids of ``y`` should be unique.
    """
    spec, centres, spark = file.spec, file.centres, x.sparkSession
    corpus = coded_table(x if y is None else y, file, books, id_col, vector_col) if codes is None else codes
    vectors, most, cores = vectors_of(x, spec, id_col, vector_col), max(rerank, 1) * spec.k, spark.sparkContext.defaultParallelism
    asked = vectors.dropDuplicates(["id"]).mapInArrow(lambda b: _probe_batches(b, centres, nprobe), "id long, vec array<double>, cells array<int>")
    queries = x.count()
    rows = queries if y is None else y.count()
    blocks = max(1, -(-queries // CODED_QUERIES), min(4 * cores, -(-queries // 512)))
    chunks = max(1, -(-rows * centres.shape[1] * 8 // (2 * CHUNK_BYTES)))
    none, every = F.lit(None), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = corpus.select("id", "cell", "code").mapInArrow(_packed_codes, "cell int, ids binary, codes binary")
    sides = [
        asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), F.lit(-1).alias("cell"), "id", "vec", "cells", none.cast("binary").alias("ids"), none.cast("binary").alias("codes")),
        packed.select(every(blocks).alias("block"), F.lit(1).alias("side"), "cell", none.cast("long").alias("id"), none.cast("array<double>").alias("vec"), none.cast("array<int>").alias("cells"), "ids", "codes"),
    ]
    parts = min(blocks, 1 << 16)
    tiles = sides[0].unionByName(sides[1]).repartition(parts, in_turn(spark, F.col("block"), parts)).sortWithinPartitions("block", "side", "cell")
    schema = "id long, vec array<double>, chunk int, js array<long>, dists array<double>"
    best = tiles.mapInArrow(lambda b: _coded_blocks(b, centres, books, most, chunk_rows, chunks), schema)
    if not rerank:
        pairs = best.select(F.col("id").alias("i"), F.explode(F.arrays_zip("js", "dists")).alias("x")).select("i", F.col("x.js").alias("j"), F.col("x.dists").alias("dist"))
        return merged(pairs.withColumn("dist", F.sqrt(F.greatest("dist", F.lit(0.0)))) if spec.root else pairs, spec.k)
    near = (vectors if y is None else vectors_of(y, spec, id_col, vector_col)).mapInArrow(lambda b: _dealt_batches(b, chunks), "id long, vec array<double>, chunk int")
    blocks = max(-(-queries // BLOCK_ROWS), -(-4 * cores // chunks))
    tile, dim, cell = (F.col("chunk") * blocks + F.col("block")).alias("chunk"), F.lit(centres.shape[1]).alias("dim"), F.lit(0).alias("cell")
    sides = [
        near.select("id", "vec", "chunk", every(blocks).alias("block")).select(dim, cell, tile, F.lit(0).alias("side"), "id", "vec", none.cast("array<long>").alias("js")),
        best.select("id", "vec", "chunk", "js", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).select(dim, cell, tile, F.lit(1).alias("side"), "id", "vec", "js"),
    ]
    parts = min(blocks * chunks, 1 << 16)
    tiles = sides[0].unionByName(sides[1]).repartition(parts, in_turn(spark, F.col("chunk"), parts)).sortWithinPartitions("dim", "cell", "chunk", "side")
    return merged(tiles.mapInArrow(lambda b: _measured_batches(b, spec), FOUND), spec.k)


# --- the pruned search --------------------------------------------------------------------------

#: Bits of a tile's number for the part of a ring and for the block of queries.
PART_BITS, BLOCK_BITS = 20, 12


@dataclass(frozen=True)
class Pivots:
    """Points that corpus rows gather around.  They are rows of the table; any choice gives the exact result."""

    points: np.ndarray
    spec: Knn

    @staticmethod
    def fit(y: DataFrame, spec: Knn, count: int = 64, sample: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Pivots:
        """``count`` of at most ``sample`` rows, each the one farthest from those before it."""
        rows = vectors_of(y, spec, id_col, vector_col)
        held = sample_rows(rows, sample, "id").collect()
        dims = max((len(r["vec"]) for r in held), default=0)
        points = np.array([r["vec"] for r in held if len(r["vec"]) == dims], dtype=float)
        picked, nearest = [0], np.full(len(points), np.inf)
        while len(picked) < min(count, len(points)):
            nearest = np.minimum(nearest, power_sums(points - points[picked[-1]], spec.p))
            picked.append(int(nearest.argmax()))
        return Pivots(points[picked] if len(points) else points, spec)

    def far(self, vectors: np.ndarray) -> np.ndarray:
        """Distances (rooted) of vectors to all pivots."""
        sums = np.stack([power_sums(vectors - pivot, self.spec.p) for pivot in self.points], axis=1)
        return sums if math.isinf(self.spec.p) else sums ** (1 / self.spec.p)


def _pivot_batches(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            far = pivots.far(matrix(some.column(1)))
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=["id", "vec", "cell", "far"])


def _reach_batches(batches: Iterator[pa.RecordBatch], pivots: Pivots, least: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each query ``id, vec, reach`` the cells that can hold a row no farther than ``reach``, and its distances to their pivots."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            far, reach = pivots.far(matrix(some.column(1))), some.column(2).to_numpy()[:, None]
            bound = np.maximum(np.maximum(far - most, least - far), (far - far.min(axis=1, keepdims=True)) / 2)
            rows, cells = np.nonzero(bound <= reach + 1e-9 * far)
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), some.column(2).take(pa.array(rows)), pa.array(cells.astype(np.int32)), pa.array(far[rows, cells])], names=["id", "reach", "cell", "far"])


def pruned_tiles(x: DataFrame, pivots: Pivots, y: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``corpus(id, vec, cell, chunk)``, ``asked(id, vec)`` and ``tiles(id, cell, chunk)``: whom each query has to
    be compared with to have its exact neighbours."""
    spec = pivots.spec
    dims = pivots.points.shape[1]
    usable_ones = lambda df: vectors_of(df, spec, id_col, vector_col).where(F.size("vec") == dims)
    near = lambda df: df.mapInArrow(lambda b: _pivot_batches(b, pivots), "id long, vec array<double>, cell int, far double")
    corpus = materialise(near(usable_ones(x if y is None else y)), "rows-by-pivot")
    asked = materialise(near(usable_ones(x).dropDuplicates(["id"])), "queries-by-pivot")
    cells = corpus.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most"))
    ends = cells.collect()  # a row for each pivot
    rings = F.broadcast(cells.select("cell", F.ceil(F.col("n") / chunk_rows).alias("rings"), "least", ((F.col("most") - F.col("least")) / F.ceil(F.col("n") / chunk_rows)).alias("width")))
    ring = lambda far: F.least(F.greatest(F.floor(F.when(F.col("width") > 0, (far - F.col("least")) / F.col("width")).otherwise(0)), F.lit(0)), F.col("rings") - 1)
    corpus = corpus.join(rings, "cell").withColumn("ring", ring(F.col("far"))).select("id", "vec", "cell", "far", "ring")
    sizes = corpus.groupBy("cell", "ring").agg(F.ceil(F.count("*") / chunk_rows).alias("parts"), F.min("far").alias("inner"), F.max("far").alias("outer"))
    sizes = materialise(sizes, "rings")
    chunk = lambda part: F.shiftleft(F.shiftleft("ring", PART_BITS) + part, BLOCK_BITS).alias("chunk")
    corpus = corpus.join(sizes, ["cell", "ring"]).select("id", "vec", "cell", chunk(F.pmod(F.xxhash64("id", "vec"), F.col("parts"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    # a query's own ring first: the nearest ring of its nearest cell that has rows
    gap = F.greatest(F.col("inner") - F.col("far"), F.col("far") - F.col("outer"), F.lit(0.0))
    own = asked.select("id", "far", "cell").join(sizes, "cell").groupBy("id", "cell").agg(F.min_by(F.struct("ring", "parts"), F.struct(gap, "ring")).alias("r"))
    first = materialise(own.select("id", "cell", F.col("r.ring").alias("ring"), F.col("r.parts").alias("parts")).select("id", "cell", chunk(F.pmod(F.xxhash64("id"), F.col("parts")))), "own-tiles")
    reach = F.col("dist") if spec.root or math.isinf(spec.p) else F.pow("dist", F.lit(1 / spec.p))
    kth = _searched(corpus, asked, first, spec).where(F.col("rk") == spec.k).select(F.col("i").alias("id"), (reach * (1 + 1e-9) + 1e-12).alias("reach"))
    least, most = (np.full(len(pivots.points), fill) for fill in (np.inf, -np.inf))
    for r in ends:
        least[r["cell"]], most[r["cell"]] = r["least"] * (1 - 1e-9) - 1e-12, r["most"] * (1 + 1e-9) + 1e-12
    within = asked.select("id", "vec").join(kth, "id", "left").select("id", "vec", F.coalesce("reach", F.lit(math.inf)).alias("reach"))
    reached = within.mapInArrow(lambda b: _reach_batches(b, pivots, least, most), "id long, reach double, cell int, far double").join(sizes, "cell")
    slack = F.lit(1e-9) * (F.col("far") + F.col("outer")) + 1e-12
    tiles = reached.where(F.greatest(F.col("inner") - F.col("far"), F.col("far") - F.col("outer")) <= F.col("reach") + slack).select("id", "cell", "ring", every).select("id", "cell", chunk(F.col("part")))
    return corpus, asked.select("id", "vec"), materialise(tiles, "tiles")


def _searched(corpus: DataFrame, asked: DataFrame, tiles: DataFrame, spec: Knn) -> DataFrame:
    """Neighbours of the queries in the tiles given; a chunk that many ask is compared in several blocks."""
    blocks = F.least(F.ceil(F.col("count") / BLOCK_ROWS), F.lit(1 << BLOCK_BITS)).alias("blocks")
    asking = tiles.groupBy("cell", "chunk").count().select("cell", "chunk", blocks)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    held = corpus.join(asking, ["cell", "chunk"]).select("id", "vec", "cell", "chunk", each).select("id", "vec", "cell", (F.col("chunk") + F.col("block")).alias("chunk"))
    sent = tiles.join(asking, ["cell", "chunk"]).select("id", "cell", (F.col("chunk") + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("chunk"))
    sent = asked.select("id", "vec").join(sent, "id").select("id", "vec", "cell", "chunk")
    return merged(stream(held, sent).mapInArrow(lambda b: _search_batches(b, spec), FOUND), spec.k)


def knn_pruned(x: DataFrame, pivots: Pivots, y: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As :func:`knn_exact`, with the same result, comparing a query only with what the triangle inequality
    cannot rule out.

    For every p from 1 on (below it there is no triangle inequality: ``ValueError``).  Corpus rows belong to their
    nearest pivot and to a ring around it.  A query searches its own ring first; its k-th distance there is
    its reach.  A ring lies beyond it if the query's distance to the pivot differs from the ring's by more, and a
    cell also if its pivot is farther than the query's own by more than twice that.  Queries whose own ring holds
    fewer than ``k`` rows search everything.  All vectors must have the length of the pivots; others take no part.
    """
    if pivots.spec.p < 1:
        raise ValueError("rows can be ruled out for p of 1 or more only")
    if not len(pivots.points):
        return knn_exact(x, pivots.spec, y, id_col, vector_col)
    corpus, asked, tiles = pruned_tiles(x, pivots, y, id_col, vector_col, chunk_rows)
    return _searched(corpus, asked, tiles, pivots.spec)


def packed(knn: DataFrame) -> DataFrame:
    """One row per point: ``i`` and its neighbours in order as ``array<struct<j, dist>>``."""
    inner = F.array_sort(F.collect_list(F.struct("rk", "j", "dist")))
    return knn.groupBy("i").agg(F.transform(inner, lambda s: F.struct(s["j"].alias("j"), s["dist"].alias("dist"))).alias("neighbours"))

