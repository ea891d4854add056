"""Fewer dimensions: identity, random projection and principal components."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.functions.vectors import doubles, usable


class Reducer(ABC):
    """Fits on a table of vectors and returns tables with the column ``reduced``."""

    def __init__(self, vector_col: str = "embedding") -> None:
        self.vector_col = vector_col

    def fit(self, x: DataFrame) -> Reducer:
        return self

    @abstractmethod
    def transform(self, x: DataFrame) -> DataFrame: ...

    def fit_transform(self, x: DataFrame) -> DataFrame:
        return self.fit(x).transform(x)


class NoReduce(Reducer):
    """The vectors as they are."""

    def transform(self, x: DataFrame) -> DataFrame:
        return x.withColumn("reduced", doubles(F.col(self.vector_col)))


def projection_entry(row: int, col: int, n: int, seed: int = 47) -> float:
    """Entry of the projection matrix: a normal deviate of standard deviation 1/n.

    Two uniforms are the first 52 bits of the MD5 of the seed, the entry's place and a letter, so the matrix
    is the same in every process and any language can work it out.
    """
    u, v = (int(hashlib.md5(f"{seed} {row * n + col} {x}".encode()).hexdigest()[:13], 16) / 2**52 for x in "uv")
    return math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * v) / n


def project(column: pa.ListArray, matrices: dict[int, np.ndarray], n: int) -> pa.Array:
    """Every vector of a column times the matrix of its length, one product for each length; null for
    vectors that are null, empty or hold nulls."""
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values, gaps = pc.fill_null(flat, 0).to_numpy().astype(float), flat.is_null().to_numpy(zero_copy_only=False)
    starts, out, good = np.cumsum(sizes) - sizes, np.zeros((len(sizes), n)), np.zeros(len(sizes), dtype=bool)
    for size, matrix in matrices.items():
        rows = np.flatnonzero(sizes == size)
        cells = starts[rows][:, None] + np.arange(size)
        out[rows], good[rows] = values[cells] @ matrix, ~gaps[cells].any(axis=1)
    bounds = np.concatenate([[0], np.cumsum(good) * n]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(out[good].ravel()), mask=pa.array(~good))


class RandomProjector(Reducer):
    """Projection on ``n_components`` random directions; null for a vector that cannot be used.

    Deviates have standard deviation 1/n.  The matrix has one row per input dimension and travels
    with the plan.
    """

    def __init__(self, n_components: int, vector_col: str = "embedding", seed: int = 47) -> None:
        super().__init__(vector_col)
        if n_components < 1:
            raise ValueError("at least one component is needed")
        self.n_components, self.seed = n_components, seed

    def matrix(self, dims: int) -> np.ndarray:
        return np.array([[projection_entry(r, c, self.n_components, self.seed) for c in range(self.n_components)] for r in range(dims)])

    def transform(self, x: DataFrame) -> DataFrame:
        n, name = self.n_components, self.vector_col
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in x.schema)}, reduced array<double>"
        at = x.columns.index(name)
        matrices: dict[int, np.ndarray] = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = [x for x in pc.unique(pc.list_value_length(batch.column(at))).to_pylist() if x]
                for size in lengths:
                    if size not in matrices:
                        matrices[size] = self.matrix(size)
                reduced = project(batch.column(at), {x: matrices[x] for x in lengths}, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, reduced], names=[*batch.schema.names, "reduced"])

        return x.mapInArrow(run, schema)


class PrincipalComponents(Reducer):
    """Projection on the directions of largest variance: the plane to draw clusters in."""

    def __init__(self, n_components: int = 2, vector_col: str = "embedding") -> None:
        super().__init__(vector_col)
        self.n_components = n_components

    def fit(self, x: DataFrame) -> Reducer:
        rows = x.where(usable(F.col(self.vector_col))).select(array_to_vector(doubles(F.col(self.vector_col))).alias("features"))
        self.model = PCA(k=self.n_components, inputCol="features", outputCol="out").fit(rows)
        return self

    def transform(self, x: DataFrame) -> DataFrame:
        rows = x.where(usable(F.col(self.vector_col))).withColumn("features", array_to_vector(doubles(F.col(self.vector_col))))
        return self.model.transform(rows).withColumn("reduced", vector_to_array("out")).drop("features", "out")


def plot_points(reduced: DataFrame, labels: DataFrame, top: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """``i, x0, x1, label, is_top``: what a scatter plot of clusters shows.

    ``reduced`` holds two components in ``reduced``, ``labels(i, label)`` the clusters and ``top(birth)``
    the points to be marked.  Raises ``ValueError`` unless ``reduced`` is there and has two components in every
    row that is not null.
    """
    if "reduced" not in reduced.columns or not reduced.where(F.size("reduced") != 2).where("reduced is not null").isEmpty():
        raise ValueError("points must be reduced to two dimensions first")
    points = reduced.select(F.col(id_col).alias("i"), F.element_at("reduced", 1).alias("x0"), F.element_at("reduced", 2).alias("x1")).join(labels, "i")
    if top is None:
        return points.withColumn("is_top", F.lit(False))
    marked = top.select(F.col("birth").alias("i"), F.lit(True).alias("is_top"))
    return points.join(marked, "i", "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))
