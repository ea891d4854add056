"""Inputs: tables, repeatable samples, gathers, image listings and the small reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Densities and out-lists of the eleven-node graph with plateaus, and thresholds that
#: separate its levels.
ELEVEN_DENSITIES = [0.85, 0.85, 0.85, 0.5, 0.8, 0.8, 0.8, 0.3, 0.9, 0.9, 0.9]
ELEVEN_NEIGHBOURS = [[1, 2], [0, 2], [0, 1, 3], [2, 4], [3, 5, 6], [4, 6], [3, 4, 5], [2, 6, 8], [7, 9, 10], [8, 10], [8, 9]]
ELEVEN_THRESHOLDS = [0.0, 0.31, 0.51, 0.56]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings(vec_id, embedding, label)``."""
    return read_table(spark, sf_dir, "embeddings")


def sample_rows(df: DataFrame, n: int, id_col: str = "vec_id", seed: int = 47) -> DataFrame:
    """``min(n, rows)`` rows without replacement: those whose seed and id have the smallest MD5.

    The same rows on every run and however the input is partitioned; equal hashes are ordered by id.
    """
    return df.orderBy(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col(id_col).cast("string"))), F.col(id_col)).limit(n)


def gather(df: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of ``df`` for each row of ``ids``; ids that ``df`` lacks give nothing."""
    return ids.join(df, id_col)


def graph_table(spark: SparkSession, densities: list[float], neighbours: list[list[int]]) -> tuple[DataFrame, DataFrame]:
    """``edges(i, rk, j)`` and ``density(i, f)`` of a small graph given as lists.

    Raises ``ValueError`` when the lists differ in length, or a density is not a number.
    """
    if len(densities) != len(neighbours):
        raise ValueError("densities and neighbour lists must have the same length")
    if any(f != f for f in densities):
        raise ValueError("densities must be numbers")
    edges = [(i, rk, j) for i, row in enumerate(neighbours) for rk, j in enumerate(row, 1)]
    return (
        spark.createDataFrame(edges, "i long, rk int, j long"),
        spark.createDataFrame([(i, float(f)) for i, f in enumerate(densities)], "i long, f double"),
    )


def eleven_nodes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Edges and densities of the eleven-node graph."""
    return graph_table(spark, ELEVEN_DENSITIES, ELEVEN_NEIGHBOURS)


def weighted_digraph(edges: DataFrame, density: DataFrame) -> DataFrame:
    """``src, dst, weight``: each listed neighbour points to its vertex, weighted by the density step."""
    own, other = density.select("i", F.col("f").alias("fi")), density.select(F.col("i").alias("j"), F.col("f").alias("fj"))
    return edges.join(own, "i").join(other, "j").select(F.col("j").alias("src"), F.col("i").alias("dst"), F.round(F.col("fi") - F.col("fj"), 2).alias("weight"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, content`` of the images below a folder, hidden files left out.

    Raises ``ValueError`` when there is none.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "[!.]*.{jpg,jpeg,png}")
        .load(folder)
    )
    if found.select("path").limit(1).count() == 0:
        raise ValueError(f"no images below {folder}")
    return found
