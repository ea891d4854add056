"""Greedy core-sets: batches of points that lie far from each other.

Every batch draws its own pool of ``budget * oversampling`` rows and picks ``budget`` of them by
farthest-first traversal.  Pools are independent, so batches are groups of a grouped map: many run at
once, and a group is no larger than its pool.  Rows compete for a pool among those of their salt first, so
no task ranks the table.

A core-set of the whole table is composed: every group of rows gives its own, and those are traversed together, so
each task sees a bounded number of rows and every row is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.functions.vectors import doubles, usable
from basinflow.operators.knn import Knn, knn_exact
from basinflow.sources.shared import materialise


def farthest_first(points: np.ndarray, budget: int) -> np.ndarray:
    """Positions in order of choice: the first point, then always the one farthest from those taken.

    Ties go to the earlier position.  A running minimum makes each step one pass over the pool.
    """
    picked = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    nearest[0] = -1
    while len(picked) < min(budget, len(points)):
        best = int(nearest.argmax())
        picked.append(best)
        nearest = np.minimum(nearest, ((points - points[best]) ** 2).sum(axis=1))
        nearest[picked] = -1
    return np.array(picked)


def greedy_core_sets(points: DataFrame, budget: int, oversampling_factor: int, num_batches: int = 1, seed: int = 47, salts: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``batch, position, id``: ``num_batches`` core-sets of ``budget`` rows each.

    Batch ``b`` draws the pool of rows whose seed, batch and id have the smallest MD5, in that order; the
    pool's first row starts the traversal.  With fewer rows than the budget all are returned.
    Unusable vectors and null ids take no part; rows with one id are ordered by their vectors.
    """
    pool = budget * oversampling_factor
    rows = points.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("vec"))
    each = rows.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(num_batches - 1))).alias("batch"))
    each = each.withColumn("key", F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("batch").cast("string"), F.col("id").cast("string"))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for groups in (["batch", "salt"], ["batch"]):
        each = each.withColumn("nth", F.row_number().over(Window.partitionBy(*groups).orderBy("key", "id", "vec"))).where(F.col("nth") <= pool)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        picked = farthest_first(np.stack(group["vec"].to_numpy()), budget)
        return pd.DataFrame({"batch": group["batch"].iloc[0], "position": np.arange(len(picked), dtype=np.int32), "id": group["id"].to_numpy()[picked]})

    return each.select("batch", "nth", "id", "vec").groupBy("batch").applyInPandas(run, "batch int, position int, id long")


#: Rows whose farthest-first order is found in one task; of more rows a round's candidates reach the driver.
POOL_ROWS, CANDIDATES = 65_536, 4_096


def _columns(vectors: pa.ListArray, least: int = 0) -> np.ndarray:
    """Vectors as columns of a matrix; shorter ones are filled with zeros, to ``least`` components at least."""
    sizes = np.diff(vectors.offsets.to_numpy())
    rows = np.zeros((len(vectors), max(int(sizes.max(initial=0)), least)))
    rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return np.ascontiguousarray(rows.T)


def _gaps(columns: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances to ``centre``, added from left to right: the same whatever rows stand beside."""
    wide = np.zeros(len(columns))
    wide[: len(centre)] = centre
    return np.add.accumulate((columns - wide[:, None]) ** 2, axis=0)[-1] if len(columns) else np.zeros(columns.shape[1])


def _pick(table: pa.Table, budget: int) -> pa.Table:
    """The core-set of a group of rows ``part, key, id, vec``, in order of choice, with the distance of each row
    to those chosen before it (the first one's is infinite)."""
    table = table.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
    columns = _columns(table.column("vec").chunk(0))
    order, far, nearest = [0], [np.inf], np.full(table.num_rows, np.inf)
    for _ in range(min(budget, table.num_rows) - 1):
        nearest = np.minimum(nearest, _gaps(columns, columns[:, order[-1]]))
        nearest[order] = -1
        order.append(int(nearest.argmax()))
        far.append(np.sqrt(nearest[order[-1]]))
    rows = table.take(pa.array(order)).select(["part", "key", "id", "vec"])
    return rows.append_column("position", pa.array(np.arange(len(order), dtype=np.int32))).append_column("distance", pa.array(far))


def _near_batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, chosen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, id, vec`` that are not ``chosen`` yet, with ``near``, the squared distance to the nearest that is."""
    for batch in batches:
        batch = batch.filter(pa.array(~np.isin(batch.column(1).to_numpy(), ids)))
        if batch.num_rows:
            columns, near = _columns(batch.column(2), max(map(len, chosen))), np.full(batch.num_rows, np.inf)
            for centre in chosen:
                near = np.minimum(near, _gaps(columns, centre))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["key", "id", "vec", "near"])


def _traversed(rows: DataFrame, budget: int) -> DataFrame:
    """As :func:`_pick` of all ``rows(key, id, vec)`` together, with the same result, in rounds over the table.

    A round brings the :data:`CANDIDATES` rows that lie farthest from those chosen.  As others come no farther, the
    farthest candidate is the next choice for as long as it lies farther than the last one did.
    """
    first = rows.orderBy("key", "id").first()
    ids, chosen, far = [first["id"]], [np.array(first["vec"])], [math.inf]
    while len(ids) < budget:
        known, centres = np.array(ids), list(chosen)
        near = rows.select("key", "id", "vec").mapInArrow(lambda b: _near_batches(b, known, centres), "key string, id long, vec array<double>, near double")  # noqa: B023
        top = near.orderBy(F.desc("near"), "key", "id").limit(CANDIDATES).toArrow()
        if not top.num_rows:
            break
        bound = top.column("near")[-1].as_py() if top.num_rows == CANDIDATES else -1.0
        top = top.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
        columns, nearest, fresh = _columns(top.column("vec").chunk(0)), top.column("near").to_numpy().copy(), True
        while len(ids) < budget and (nearest.max() > bound or fresh and nearest.max() >= 0):
            best, fresh = int(nearest.argmax()), False
            ids.append(top.column("id")[best].as_py())
            chosen.append(np.array(top.column("vec")[best].as_py()))
            far.append(math.sqrt(nearest[best]))
            nearest = np.where(nearest < 0, -1, np.minimum(nearest, _gaps(columns, columns[:, best])))
            nearest[best] = -1
    return rows.sparkSession.createDataFrame([(k, i, d) for k, (i, d) in enumerate(zip(ids, far, strict=True))], "position int, id long, distance double")


def covering_core_set(points: DataFrame, budget: int, group_rows: int = 65_536, fan_in: int = 32, seed: int = 47, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``position, id, distance``: ``budget`` rows that cover the whole table, farthest first.

    ``distance`` is to the nearest row chosen before (null for the first).  Groups of about ``group_rows`` rows are
    dealt by an MD5 of the id; the rows of all their core-sets are traversed once more.  A row lies within the
    group's radius of what its group chose, and that within the last one's: the radius is at most four times the
    smallest possible one, however many groups there are.  A task holds ``group_rows`` rows, and the last traversal
    takes one task up to :data:`POOL_ROWS` rows or ``fan_in * budget``; more rows take rounds over all tasks, with the
    same result.  Unusable vectors and null ids take no part; of rows with one id that with the smallest
    vector counts; with fewer ids than the budget all are returned.
    """
    rows = points.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(doubles(F.col(vector_col))).alias("vec"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("id").cast("string"))))
    groups = max(1, -(-rows.count() // group_rows))
    part = F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % groups
    schema = "part long, key string, id long, vec array<double>, position int, distance double"
    held = rows.select(part.alias("part"), "key", "id", "vec").groupBy("part").applyInArrow(lambda t: _pick(t, budget), schema)
    if groups > 1:
        held = materialise(held, "core-sets")
        if held.count() > max(POOL_ROWS, fan_in * budget):
            held = _traversed(held, budget)
        else:
            held = held.select(F.lit(0).cast("long").alias("part"), "key", "id", "vec").groupBy("part").applyInArrow(lambda t: _pick(t, budget), schema)
    return held.select("position", "id", F.when(F.col("position") > 0, F.col("distance")).alias("distance"))


def covering_radius(points: DataFrame, chosen: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``radius``: the largest distance of a row to the nearest of the rows ``chosen(id)``."""
    centres = points.join(chosen.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return knn_exact(points, Knn(1, root=True), centres, id_col, vector_col).agg(F.max("dist").alias("radius"))
