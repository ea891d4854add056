"""Core-sets of a stream: batches of far-apart points for as long as points arrive.

Rows are dealt to slots by a hash of their id.  A slot's state is the pool that is filling up, at most
``budget * oversampling_factor`` rows; a full pool gives one batch, farthest first, and the next one begins.  The
state is in the query's checkpoint, so a restarted query goes on with the pools as they were and gives the
batches that it would have given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basinflow.functions.vectors import doubles, usable
from basinflow.operators.coreset import farthest_first

BATCHES = "slot long, batch long, position int, id long"
POOL = "batch long, ids array<long>, values array<double>, dims int"


def stream_of(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Rows of the Parquet files that are at ``path`` (a folder or a glob) or come there, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def core_set_batches(points: DataFrame, budget: int, oversampling_factor: int, slots: int = 64, seed: int = 47, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``slot, batch, position, id`` of a stream of points, for an output mode of append.

    The rows of a micro-batch enter their slot's pool in the order of an MD5 of seed and id (ties: by id, then vector).
    A batch has ``budget`` rows of a pool of ``budget * oversampling_factor``; its first is the pool's first.  Unusable
    vectors and null ids take no part, repeated rows are points each; a vector of another length than the slot's
    pool begins with takes no part.  Pools that never fill give nothing.
    """
    pool = budget * oversampling_factor
    key = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = points.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(key.alias("key"), F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("vec"))
    rows = rows.withColumn("slot", F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % slots)

    def fill(slot: tuple[int], pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, ids, values, dims = state.get if state.exists else (0, [], [], 0)
        ids, values, out = list(ids), list(values), []
        arrived = pd.concat(list(pieces))
        arrived = arrived.assign(order=[tuple(v.tolist()) for v in arrived["vec"]]).sort_values(["key", "id", "order"])
        for i, vec in zip(arrived["id"].tolist(), arrived["order"], strict=True):
            dims = dims if ids else len(vec)
            if len(vec) != dims:
                continue
            ids.append(i)
            values.extend(vec)
            if len(ids) == pool:
                picked = farthest_first(np.array(values).reshape(pool, dims), budget)
                out.append(pd.DataFrame({"slot": slot[0], "batch": batch, "position": np.arange(len(picked), dtype=np.int32), "id": np.array(ids)[picked]}))
                batch, ids, values = batch + 1, [], []
        state.update((batch, ids, values, dims))
        yield pd.concat(out) if out else pd.DataFrame({"slot": [], "batch": [], "position": [], "id": []})

    return rows.groupBy("slot").applyInPandasWithState(fill, BATCHES, POOL, "append", GroupStateTimeout.NoTimeout)


def run_available(batches: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what has arrived, append it to the table at ``path``, and read all of that table."""
    query = batches.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches.sparkSession.read.schema(BATCHES).parquet(path)
