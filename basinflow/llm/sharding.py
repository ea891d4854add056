"""Shards along a Hilbert curve over several metadata dimensions, in DataFrame functions only.

Each dimension is quantised at exact quantiles of the whole table; a row's levels form its cell.  The histogram over (cell, salt) is small by construction (2 ** (dimensions * bits) cells
times ``salts``), so the curve index is worked out per cell, running sums over the histogram give
every cell's first rank, and a row's rank is that plus its place within its (cell, salt) group.
No window ever spans the table and a cell that holds a third of all rows is spread over its salts, whose
number follows the rows.
Runs of equal row count along the rank are the shards: narrow ranges of every dimension at once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinflow.sources.shared import discard, materialise


@functools.cache
def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """State machine of the Hilbert curve: digit and next state for (state, one bit per dimension).

    A state is (entry corner, direction); the reflected Gray code orders the corners of a cube and
    each subcube's entry and direction follow from its place in that order.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & mask

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    rank = {gray(x): x for x in range(size)}
    entry = [0] + [gray(2 * ((w - 1) // 2)) for w in range(1, size)]
    turn = [0] + [trailing_ones(w - 1 if w % 2 == 0 else w) % dims for w in range(1, size)]
    digits, following = [], []
    for state in range(size * dims):
        corner, direction = state % size, state // size
        for bits in range(size):
            w = rank[rotate(bits ^ corner, direction + 1)]
            digits.append(w)
            following.append((corner ^ rotate(entry[w], -(direction + 1))) + size * ((direction + turn[w] + 1) % dims))
    return digits, following


def curve_index(cell: Column, dims: int, bits: int) -> Column:
    """Place on the curve of a cell whose level ``d`` fills bits ``d * bits`` and up."""
    digits, following = (F.lit(x) for x in curve_tables(dims))
    state, index = F.lit(0), F.lit(0).cast("long")
    for level in reversed(range(bits)):
        corner = sum((F.shiftright(cell, d * bits + level).bitwiseAND(1) * (1 << d) for d in range(dims)), F.lit(0))
        at = (state * (1 << dims) + corner + 1).cast("int")
        index = index * (1 << dims) + F.element_at(digits, at)
        state = F.element_at(following, at)
    return index


def split_points(df: DataFrame, dims: Sequence[str], levels: int, most_values: int) -> list[list]:
    """For each dimension the values at which its levels begin, at even shares of the rows.

    They are exact: of the n rows that have a value the one of rank ceil(k * n / ``levels``), for every k,
    from the counts of all values, strings as bytes and the rest as numbers.  Up to ``most_values``
    different values of a column are added up by the driver, more by Spark."""
    out = []
    for c in dims:
        kind = "binary" if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)) else "double"
        counts = materialise(df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast(kind).alias("value")).agg(F.count("*").alias("n")).where("value is not null"), "split-counts")
        few = counts.limit(most_values + 1).collect()
        if len(few) > most_values:
            points = _points_of_many(counts, levels)
        else:
            # As in Spark, NaN is the largest number.
            values = sorted(((bytes(r.value) if kind == "binary" else r.value, r.n) for r in few), key=lambda x: (x[0] != x[0], x[0]))
            total, before, points = sum(n for _, n in values), 0, []
            for value, n in values:
                points += [value] if before * levels // total < (before + n) * levels // total else []
                before += n
        discard(counts)
        out.append(points[: levels - 1])
    return out


def _points_of_many(counts: DataFrame, levels: int) -> list:
    """Split points from the table ``counts(value, n)``: running sums within ranges of values, from where
    the ranges before end; a window never spans the table and only the points reach the driver."""
    ranged = materialise(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "split-ranges")
    parts = ranged.groupBy("part").agg(F.min("value").alias("first"), F.sum("n").alias("in_part"))
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"), F.sum("in_part").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(parts), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    points = placed.where(f"before * {levels} div total < (before + n) * {levels} div total").select("value", "before").collect()
    discard(ranged)
    return [bytes(r.value) if isinstance(r.value, (bytes, bytearray)) else r.value for r in sorted(points, key=lambda r: r.before)]


def assign_shards(df: DataFrame, id_col: str, dims: Sequence[str], shards: int, bits: int = 4, group_rows: int = 1 << 20, accuracy: int = 1000, most_values: int = 10_000) -> DataFrame:
    """All rows of ``df`` with ``curve_index``, ``shard`` (0 to ``shards`` - 1) and ``slot``.

    Row counts of shards differ by at most one; slots are gapless from 0 within a shard; shards
    follow the curve.  Null values and NaN take the lowest and highest level of their dimension.
    Repeated rows get slots of their own; equal cells are ordered by a hash of the id and then the
    id, so ties have a defined order up to rows equal in it.  An empty table gives an empty result.
    Columns of ``df`` named like a result column are replaced by it.  Split points are exact whatever
    ``accuracy`` is, which earlier callers give.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("curve_index", "shard", "slot")])
    cell = F.lit(0).cast("long")
    for k, (c, points) in enumerate(zip(dims, split_points(df, dims, 1 << bits, most_values), strict=True)):
        value = F.col(c).cast("binary" if points and isinstance(points[0], bytes) else "double")
        level = sum((F.coalesce(value > F.lit(x), F.lit(False)).cast("long") for x in points), F.lit(0).cast("long"))
        cell = cell + level * (1 << (bits * k))
    salts = min(4096, max(16, df.count() // group_rows))
    order = F.xxhash64(F.col(id_col))
    keyed = df.select(row.alias("row"), F.col(id_col).alias("id"), cell.alias("cell"), F.pmod(order, F.lit(salts)).alias("salt"), order.alias("order"))
    counts = keyed.groupBy("cell", "salt").agg(F.count("*").alias("n")).withColumn("curve", curve_index(F.col("cell"), len(dims), bits))
    group = F.shiftright("curve", max(0, len(dims) * bits - 8))
    counts = counts.withColumn("group", group)
    totals = counts.groupBy("group").agg(F.sum("n").alias("in_group"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("group", F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("base"), F.sum("in_group").over(Window.partitionBy()).alias("total"))
    earlier = Window.partitionBy("group").orderBy("curve", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(totals, "group").select("cell", "salt", "curve", "total", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("first"))
    within = Window.partitionBy("cell", "salt").orderBy("order", "id")
    ranked = keyed.join(starts, ["cell", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    placed = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    slot = F.expr(f"rank - (shard * total + {shards} - 1) div {shards}")
    return placed.select("row.*", F.col("curve").alias("curve_index"), "shard", slot.alias("slot"))


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write the rows of :func:`assign_shards` in curve order, one folder per shard."""
    ordered = assigned.repartition("shard", F.expr(f"slot % {files_per_shard}")).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
