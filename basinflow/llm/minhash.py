"""Near-duplicate groups by one-permutation hashing.

One hash per shingle fills all bins of a signature; empty bins borrow from a bin that a hash of
(bin, attempt) picks, the same for every document (optimal densification).  Bins are cut into
bands; equal bands put texts into one bucket.  A bucket of m texts yields m - 1 star edges, never
m * m pairs.  Every candidate is confirmed on the full shingle sets of the whole texts.

A star alone can miss a link between two leaves that are both unlike its centre.  Buckets whose
members are still in different groups after the stars are confirmed are therefore visited twice more:
first each member outside the bucket's largest group proposes the most similar members of other
groups, by sketch, which unites most of what is linked; then every pair of different groups that is
left is decided.  A pair is proposed in the first bucket that it shares, told by whole keys.  It is refused
without its texts only where an upper bound of what the two sets can share, from their sizes and the number of
shingles in each bin, rules the similarity out; no estimate decides.

Bucket sizes and centres are aggregated before they are joined back.  Members of a bucket are dealt
to blocks, and blocks are compared two by two in cells, so no task holds a bucket whole.  Members of a crowded
bucket are dealt by set size first: blocks meet only where their sizes allow the similarity.  Copies
share a shingle set and are one node.  Texts are known by their hash, not by the id of a row; only
those that share a bucket are shuffled, one copy from each task, and rows of a text that very many share
are told their group by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.llm.components import connected_components
from basinflow.operators.modes import HOT_ROWS, join_unique
from basinflow.sources.shared import discard, materialise


#: Shingles of one bin are counted up to here in a sketch.
FULL = 15


@dataclass(frozen=True)
class MinHashParams:
    """``words`` per shingle; ``bins`` = ``bands`` * ``rows``; link when 100 * |A & B| >= ``percent`` * |A | B|.

    With 32 bands of 4 rows a pair of similarity 0.75 misses every bucket with probability 5e-6.
    ``partners`` is how many members of other groups one text proposes per cell in the first visit; the
    second has no bound.  ``chunk`` members of a bucket are a block, a node of ``hot_rows`` rows is joined by broadcast, and ``filter_bits`` (a power of two) the
    size of the map of texts that share a bucket, which others are dropped by before the shuffle.
    """

    words: int = 5
    bands: int = 32
    rows: int = 4
    percent: int = 75
    partners: int = 8
    chunk: int = 512
    filter_bits: int = 1 << 24
    hot_rows: int = HOT_ROWS

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def bin_donors(filled: np.ndarray) -> np.ndarray:
    """For each bin the filled bin it takes its value from: itself, or the first that probing hits."""
    bins = len(filled)
    donor = np.arange(bins)
    todo, attempt = np.flatnonzero(~filled), 0
    while len(todo):
        attempt += 1
        pick = (tk.mix64(todo.astype(np.uint64) * tk.MIX[0] + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[pick]
        donor[todo[hit]] = pick[hit]
        todo = todo[~hit]
    return donor


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted set of 64-bit hashes."""
    span = np.uint64(2**64 // bins)
    first = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) * span)
    owner = np.minimum(shingles[np.minimum(first, len(shingles) - 1)] // span, np.uint64(bins - 1))
    filled = (first < len(shingles)) & (owner == np.arange(bins, dtype=np.uint64))
    return shingles[np.minimum(first, len(shingles) - 1)][bin_donors(filled)]


def packed_counts(shingles: np.ndarray, bins: int) -> np.ndarray:
    """How many shingles of a sorted set lie in each bin, up to ``FULL``, two bins in a byte."""
    edges = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins))
    counts = np.pad(np.minimum(np.diff(np.append(edges, len(shingles))), FULL), (0, bins % 2)).astype(np.uint8)
    return counts[0::2] | counts[1::2] << np.uint8(4)


def _signature_batches(batches: Iterator[pa.RecordBatch], p: MinHashParams) -> Iterator[pa.RecordBatch]:
    band_salt = tk.mix64(np.arange(1, p.bands + 1, dtype=np.uint64))
    for batch in batches:
        for part in tk.slices(batch, "text"):
            shingles, at = tk.shingle_sets(part.column(1), p.words)
            counts = np.diff(at)
            keyed, sketches, folds = [], [], np.zeros((len(counts), 2), dtype=np.uint64)
            mixed = tk.mix64(shingles + tk.MIX[2])
            for row, n in enumerate(counts):
                if not n:
                    continue
                sig = signature(shingles[at[row] : at[row + 1]], p.bins)
                key = band_salt.copy()
                for r in range(p.rows):
                    key = tk.mix64(key * tk.MIX[0] + sig[r :: p.rows])
                keyed.append(key)
                marks = (tk.mix64(sig) >> np.uint64(56)).astype(np.uint8), key.astype("<u8").view(np.uint8)
                sketches.append(np.concatenate([*marks, packed_counts(shingles[at[row] : at[row + 1]], p.bins)]).tobytes())
                folds[row] = np.bitwise_xor.reduce(mixed[at[row] : at[row + 1]]), np.sum(shingles[at[row] : at[row + 1]])
            some = counts > 0
            ids = tk.mix64(folds[:, 0] + folds[:, 1] * tk.MIX[1])
            lists = np.concatenate([[0], np.cumsum(some * p.bands)]).astype(np.int32)
            flat = np.concatenate(keyed) if keyed else np.zeros(0, dtype=np.uint64)
            filler = iter(sketches)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(counts, type=pa.int64()),
                    pa.array(ids.view(np.int64), mask=~some),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(flat.view(np.int64))),
                    pa.array([next(filler) if s else None for s in some], type=pa.binary()),
                ],
                names=["doc", "known_as", "n_shingles", "node", "bands", "sketch"],
            )


def text_key(text: str) -> Column:
    """What a text is known by."""
    return F.xxhash64(text)


def signatures(docs: DataFrame, id_col: str, text_col: str, p: MinHashParams) -> DataFrame:
    """Per document: its text's hash, shingle count, 64-bit id of its shingle set, band keys, and a sketch:
    one byte for each bin, the band keys, and half a byte for the number of shingles in each bin."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), text_key(text_col)).mapInArrow(
        lambda batches: _signature_batches(batches, p), f"doc {kind}, known_as long, n_shingles long, node long, bands array<long>, sketch binary"
    )


def _held_batches(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that ``held`` lets pass, one for each text of a task."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column(0).to_numpy()
        keep = np.zeros(len(keys), dtype=bool)
        keep[np.unique(keys, return_index=True)[1]] = True
        keep &= held[keys & (len(held) - 1)]
        at = [k for k in np.flatnonzero(keep).tolist() if int(keys[k]) not in seen]
        seen.update(keys[at].tolist())
        yield batch.take(pa.array(at, type=pa.int64()))


def texts_of(docs: DataFrame, text_col: str, carriers: DataFrame, p: MinHashParams) -> DataFrame:
    """``node, text`` for ``carriers(node, known_as)``.

    Texts that no carrier can be are dropped before the shuffle by a bit map of fixed size, which lets
    more texts pass the more carriers there are, and never drops one."""
    place = F.col("known_as").bitwiseAND(p.filter_bits - 1)
    words = carriers.select(place.alias("place")).groupBy(F.expr("place div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 32 as int))")).alias("bits")).toArrow()
    held = np.zeros(p.filter_bits // 32, dtype="<u4")
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    packed = docs.sparkSession.sparkContext.broadcast(held.view(np.uint8))
    rows = docs.select(text_key(text_col).alias("known_as"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(lambda batches: _held_batches(batches, np.unpackbits(packed.value, bitorder="little").view(bool)), "known_as long, text string")
    return rows.join(carriers, "known_as").groupBy("node").agg(F.first("text").alias("text"))


def _confirm_batches(batches: Iterator[pa.RecordBatch], p: MinHashParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "right_text", 1 << 20):
            _, first, at = np.unique(part.column(0).to_numpy(), return_index=True, return_inverse=True)
            left, la = tk.shingle_sets(part.column(2).take(pa.array(first)), p.words)
            right, ra = tk.shingle_sets(part.column(3), p.words)
            linked = np.zeros(part.num_rows, dtype=bool)
            for row in range(part.num_rows):
                a, b = left[la[at[row]] : la[at[row] + 1]], right[ra[row] : ra[row + 1]]
                if 100 * min(len(a), len(b)) < p.percent * max(len(a), len(b)):
                    continue
                common = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
                linked[row] = 100 * common >= p.percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked)], names=["a", "b", "linked"])


def confirm(pairs: DataFrame, texts: DataFrame, p: MinHashParams) -> DataFrame:
    """``pairs(a, b)`` with ``linked``, decided on the whole texts ``texts(node, text)``."""
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"{n}_text")) for k, n in (("a", "left"), ("b", "right")))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
    return rows.mapInArrow(lambda batches: _confirm_batches(batches, p), "a long, b long, linked boolean")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, band, node, centre`` of the buckets that hold two nodes or more.

    The centre is the node that ranks first in one order of all nodes, so the many buckets of a group
    mostly agree on it and give the same edges.
    """
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    rank = F.struct(F.xxhash64("node").alias("rank"), "node")
    centres = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(rank)["node"].alias("centre")).where("n > 1")
    return members.join(centres, "bucket").select("bucket", "band", "node", "centre")


def star_edges(buckets: DataFrame) -> DataFrame:
    """One edge from each bucket's centre to each other member."""
    rows = buckets.where("node <> centre")
    return rows.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def unsettled(buckets: DataFrame, groups: DataFrame, sketches: DataFrame, p: MinHashParams) -> DataFrame:
    """Rows ``(bucket, cell, side, band, node, part, n, sketch)`` of the buckets that hold several groups.

    The members of the bucket's largest group are dealt to blocks, and so are the others.  A cell holds
    two blocks: one of others (``side`` 1), which asks, and one of either (``side`` 0), which is asked; or
    one block of others, whose members (``side`` 2) ask each other.  In a bucket of more than a block, members
    belong to classes of set size so wide that only those of one class or of neighbouring ones can be linked;
    blocks are of one class, and only those meet.
    """
    wide = max(math.log(100 / p.percent), 1e-3) * (1 + 1e-9)
    sized = groups.join(sketches.select("node", F.col("n").alias("set")), "node")
    member = buckets.join(sized, "node").select("bucket", "band", "node", F.col("label").alias("part"), "set")
    parts = member.groupBy("bucket", "part").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("part", "m").alias("main"), F.sum("m").alias("m")).where("parts > 1")
    kind = F.when(F.col("m") > p.chunk, F.floor(F.log("set") / wide)).otherwise(0).cast("int")
    mixed = member.join(sizes, "bucket").select("bucket", "band", "node", "part", kind.alias("class"), (F.col("part") == F.col("main")).alias("leads"))
    blocks = [F.ceil(F.count_if(who) / p.chunk).cast("long").alias(k) for who, k in ((F.col("leads"), "own_mains"), (~F.col("leads"), "own_others"))]
    every = Window.partitionBy("bucket")
    before = every.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    near = every.orderBy("class").rangeBetween(-1, 1)
    places = mixed.groupBy("bucket", "class").agg(*blocks)
    for k in ("mains", "others"):
        places = places.withColumns({k: F.sum(f"own_{k}").over(every), f"{k}_at": F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0))})
        places = places.withColumns({f"{k}_lo": F.min(f"{k}_at").over(near), f"{k}_hi": F.max(F.col(f"{k}_at") + F.col(f"own_{k}")).over(near)})
    placed = mixed.join(places, ["bucket", "class"])
    first, count = (F.when(F.col("leads"), F.col(x)).otherwise(F.col(y)) for x, y in (("mains_at", "others_at"), ("own_mains", "own_others")))
    own = first + F.pmod(F.xxhash64("node", F.lit(7)), count)
    span = "CASE WHEN {0}_hi > {0}_lo THEN sequence({0}_lo, {0}_hi - 1) ELSE array() END".format
    meets = F.expr(f"CASE WHEN leads THEN {span('others')} ELSE concat({span('mains')}, transform({span('others')}, y -> y + mains)) END")
    dealt = placed.select("*", own.alias("own"), F.explode(meets).alias("x"))
    low, high = F.expr("least(own, x - mains)"), F.expr("greatest(own, x - mains)")
    cell = F.when(F.col("leads"), F.expr("x * mains + own")).when(F.expr("x < mains"), F.expr("own * mains + x")).otherwise(F.expr("others * mains") + low * F.col("others") + high)
    side = F.when(F.col("leads"), 0).when(F.expr("x < mains"), 1).when(low == high, 2).otherwise((F.col("own") == high).cast("int"))
    rows = dealt.select("bucket", cell.alias("cell"), side.alias("side"), "band", "node", "part").join(sketches, "node").select("bucket", "cell", "side", "band", "node", "part", "n", "sketch")
    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")


def _sketch_matrix(column: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return raw[tk.offsets(column)[0] :][: len(column) * width].reshape(-1, width)


@dataclass
class Members:
    """Some members of a cell: nodes, their groups, set sizes, the three parts of their sketches, and
    how many shingles the counts of their bins leave out."""

    node: np.ndarray
    part: np.ndarray
    n: np.ndarray
    sketch: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(rows: pa.RecordBatch, p: MinHashParams) -> Members:
        node, part, n = (rows.column(k).to_numpy() for k in (4, 5, 6))
        ends = (p.bins, p.bins + 8 * p.bands)
        sketch, keys, packed = np.split(_sketch_matrix(rows.column(7), ends[1] + (p.bins + 1) // 2), ends, axis=1)
        counts = np.stack([packed & FULL, packed >> 4], axis=2).reshape(len(packed), -1)[:, : p.bins]
        return Members(node, part, n, sketch, np.ascontiguousarray(keys).view("<u8"), counts, n - counts.sum(axis=1, dtype=np.int64))

    def where(self, some: np.ndarray) -> Members:
        return Members(*(x[some] for x in vars(self).values()))


def _proposal_batches(batches: Iterator[pa.RecordBatch], p: MinHashParams, most: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of each asking member of a cell: the ``most`` similar ones, or all where that is None."""
    for _, rows in cells(batches):
        side, band = rows.column("side").to_numpy(), int(rows.column("band")[0].as_py())
        every = Members.of(rows, p)
        asking, held = every.where(side > 0), every.where(side != 1)
        if len(asking.node) and len(held.node):
            yield from _proposals(asking, held, band, most, p)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Consecutive rows of one bucket and cell, together."""
    now: tuple[int, int] | None = None
    pieces: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(2)])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]])) if batch.num_rows else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            here = int(keys[0, lo]), int(keys[1, lo])
            if now not in (None, here):
                yield now, pa.concat_batches(pieces)
                pieces = []
            now = here
            pieces.append(batch.slice(lo, hi - lo))
    if pieces and now is not None:
        yield now, pa.concat_batches(pieces)


def most_shared(asking: Members, held: Members, row: np.ndarray, col: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """For each pair, an upper bound of the shingles that both have; ``equal`` tells the bins whose marks agree.

    A bin holds no more common shingles than the smaller count, and one fewer where both count the
    same but their least shingles differ.
    """
    a, b = asking.counts[row], held.counts[col]
    fewer = (a == b) & (a > 0) & (a < FULL) & ~equal
    return np.minimum(a, b).sum(axis=1, dtype=np.int64) - fewer.sum(axis=1) + np.minimum(asking.rest[row], held.rest[col])


def _possible(asking: Members, held: Members, row: np.ndarray, col: np.ndarray, band: int, p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that share ``band`` first and whose sets may reach the similarity, and their marks in common."""
    equal = asking.sketch[row] == held.sketch[col]
    own = (asking.keys[row] == held.keys[col]).argmax(axis=1) == band
    row, col, equal = row[own], col[own], equal[own]
    most = most_shared(asking, held, row, col, equal)
    keep = 100 * most >= p.percent * (asking.n[row] + held.n[col] - most)
    return row[keep], col[keep], equal[keep].sum(axis=1)


def _proposals(asking: Members, held: Members, band: int, most: int | None, p: MinHashParams) -> Iterator[pa.RecordBatch]:
    block = max(1, (4 << 20) // (p.bins * len(held.node)))
    for at in range(0, len(asking.node), block):
        part, n = asking.part[at : at + block], asking.n[at : at + block]
        apart = part[:, None] != held.part[None, :]
        sized = 100 * np.minimum(n[:, None], held.n[None, :]) >= p.percent * np.maximum(n[:, None], held.n[None, :])
        row, col = np.nonzero(apart & sized)
        row, col, agree = _possible(asking, held, at + row, col, band, p)
        row -= at
        if most is not None:
            order = np.lexsort((held.node[col], -agree, row))
            row, col = row[order], col[order]
            counts = np.bincount(row, minlength=len(n))
            keep = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < most
            row, col = row[keep], col[keep]
        a, b = asking.node[at + row], held.node[col]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups(node, label)`` after ``links(a, b)`` between their nodes: components of the labels alone."""
    ends = [groups.select(F.col("node").alias(k), F.col("label").alias(f"of_{k}")) for k in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct()
    moved = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return materialise(groups.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "groups")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: MinHashParams = MinHashParams()) -> DataFrame:
    """Group documents whose shingle sets reach the similarity, transitively.

    Returns one row per input row: ``id_col``, ``n_shingles`` (set size), ``component_id`` (smallest
    id reachable, its own included) and ``kept`` (it is that smallest id).  Null and empty texts have
    no shingles and stand alone.  Texts with fewer words than a shingle count as one shingle of all
    their words.  Equal texts under several ids form one group; rows that repeat an id all come back.
    A null id never is a smallest id unless its group has no other.  Other columns are ignored; an
    empty table gives an empty result.
    """
    sigs = materialise(signatures(docs, id_col, text_col, p), "signatures")
    firsts = [F.first(c).alias(c) for c in ("bands", "sketch")]
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc").alias("least_doc"), F.min("known_as").alias("known_as"), *firsts, F.first("n_shingles").alias("n"))
    nodes = materialise(nodes, "nodes")
    members = materialise(sigs.select("doc", "n_shingles", "node"), "members")
    discard(sigs)
    buckets = materialise(shared_buckets(nodes), "buckets")
    carriers = materialise(nodes.join(buckets.select("node").distinct(), "node", "left_semi").drop("bands", "least_doc"), "carriers")
    texts = materialise(texts_of(docs, text_col, carriers.select("node", "known_as"), p), "texts")
    tried = materialise(confirm(star_edges(buckets), texts, p), "tried")
    steps = [nodes, buckets, carriers, texts, tried]
    groups = regrouped(carriers.select("node", F.col("node").alias("label")), tried.where("linked"))
    for most in (p.partners, None):
        rows = unsettled(buckets, groups, carriers.select("node", "n", "sketch"), p)
        proposed = rows.mapInArrow(lambda batches, most=most: _proposal_batches(batches, p, most), "a long, b long").distinct()
        more = materialise(confirm(proposed.join(tried, ["a", "b"], "left_anti"), texts, p), "tried")
        steps += [more, groups]
        tried = tried.unionByName(more)
        groups = regrouped(groups, more.where("linked"))
    labelled = nodes.select("node", "least_doc").join(groups, "node", "left").select("node", "least_doc", F.coalesce("label", "node").alias("part"))
    smallest = labelled.groupBy("part").agg(F.min("least_doc").alias("component_id"))
    labelled = materialise(labelled.join(smallest, "part").select("node", "component_id"), "components")
    for step in [*steps, groups]:
        discard(step)
    told = join_unique(members.where("node is not null"), labelled, "node", p.hot_rows)
    return told.unionByName(members.where("node is null").withColumn("component_id", F.lit(None).cast(docs.schema[id_col].dataType))).select(
        F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("component_id", "doc").eqNullSafe(F.col("doc")).alias("kept")
    )
