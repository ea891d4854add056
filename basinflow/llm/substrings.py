"""Removal of word passages that an earlier document already has.

A window is ``window`` consecutive words of one document.  A window is repeated when its word sequence
also starts in a document with a smaller id; every word that a repeated window covers goes.  Windows
are judged on the input, so what is removed does not depend on an order of work.

Every window has a Rabin-Karp hash (a polynomial of its words' hashes, from one running sum).  Documents
form blocks (runs of rows of one file).  A block sends its distinct hashes, each with the smallest id
that has it there, to buckets by ranges of the hash; a bucket takes the minimum over all blocks and
answers each block with one bit a hash: whether an earlier document elsewhere has it.  A block then
meets its answers and merges its repeated windows into maximal intervals of words.  A passage that many
documents share is one hash a block, so no bucket follows its copies, and nothing is sampled or pruned.
Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.llm.lm import LMParams, block_runs, bucket_of, in_blocks, pack_counts, pack_keys, unpack, unpack_keys
from basinflow.sources.shared import materialise

#: Base of the polynomial (odd, so that it has an inverse modulo 2^64) and that inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stands for a missing id: after every other.
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SubstringParams:
    """Words in a window; bytes of text in a block and for each bucket."""

    window: int = 13
    block_bytes: int = 6 << 20
    bucket_bytes: int = 8 << 20


def rabin_karp(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values: sum of ``h[i + k] * BASE ** (n - 1 - k)`` modulo 2^64, mixed.

    A running sum of ``h[j] / BASE ** j`` gives every window as a difference of two of its values.
    """
    size = len(hashes)
    if size < n:
        return np.zeros(0, dtype=np.uint64)
    down = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, INVERSE, dtype=np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(hashes * down, dtype=np.uint64))
    up = np.multiply.accumulate(np.append(np.uint64(pow(BASE, n - 1, 1 << 64)), np.full(size - n, BASE, dtype=np.uint64)))
    return tk.mix64((sums[n:] - sums[:-n]) * up)


@dataclass
class Block:
    """Words and windows of a block's documents, in the order of their ids.

    ``keys`` are the distinct hashes, sorted; ``at`` is the place in them of each window, ``starts`` the
    window's first word, ``doc`` its row and ``least`` the smallest id that has each key."""

    table: pa.Table
    ids: np.ndarray
    missing: np.ndarray
    data: np.ndarray
    spans: tuple[np.ndarray, np.ndarray]
    offsets: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    least: np.ndarray

    @staticmethod
    def of(table: pa.Table, window: int) -> Block:
        table = table.sort_by("doc").combine_chunks()  # rows without an id come last
        column = table.column("doc")
        missing = column.is_null().to_numpy()
        ids = column.fill_null(LAST).to_numpy()
        texts = table.column("text").chunk(0) if table.num_rows else pa.array([], type=pa.string())
        data, bounds = tk.text_bytes(texts)
        first, last = tk.runs(~tk.SPACE[data], bounds)
        offsets = np.searchsorted(first, bounds)
        counts = np.maximum(np.diff(offsets) - window + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[doc]
        every = rabin_karp(tk.span_hashes(data, first, last), window)[starts]
        keys, index, at = np.unique(every, return_index=True, return_inverse=True)
        return Block(table, ids, missing, data, (first, last), offsets, starts, doc, keys, at, ids[doc[index]])


ASKED = "bucket int, block long, keys binary, base long, docs binary"
ANSWERS = "block long, bucket int, earlier binary"


def _ask_batches(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of each block and the smallest id that has them there, by bucket."""
    for number, table in block_runs(batches):
        block = Block.of(table, window)
        if not len(block.keys):
            continue
        bucket = bucket_of(block.keys, buckets)
        found, starts = np.unique(bucket, return_index=True)
        cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]
        bases = [int(block.least[c].min()) for c in cuts]
        docs = [pack_counts(block.least[c].view(np.uint64) - np.int64(b).view(np.uint64)) for c, b in zip(cuts, bases, strict=True)]
        columns = [found, np.full(len(found), number, dtype=np.int64), [pack_keys(block.keys[c]) for c in cuts], bases, docs]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "keys", "base", "docs"])


def _answer_bucket(table: pa.Table) -> pa.Table:
    """For each block that asked, in the order of its keys, whether an earlier document has them elsewhere.

    Tasks that share a block (the scan may split it) are one block here."""
    blocks, place = np.unique(table.column("block").to_numpy(), return_inverse=True)
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    docs = [(unpack(x.as_py()).astype(np.uint64) + np.int64(b).view(np.uint64)).view(np.int64) for x, b in zip(table.column("docs"), table.column("base").to_pylist(), strict=True)]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(found), LAST)
    np.minimum.at(least, at, np.concatenate(docs))
    ends = np.cumsum([0] + [len(x) for x in keys])
    answers = []
    for k in range(len(blocks)):
        rows = np.flatnonzero(place == k)
        mine, own = at[ends[rows[0]] : ends[rows[0] + 1]], docs[rows[0]]
        if len(rows) > 1:
            every = np.concatenate([at[ends[r] : ends[r + 1]] for r in rows])
            mine, back = np.unique(every, return_inverse=True)
            own = np.full(len(mine), LAST)
            np.minimum.at(own, back, np.concatenate([docs[r] for r in rows]))
        answers.append(np.packbits(least[mine] < own).tobytes())
    bucket = table.column("bucket")[0].as_py()
    columns = [blocks, np.full(len(blocks), bucket, dtype=np.int32), answers]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "earlier"])


def repeated_windows(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    """Windows of the block whose words an earlier document has, there or elsewhere."""
    sizes = np.bincount(bucket_of(block.keys, buckets), minlength=buckets)
    earlier = [np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=int(sizes[b])) for b, raw in sorted(zip(answers.column("bucket").to_pylist(), answers.column("earlier").to_pylist(), strict=True))]
    elsewhere = np.concatenate(earlier).astype(bool) if earlier else np.zeros(0, dtype=bool)
    return (elsewhere[block.at] | (block.least[block.at] < block.ids[block.doc])) & ~block.missing[block.doc]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Text of each document: its words with one space between them."""
    sizes = ends - starts + 1  # and the space after it
    total = np.cumsum(sizes)
    source = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
    out = np.append(data, np.uint8(32))[source]
    out[total - 1] = 32
    whole = np.append(0, total)[offsets]
    some = np.diff(offsets) > 0  # the last space goes
    kept = np.ones(len(out), dtype=bool)
    kept[whole[1:][some] - 1] = False
    bounds = np.append(0, np.cumsum(np.diff(whole) - some))
    return pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[kept].tobytes())).cast(pa.string())


def _remove_from_block(texts: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    block = Block.of(texts, window)
    first, last = block.spans
    begin = block.starts[repeated_windows(block, answers, buckets)]
    edges = np.zeros(len(first) + 1, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    cut, end = tk.runs(gone, block.offsets)
    owner = np.searchsorted(block.offsets, cut, "right") - 1
    per_doc = np.searchsorted(cut, block.offsets).astype(np.int32)
    span = pa.StructArray.from_arrays([pa.array((x - block.offsets[owner]).astype(np.int32)) for x in (cut, end)], names=["start", "end"])
    kept = np.append(0, np.cumsum(~gone))[block.offsets]
    removed = np.diff(np.append(0, np.cumsum(gone))[block.offsets])
    columns = [
        block.table.column("doc"),
        pa.array(np.diff(block.offsets)),
        pa.array(removed),
        pa.ListArray.from_arrays(pa.array(per_doc), span),
        joined_words(block.data, first[~gone], last[~gone], kept),
    ]
    return pa.Table.from_arrays(columns, names=["doc", "n_words", "n_removed", "removed", "kept"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: SubstringParams = SubstringParams()) -> DataFrame:
    """Each document without the words that windows of earlier documents cover.

    Returns ``id_col`` (long), ``n_words``, ``n_removed``, ``removed`` (maximal intervals of word positions,
    ``start`` from 0, ``end`` one past the last) and ``kept`` (the words that are left, one space between
    them).  Words are maximal runs of characters outside ``\\x20`` and ``\\x09-\\x0D``, unchanged; a null or
    empty text has none.  Repeats within one document, and between rows that share an id, are not
    repeats of an earlier document.  A row without an id has none before it and is before none: it stays
    whole and removes nothing.  Documents shorter than a window stay whole; a very long text is read
    whole, within its block; other columns are ignored; an empty table gives an empty result.
    """
    sizes = LMParams(block_bytes=p.block_bytes, bucket_bytes=p.bucket_bytes)
    rows, buckets = in_blocks(docs, id_col, text_col, F.lit(True), sizes)
    rows = rows.select("block", F.col("doc").cast("long").alias("doc"), "text")
    asked = rows.mapInArrow(functools.partial(_ask_batches, buckets=buckets, window=p.window), ASKED)
    answers = materialise(asked.groupBy("bucket").applyInArrow(_answer_bucket, ANSWERS), "window-answers")
    schema = "doc long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept string"
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: _remove_from_block(left, right, p.window, buckets), schema)
    return found.withColumnRenamed("doc", id_col)
