"""Training sequences from whole documents, filled by lexical retrieval.

Documents are dealt to index shards by what they are about: each goes by its rarest word that still is
common enough to gather a good part of a shard, so documents that share such words meet from anywhere
in the table.  Each shard holds a BM25 inverted index of its documents, weighted by document frequencies
and the mean length of the whole table; the document at the head of a window is the query, and the
unused documents it retrieves fill the rest of the window, best first.  A document that does not fit is
cut: its rest opens the next window and becomes the query there.  What remains at the end of a shard is
cut into sequences whose lengths are powers of two, which need no padding; so no sequence is padded.

Document frequencies are counted by a hash of the word in a table of fixed size, which is what is
broadcast.  A word that would gather more than a shard is split by a hash of id and text.  Texts are
shuffled once; a task cuts its sorted rows into shards of ``shard_bytes`` of text (a longer document is a
shard of its own), however Arrow batches fall, so memory does not grow with the input.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.sources.shared import scan_bytes


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackParams:
    """``tokenizer`` is the vocabulary; ``ranks`` holds the same vocabulary as byte ranks, which
    give the same ids several times faster.  ``end_id`` closes every document.  A word gathers documents
    if it occurs in enough of them to fill ``gather`` of a shard, and they are dealt out in parts of a
    shard or ``part_rows`` documents.  ``slots`` (a power of two) is the size of
    the table of document frequencies.  ``k1`` and ``b`` are BM25's."""

    window: int = 2048
    tokenizer: str = field(default_factory=lambda: _tokenizer_file("byte_bpe_50k.json"))
    ranks: str = field(default_factory=lambda: _tokenizer_file("byte_bpe_50k.tiktoken"))
    end_id: int = 1
    shard_bytes: int = 4 << 20
    gather: float = 0.1
    part_rows: int = 512
    slots: int = 1 << 18
    k1: float = 1.2
    b: float = 0.75


#: The vocabulary's one special token; texts that hold its name go through ``tokenizers`` itself.
SPECIAL = "<|endoftext|>"


@functools.cache
def _fast_encoder(ranks: str):
    """The encoder, and how many bytes each id stands for."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
    sizes[list(table.values())] = [len(x) for x in table]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), sizes


@functools.cache
def _full_encoder(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


#: Last bytes that characters of white space beyond ASCII can have.
_WIDE_SPACE = [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]
_BEFORE_UNIT = ~tk.SPACE
_BEFORE_UNIT[[0x1C, 0x1D, 0x1E, 0x1F, *_WIDE_SPACE]] = False


def encode(texts: pa.Array, p: PackParams) -> list[np.ndarray]:
    """Token ids of each text (null: none), closed by the end id.

    The vocabulary's pattern never joins a space to what is not white space before it, so a text falls
    into units that begin with such a space, and equal units have equal ids.  The distinct units of
    all texts are encoded once, end to end; the bytes of each id tell where one unit's ids end.  What
    stands before a text's first such space is encoded by itself."""
    fast, sizes = _fast_encoder(p.ranks)
    data, bounds = tk.text_bytes(texts)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (data[1:] == 32) & _BEFORE_UNIT[data[:-1]]
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    starts = np.flatnonzero(cut)
    row = np.searchsorted(bounds, starts, "right") - 1
    per_row = np.searchsorted(starts, bounds)
    ends = np.append(starts[1:], len(data))
    ends = np.minimum(ends, bounds[row + 1])
    unit, distinct = tk.coded(tk.span_hashes(data, starts, ends))
    first = np.zeros(len(distinct), dtype=np.int64)
    first[unit] = np.arange(len(unit))
    lengths = ends[first] - starts[first]
    places = np.repeat(starts[first] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    ids = fast.encode_to_numpy(data[places].tobytes().decode(), disallowed_special=())
    at = np.concatenate([[0], np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(lengths)) + 1]) if len(ids) else np.zeros(1, dtype=np.int64)
    counts = np.diff(at)[unit]
    places = np.repeat(at[:-1][unit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    flat = ids[places].astype("<u4")
    upto = np.concatenate([[0], np.cumsum(counts)])[per_row]
    end, out = np.array([p.end_id], dtype="<u4"), []
    for k in range(len(texts)):
        whole = data[bounds[k] : bounds[k + 1]].tobytes().decode() if bounds[k] < bounds[k + 1] else ""
        if SPECIAL in whole:
            out.append(np.append(np.array(_full_encoder(p.tokenizer).encode(whole, add_special_tokens=False).ids, dtype="<u4"), end))
            continue
        head = data[bounds[k] : starts[per_row[k]] if per_row[k] < per_row[k + 1] else bounds[k + 1]].tobytes().decode()
        out.append(np.concatenate([fast.encode_to_numpy(head, disallowed_special=()).astype("<u4"), flat[upto[k] : upto[k + 1]], end]))
    return out


@dataclass
class Frequencies:
    """Of a whole table: documents and words, bytes of text, and documents by the hash of a word they hold."""

    docs: int
    words: int
    size: int
    by_slot: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.by_slot[(hashes & np.uint64(len(self.by_slot) - 1)).astype(np.int64)]


def distinct_slots(w: tk.Words, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot of a word), in order of the documents."""
    docs, mask = len(w.offsets) - 1, np.uint64(slots - 1)
    kind = np.uint32 if docs * slots < 1 << 32 else np.int64
    pair = np.repeat(np.arange(docs, dtype=kind) * kind(slots), np.diff(w.offsets)) + (w.hashes & mask).astype(kind)
    pair = tk.distinct(pair)
    return (pair >> kind(slots.bit_length() - 1)).astype(np.int64), (pair & kind(slots - 1)).astype(np.int64)


#: Neighbouring places of the table of counts that travel as one row.
_RUN = 4096


def _frequency_batches(batches: Iterator[pa.RecordBatch], p: PackParams) -> Iterator[pa.RecordBatch]:
    """One table of counts for each task, in runs; its first places after ``slots`` are documents, words and bytes."""
    total = np.zeros(-(-(p.slots + 3) // _RUN) * _RUN, dtype=np.int64)
    for batch in batches:
        for part in tk.slices(batch, "text"):
            w = tk.words(part.column(0))
            total[: p.slots] += np.bincount(distinct_slots(w, p.slots)[1], minlength=p.slots)
            total[p.slots : p.slots + 3] += part.num_rows, len(w.hashes), len(w.data)
    rows = total.reshape(-1, _RUN)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([x.tobytes() for x in rows], type=pa.binary())], names=["run", "counts"])


def _add_runs(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
    return pa.table({"run": table.column("run")[:1], "counts": pa.array([total.tobytes()], type=pa.binary())})


def frequencies(docs: DataFrame, text_col: str, p: PackParams) -> Frequencies:
    """Counts over all texts; a table of ``slots`` + 3 numbers reaches the driver."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _frequency_batches(b, p), "run long, counts binary")
    found = counted.groupBy("run").applyInArrow(_add_runs, "run long, counts binary").toArrow()
    runs = dict(zip(found.column("run").to_pylist(), found.column("counts").to_pylist(), strict=True))
    total = np.zeros(p.slots + 3, dtype=np.int64)
    for run, raw in runs.items():
        some = total[run * _RUN : (run + 1) * _RUN]
        some += np.frombuffer(raw, dtype=np.int64)[: len(some)]
    return Frequencies(*(int(x) for x in total[p.slots :]), total[: p.slots])


def routes(w: tk.Words, f: Frequencies, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """For each document the slot of its rarest word that gathers (-1: it has none), and in how many parts
    the documents of that word are dealt out."""
    n = len(w.offsets) - 1
    least = max(2.0, p.gather * p.shard_bytes * f.docs / max(1, f.size))
    doc, slot = distinct_slots(w, p.slots)
    df = f.by_slot[slot]
    some = df >= least
    doc, key = doc[some], df[some] * p.slots + slot[some]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    route, gathered = np.full(n, -1, dtype=np.int64), np.full(n, f.docs)
    rarest = np.minimum.reduceat(key, first) if len(first) else key
    route[doc[first]], gathered[doc[first]] = rarest % p.slots, rarest // p.slots
    rows = min(p.part_rows, max(1, p.shard_bytes * f.docs // max(1, f.size)))
    return route, np.maximum(1, -(-gathered // rows))


def _route_batches(batches: Iterator[pa.RecordBatch], held, p: PackParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            route, parts = routes(tk.words(part.column(1)), held.value, p)
            deal = part.column(2).to_numpy() & 0x7FFFFFFF
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(route), pa.array(deal % parts)], names=["doc", "text", "hash", "route", "part"])


class ShardIndex:
    """BM25 inverted index of one shard's documents, as flat posting arrays, with the table's statistics."""

    def __init__(self, w: tk.Words, f: Frequencies, p: PackParams) -> None:
        self.n = n = len(w.offsets) - 1
        code, hashes = tk.coded(w.hashes)
        order = np.argsort(hashes)
        hashes, rank = hashes[order], np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pair = rank[code] * n + w.doc
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        tf = np.diff(np.append(first, len(pair)))
        term, self.docs = np.divmod(pair[first], n) if n else (pair, pair)
        self.starts = np.searchsorted(term, np.arange(len(hashes) + 1))
        df = f.of(hashes)
        norm = p.k1 * (1 - p.b + p.b * np.diff(w.offsets) / max(1.0, f.words / max(1, f.docs)))
        self.weights = (np.log1p((f.docs - df + 0.5) / (df + 0.5))[term] * tf * (p.k1 + 1) / (tf + norm[self.docs])).astype(np.float32)
        by_doc = np.argsort(self.docs.astype(np.uint16) if n < 1 << 16 else self.docs, kind="stable")
        self.terms, self.doc_starts = term[by_doc], np.searchsorted(self.docs[by_doc], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the words of one of them."""
        terms = self.terms[self.doc_starts[doc] : self.doc_starts[doc + 1]]
        lo = self.starts[terms]
        counts = self.starts[terms + 1] - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(terms) else terms
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def fill(lengths: np.ndarray, index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token of a shard once."""
    used = np.zeros(len(lengths), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, room, upcoming = 0, window, 0
    neighbours: Iterator[int] = iter(())
    while True:
        doc = next((d for d in neighbours if not used[d]), None)
        if doc is None:
            while upcoming < len(used) and used[upcoming]:
                upcoming += 1
            if upcoming == len(used):
                break
            doc = upcoming
        used[doc] = True
        start, query = 0, room == window
        while start < lengths[doc]:
            take = min(room, int(lengths[doc]) - start)
            pieces.append((doc, start, take, sequence, window - room))
            start, room = start + take, room - take
            if not room:
                sequence, room, query = sequence + 1, window, True
        if query and room < window:
            scores = np.where(used, 0, index.scores(doc))
            found = np.flatnonzero(scores > 0)
            neighbours = iter(found[np.argsort(-scores[found], kind="stable")].tolist())
        elif room == window:
            neighbours = iter(())
    return split_tail(pieces, sequence, window - room)


def split_tail(pieces: list[tuple[int, int, int, int, int]], sequence: int, length: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last, incomplete sequence of ``length`` tokens into sequences of powers of two."""
    done = [x for x in pieces if x[3] != sequence]
    cuts = [0]
    while cuts[-1] < length:
        cuts.append(cuts[-1] + (1 << ((length - cuts[-1]).bit_length() - 1)))
    for doc, start, size, _, offset in pieces[len(done) :]:
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            a, b = max(lo, offset), min(hi, offset + size)
            if a < b:
                done.append((doc, start + a - offset, b - a, sequence + k, a - lo))
    return done


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``shard_bytes`` of text, wherever the batches end."""
    pieces: list[pa.RecordBatch] = []
    room = shard_bytes
    for batch in batches:
        ends, at, base = tk.offsets(batch.column(1))[1:], 0, int(tk.offsets(batch.column(1))[0]) if batch.num_rows else 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, base + room, "right"))
            if stop <= at and not pieces:
                stop = at + 1
            if stop > at:
                pieces.append(batch.slice(at, stop - at))
                room -= int(ends[stop - 1]) - base
                at, base = stop, int(ends[stop - 1])
            if at < batch.num_rows:
                yield pa.concat_batches(pieces)
                pieces, room = [], shard_bytes
    if pieces:
        yield pa.concat_batches(pieces)


def _pack_batches(batches: Iterator[pa.RecordBatch], held, p: PackParams) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 36
    for part in shards((b for b in batches if b.num_rows), p.shard_bytes):
        if part.num_rows:
            ids = encode(part.column(1), p)
            lengths = np.array([len(x) for x in ids])
            pieces = fill(lengths, ShardIndex(tk.words(part.column(1)), held.value, p), p.window)
            doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces], type=pa.binary()),
                    pa.array(lengths[doc]),
                    pa.array(base + sequence),
                    pa.array(offset),
                ],
                names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            base += int(sequence.max()) + 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: PackParams | None = None) -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens.

    Returns one row per piece: ``id_col``, ``start`` (its document's tokens before it), ``length``,
    ``ids`` (little-endian unsigned 32-bit token ids), ``doc_tokens``, ``sequence_id`` and ``offset``
    (place in the sequence).  Every token of every row lies in exactly one piece.  A null or empty
    text is the end id alone; a long text is cut across windows; repeated rows are packed each; other
    columns are ignored; an empty table gives no piece.  A retry of a task packs its rows in the same
    way.
    """
    p = p or PackParams()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    f = frequencies(docs, text_col, p)
    held = spark.sparkContext.broadcast(f)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    routed = rows.mapInArrow(lambda batches: _route_batches(batches, held, p), f"doc {kind}, text string, hash long, route long, part long")
    tasks = max(-(-f.size // scan_bytes(spark)), min(f.docs, 2 * spark.sparkContext.defaultParallelism), 1)
    dealt = routed.repartition(tasks, "route", "part").sortWithinPartitions("route", "part", "hash", "doc").select("doc", "text")
    schema = f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(lambda batches: _pack_batches(batches, held, p), schema).withColumnRenamed("doc", id_col)
