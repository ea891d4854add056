"""Language-model scores from a weighted backoff automaton over n-grams of the whole corpus.

States are the contexts that training has: the empty one, words, and pairs of words for order 3.  A
state has one arc for each n-gram that continues it, weighted with its smoothed log-probability, and
a failure arc to the context one word shorter, weighted with the share of probability left for what
the state has no arc for.  A text is read once from left to right: at each token the automaton
follows failure arcs until the state has an arc for the token, adds up the weights, and moves to the
arc's target, the longest suffix read so far that is a state.

Smoothing interpolates each order with the next shorter one in the manner of Witten and Bell: a
context seen n times leaves the share T / (n + T) to the shorter one, where T, the number of different
words that follow it, is taken by Heaps' law from n alone.  So counts are all that the model needs.

The model grows with the corpus and is never held whole anywhere.  Documents form blocks (runs of
rows of one file).  Each block sends its distinct n-grams of all orders, as sorted hashes with its own
training counts, to buckets by ranges of the hash; a bucket adds up what the blocks counted and
answers each block with the totals of its n-grams, in their order.  Rows between blocks and buckets
hold thousands of n-grams each and are never more than there are n-grams.  A block then meets its
answers, builds the part of the automaton that its texts can reach, and reads them.  Every n-gram
of training counts; none is pruned.  n-grams are told apart by 61-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.sources.shared import materialise

#: The hash of the token that ends every text and stands before its first word.
END = np.uint64(0x51A9C0DE5EED0E4D)
#: The low bits of an n-gram's key, which hold its order.
ORDER_BITS = np.uint64(7)


@dataclass(frozen=True)
class LMParams:
    """``order`` (at most 7) of the longest n-grams; a context seen n times is taken to have
    ``types_scale * n ** types_power`` different continuations.  Blocks hold about ``block_bytes`` of
    text, buckets the n-grams of about ``bucket_bytes``; ``lane`` tokens of a text are read in one lane."""

    order: int = 3
    types_scale: float = 2.0
    types_power: float = 0.85
    block_bytes: int = 6 << 20
    bucket_bytes: int = 8 << 20
    lane: int = 512


def sequences(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each as END, words, END; and where each text begins."""
    docs = len(w.offsets) - 1
    out = np.full(len(w.hashes) + 2 * docs, END, dtype=np.uint64)
    out[np.arange(len(w.hashes)) + 2 * w.doc + 1] = w.hashes
    return out, w.offsets[:-1] + 2 * np.arange(docs)


@dataclass
class Grams:
    """The n-grams of some texts: sorted distinct ``keys``, and ``at[m - 1]``, the place in them of the
    n-gram of order m that ends at each token, or ``len(keys)`` where the text has begun too late."""

    keys: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, begins: np.ndarray, order: int) -> Grams:
        size = len(tokens)
        depth = np.arange(size) - np.repeat(begins, np.diff(np.append(begins, size)))
        every, valid, key = [], [], tokens
        for m in range(1, order + 1):
            if m > 1:
                key = np.concatenate([key[:1], tk.mix64(key[:-1] * tk.MIX[0] + tokens[1:])])
            valid.append(depth >= m - 1)
            every.append((key[valid[-1]] & ~ORDER_BITS) | np.uint64(m))
        ends = np.cumsum([len(x) for x in every])[:-1]
        keys, inverse = np.unique(np.concatenate(every), return_inverse=True)
        at = np.full((order, size), len(keys), dtype=np.int32)
        for row, some, found in zip(at, valid, np.split(inverse, ends), strict=True):
            row[some] = found
        return Grams(keys, at)

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """How often the tokens that are ``counted`` end each n-gram."""
        total = np.zeros(len(self.keys) + 1, dtype=np.int64)
        for row in self.at:
            total += np.bincount(row[counted], minlength=len(total))
        return total[:-1]


class Automaton:
    """States and arcs over the n-grams of some texts.

    An n-gram stands for its arc (from the state of all but its last word) and, where it is shorter
    than ``order``, for the state that it is; ``root``, one past the last n-gram, is the empty context.
    ``weight`` is the arc's log10 probability, ``target`` the state it leads to, ``backoff`` the
    log10 weight of the state's failure arc and ``shorter`` the state that leads to.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, total: int, distinct: int, p: LMParams) -> None:
        self.grams, self.p, self.root = grams, p, len(grams.keys)
        self.counts = np.append(counts, 0)
        n = len(self.counts)
        context, suffix = (np.full(n, self.root, dtype=np.int32) for _ in range(2))
        for m in range(1, p.order):
            context[grams.at[m][1:]] = grams.at[m - 1][:-1]
            suffix[grams.at[m][1:]] = grams.at[m - 1][1:]
        context[self.root] = suffix[self.root] = self.root
        kind = np.append(grams.keys & ORDER_BITS, 0).astype(np.int8)
        types = p.types_scale * self.counts.astype(float) ** p.types_power
        chance = (self.counts + 1.0) / (total + distinct + 1.0)
        for m in range(2, p.order + 1):
            own = np.flatnonzero((kind == m) & (self.counts > 0))
            size, spread = self.counts[context[own]], types[context[own]]
            chance[own] = (self.counts[own] + spread * chance[suffix[own]]) / (size + spread)
        self.weight = np.log10(chance)
        state = (self.counts > 0) & (kind < p.order)
        self.backoff = np.log10(np.where(state, types / np.maximum(self.counts + types, 1), 1.0))
        self.shorter = np.where(kind > 1, suffix, np.int32(self.root))
        self.target = np.where(state, np.arange(n, dtype=np.int32), np.where(kind == p.order, suffix, np.int32(self.root)))
        self.length = np.where(state, kind, np.int8(0))

    def entered(self, places: np.ndarray) -> np.ndarray:
        """The state after the token at each place: as orders are bounded, it follows from the last tokens alone."""
        out = np.full(len(places), self.root, dtype=np.int32)
        for m in range(1, self.p.order):
            found = self.grams.at[m - 1][places]
            out = np.where(self.counts[found] > 0, found, out)
        return out

    def read(self, begins: np.ndarray, size: int) -> np.ndarray:
        """Log10 probability of each token, zero at the ``begins`` of texts.

        All texts are read together, in lanes of at most ``lane`` tokens; a lane that goes on with a
        text starts in the state in which the one before it ends."""
        lengths = np.diff(np.append(begins, size)) - 1
        lanes = -(-lengths // self.p.lane)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(begins + 1, lanes) + nth * self.p.lane
        left = np.minimum(np.repeat(lengths, lanes) - nth * self.p.lane, self.p.lane)
        order = np.argsort(-left, kind="stable")
        start, left = start[order], left[order]
        state, out = self.entered(start - 1), np.zeros(size)
        for step in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left, -step, "left"))
            place, here = start[:active] + step, state[:active]
            log = np.zeros(active)
            arc = self.grams.at[self.length[here], place]
            failing = np.flatnonzero((self.counts[arc] == 0) & (here != self.root))
            while len(failing):
                log[failing] += self.backoff[here[failing]]
                here[failing] = self.shorter[here[failing]]
                arc[failing] = self.grams.at[self.length[here[failing]], place[failing]]
                failing = failing[(self.counts[arc[failing]] == 0) & (here[failing] != self.root)]
            out[place] = log + self.weight[arc]
            state[:active] = self.target[arc]
        return out


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart; the first byte tells the width of an element."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).data)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds the largest of them."""
    return pack(values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0)))


# --- blocks -------------------------------------------------------------------------------------


def in_blocks(docs: DataFrame, id_col: str, text_col: str, train: F.Column, p: LMParams) -> tuple[DataFrame, int]:
    """Rows ``(block, train, doc, text)`` and the number of buckets for them.

    A block is a run of rows of one file, the same in every later pass however the scan is split.
    A table that does not come straight from files is written to the shared folder first.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    place = ("_metadata.file_path", "_metadata.row_index")
    try:
        rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.col(place[0]).alias("file"), F.col(place[1]).alias("row"))
    except AnalysisException:
        rows = materialise(rows, "lm-docs").select("*", F.col(place[0]).alias("file"), F.col(place[1]).alias("row"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    per_block = max(1, int(p.block_bytes * count / max(size, 1)))
    block = F.xxhash64("file", F.expr(f"row div {per_block}"))
    return rows.select(block.alias("block"), "train", "doc", "text"), max(1, -(-size // p.bucket_bytes))


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of one block, together."""
    now, pieces = None, []
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if pieces and block[lo] != now:
                yield int(now), pa.Table.from_batches(pieces)
                pieces = []
            now = block[lo]
            pieces.append(batch.slice(lo, hi - lo))
    if pieces:
        yield int(now), pa.Table.from_batches(pieces)


def block_tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sequences` of all texts of a block, a few megabytes at a time."""
    tokens, begins, size = [], [], 0
    for chunk in texts.chunks:
        for part in tk.slices(pa.record_batch([chunk], names=["text"]), "text", 2 << 20):
            some, at = sequences(tk.words(part.column(0)))
            tokens.append(some)
            begins.append(at + size)
            size += len(some)
    return (np.concatenate(tokens), np.concatenate(begins)) if tokens else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key, in order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


ASKED = "bucket int, block long, keys binary, counts binary"
ANSWERS = "block long, bucket int, counts binary, tokens long, types long"


def _ask_batches(batches: Iterator[pa.RecordBatch], buckets: int, p: LMParams) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each block and how often its training texts have them, by bucket."""
    for block, table in block_runs(batches):
        tokens, begins = block_tokens(table.column("text"))
        grams = Grams.of(tokens, begins, p.order)
        counted = np.repeat(table.column("train").to_numpy(), np.diff(np.append(begins, len(tokens))))
        counted[begins] = False
        counts, bucket = grams.counts(counted), bucket_of(grams.keys, buckets)
        found, starts = np.unique(bucket, return_index=True)
        ends = [*starts[1:].tolist(), len(bucket)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found),
                pa.array(np.full(len(found), block, dtype=np.int64)),
                pa.array([pack_keys(grams.keys[a:b]) for a, b in zip(starts, ends, strict=True)], type=pa.binary()),
                pa.array([pack_counts(counts[a:b]) for a, b in zip(starts, ends, strict=True)], type=pa.binary()),
            ],
            names=["bucket", "block", "keys", "counts"],
        )


def _answer_bucket(table: pa.Table) -> pa.Table:
    """The totals of a bucket's n-grams for each block that asked, in the order of the keys.

    Tasks that share a block (the scan may split it) are one block here.  The first row also tells how
    many training tokens, and how many different ones, the bucket has."""
    bucket = table.column("bucket")[0].as_py()
    blocks, place = np.unique(table.column("block").to_numpy(), return_inverse=True)
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = [unpack(x.as_py()) for x in table.column("counts")]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    ends = np.cumsum([0] + [len(x) for x in keys])
    answers = []
    for k in range(len(blocks)):
        mine = [at[ends[r] : ends[r + 1]] for r in np.flatnonzero(place == k)]
        answers.append(pack_counts(total[mine[0] if len(mine) == 1 else np.unique(np.concatenate(mine))]))
    words = total[(found & ORDER_BITS) == 1]
    rest = [None] * (len(blocks) - 1)
    columns = [blocks, np.full(len(blocks), bucket, dtype=np.int32), answers, [int(words.sum()), *rest], [int(np.count_nonzero(words)), *rest]]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "bucket", "counts", "tokens", "types"])


def _score_block(texts: pa.Table, answers: pa.Table, total: int, distinct: int, p: LMParams) -> pa.Table:
    """Scores of a block's texts by the part of the automaton that the answers to it make up."""
    tokens, begins = block_tokens(texts.column("text"))
    grams = Grams.of(tokens, begins, p.order)
    ordered = answers.sort_by("bucket").column("counts")
    counts = np.concatenate([unpack(x.as_py()).astype(np.int64) for x in ordered] or [np.zeros(0, dtype=np.int64)])
    machine = Automaton(grams, counts, total, distinct, p)
    own = np.ones(len(tokens), dtype=bool)
    own[begins] = False
    sums = (lambda x: np.add.reduceat(x, begins)) if len(begins) else (lambda x: x)
    word = grams.at[0]
    columns = [sums(own.astype(np.int64)), sums((own & (machine.counts[word] > 0)).astype(np.int64)), np.full(len(begins), total, dtype=np.int64), sums(np.where(own, machine.weight[word], 0.0)), sums(machine.read(begins, len(tokens)))]
    return pa.Table.from_arrays([texts.column("doc"), *(pa.array(c) for c in columns)], names=["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", p: LMParams = LMParams()) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row.

    Returns ``id_col, n_tokens`` (words and one end), ``n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (log10 under add-one unigrams) and ``score`` (log10 under the
    automaton).  A null or empty text is the end token alone.  A null ``train`` counts as false;
    without training rows every token has probability 1.  Repeated rows count and come back each; a
    very long text is read whole, within its block; other columns are ignored; an empty table gives an
    empty result.
    """
    rows, buckets = in_blocks(docs, id_col, text_col, train, p)
    asked = rows.mapInArrow(functools.partial(_ask_batches, buckets=buckets, p=p), ASKED)
    answers = materialise(asked.groupBy("bucket").applyInArrow(_answer_bucket, ANSWERS), "lm-answers")
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = rows.select("block", "doc", "text").groupBy("block")
    scored = texts.cogroup(answers.select("block", "bucket", "counts").groupBy("block")).applyInArrow(lambda left, right: _score_block(left, right, total, distinct, p), schema)
    return scored.withColumnRenamed("doc", id_col)
