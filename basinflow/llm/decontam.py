"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The test items form an inverted index.  Document frequencies, mean length and impacts are worked out
over all items in Spark; impacts are scaled by each item's score of itself, so a passage that holds a
whole item scores 1 on it, and one threshold serves all items.  Documents are cut into overlapping
passages over their whole length.  For every passage all items above the threshold are found by
block-max WAND: a passage is dropped when the largest impacts of its words stay below the threshold
together; blocks of items are skipped where the sum of the words' block maxima does; in the others each
word has a cursor, the pivot is the first item at which the maxima of the cursors up to it reach the
threshold, and only an item that all those cursors have come to is scored.  The cursors of many passages
move together, on arrays.  Every bound is an upper bound, so no item above the threshold is lost.  A
retrieved (document, item) pair counts only if enough of the question's and of the answer's word runs
occur in the document passage, checked on the words themselves.

Items longer than a passage's overlap are indexed in segments.  Posting lists and block maxima are
stored sparsely.  The index is broadcast; where the items hold more words than ``pass_words``, it is cut
and each part gets a pass over the documents, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.sources.shared import materialise


@dataclass(frozen=True)
class DecontamParams:
    """Passages of ``passage`` words every ``stride`` words; items in segments of at most
    ``passage - stride`` words; ``threshold`` on the scaled score; ``run`` words per verified run, of
    which the shares ``question`` and ``answer`` must occur.  ``answer_part`` is the last share of
    an item's words that counts as its answer.  ``block`` segments share block maxima; items of about
    ``pass_words`` words are searched for in one pass.  ``k1`` and ``b`` are BM25's."""

    passage: int = 128
    stride: int = 64
    threshold: float = 0.5
    run: int = 3
    question: float = 0.6
    answer: float = 0.6
    answer_part: float = 0.3
    block: int = 8
    pass_words: int = 2_000_000
    k1: float = 1.2
    b: float = 0.75


@dataclass
class Segment:
    """A part of an item, and the whole item's length, question runs and answer runs, each as (words
    per run, distinct run hashes)."""

    item: int
    item_words: int
    parts: tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]


class ItemIndex:
    """Inverted index of item segments.

    Postings stand by term and then segment.  A term has an entry for each block of segments that holds
    it: the block, its first and end posting there, and the largest impact."""

    def __init__(self, segments: list[Segment], term: np.ndarray, segment: np.ndarray, impact: np.ndarray, p: DecontamParams) -> None:
        self.p, self.segments = p, segments
        order = np.lexsort((segment, term))
        self.docs, self.impacts = segment[order].astype(np.int32), impact[order]
        self.terms, at = np.unique(term[order], return_inverse=True)
        self.blocks = -(-len(segments) // p.block)
        place = at * np.int64(max(1, self.blocks)) + self.docs // p.block
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.entry_block, self.entry_first = (self.docs[first] // p.block).astype(np.int32), first
        self.entry_end = np.append(first[1:], len(place))
        self.entry_max = np.maximum.reduceat(self.impacts, first) if len(first) else np.zeros(0)
        self.starts = np.searchsorted(at[first], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.entry_max, self.starts[:-1]) if len(self.terms) else np.zeros(0)
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[(self.terms & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words that no item has."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0x3FFFF)).astype(np.int64)])
        if not len(self.terms):
            return out
        at = np.minimum(np.searchsorted(self.terms, hashes[some]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[some]
        out[some[hit]] = at[hit]
        return out

    def retrieve(self, passage: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, segment, scaled BM25) that reach the threshold, for passages 0 to ``count`` with
        their distinct (passage, term) pairs, in order of the passages."""
        least = self.p.threshold * (1 - 1e-9)
        able = np.bincount(passage, weights=self.term_max[term], minlength=count) >= least
        passage, term = passage[able[passage]], term[able[passage]]
        sizes = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(self.starts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pair = np.repeat(passage, sizes) * np.int64(self.blocks) + self.entry_block[entry]
        alive = np.bincount(pair, weights=self.entry_max[entry], minlength=count * self.blocks) >= least
        pair, entry = pair[alive[pair]], entry[alive[pair]]
        order = np.argsort(pair, kind="stable")
        where, lane = np.unique(pair[order], return_inverse=True)
        found = []
        for at in range(0, len(where), 4096):
            lo, hi = np.searchsorted(lane, [at, at + 4096])
            found += self._walk(lane[lo:hi] - at, entry[order[lo:hi]], least, at)
        lanes, segments, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
        keep = scores >= self.p.threshold
        return where[lanes[keep]] // self.blocks, segments[keep], scores[keep]

    def _walk(self, lane: np.ndarray, entry: np.ndarray, least: float, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cursors over the posting lists of each lane (a passage in one block), all lanes together."""
        if not len(lane):
            return
        width, starts = np.bincount(lane), np.searchsorted(lane, np.arange(lane[-1] + 1))
        column = np.arange(len(lane)) - starts[lane]
        shape = len(width), int(width.max())
        at, end, top = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), np.zeros(shape)
        at[lane, column], end[lane, column], top[lane, column] = self.entry_first[entry], self.entry_end[entry], self.entry_max[entry]
        rows, done = np.arange(len(width)), np.int32(len(self.segments))
        while len(rows):
            docs = np.where(at < end, self.docs[np.minimum(at, len(self.docs) - 1)], done)
            order = np.argsort(docs, axis=1, kind="stable")
            reached = np.cumsum(np.where(np.take_along_axis(docs, order, 1) < done, np.take_along_axis(top, order, 1), 0.0), axis=1) >= least
            pivot = np.take_along_axis(docs, np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1), 1)
            keep = reached[:, -1]
            rows, at, end, top, docs, pivot = rows[keep], at[keep], end[keep], top[keep], docs[keep], pivot[keep]
            if not len(rows):
                return
            behind, here = docs < pivot, docs == pivot
            meet = ~behind.any(axis=1)
            if meet.any():
                scores = np.where(here[meet], self.impacts[np.minimum(at[meet], len(self.impacts) - 1)], 0.0).sum(axis=1)
                yield rows[meet] + base, pivot[meet, 0].astype(np.int64), scores
            at += behind | (here & meet[:, None])


_SEGMENTS = "item long, part int, item_words int, words array<long>, question_n int, question array<long>, answer_n int, answer array<long>"


def _segment_batches(batches: Iterator[pa.RecordBatch], p: DecontamParams) -> Iterator[pa.RecordBatch]:
    """Items cut into segments; items without words are left out."""
    for batch in (part for whole in batches for part in tk.slices(whole, "text")):
        w = tk.words(batch.column(1))
        rows = []
        for item, lo, hi in zip(batch.column(0).to_pylist(), w.offsets[:-1], w.offsets[1:], strict=True):
            words = w.hashes[lo:hi]
            if not len(words):
                continue
            cut = len(words) - max(1, round(p.answer_part * len(words))) if len(words) > 1 else 0
            answer = _runs(words[cut:], p.run)
            question = _runs(words[:cut], p.run) if cut else answer
            for k, some in enumerate(np.array_split(words, -(-len(words) // (p.passage - p.stride)))):
                rows.append((item, k, len(words), some.view(np.int64), question[0], question[1].view(np.int64), answer[0], answer[1].view(np.int64)))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def item_segments(items: DataFrame, p: DecontamParams) -> tuple[DataFrame, int]:
    """The segments of ``items(item_id, text)``, numbered, and in how many passes they are searched for."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), "text")
    segments = rows.mapInArrow(lambda b: _segment_batches(b, p), _SEGMENTS).withColumn("segment", F.monotonically_increasing_id())
    segments = materialise(segments, "item-segments")
    words = segments.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    passes = max(1, -(-words // p.pass_words))
    return segments.withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(passes))), passes


def impacts(segments: DataFrame, p: DecontamParams) -> DataFrame:
    """``pass, segment, term, impact``: BM25 of each word of each segment, with document frequencies and
    mean length over all segments, as a share of what the segment scores on itself."""
    count, mean = segments.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    postings = segments.select("pass", "segment", F.size("words").alias("n"), F.explode("words").alias("term")).groupBy("pass", "segment", "n", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("n") / mean))
    weighted = postings.join(df, "term").select("pass", "segment", "term", weight.alias("weight"))
    own = weighted.groupBy("segment").agg(F.sum("weight").alias("own"))
    return materialise(weighted.join(own, "segment").select("pass", "segment", "term", (F.col("weight") / F.col("own")).alias("impact")), "item-impacts")


def item_index(segments: DataFrame, weights: DataFrame, p: DecontamParams) -> ItemIndex:
    """The index of the segments of one pass."""
    own = segments.orderBy("item", "part", "segment").toArrow()
    posted = weights.toArrow()
    numbers = own.column("segment").to_numpy()
    order = np.argsort(numbers)
    place = order[np.searchsorted(numbers[order], posted.column("segment").to_numpy())] if len(numbers) else np.zeros(0, dtype=np.int64)
    held = [
        Segment(r["item"], r["item_words"], tuple((r[f"{k}_n"], np.array(r[k], dtype=np.int64).view(np.uint64)) for k in ("question", "answer")))
        for r in own.drop_columns(["words"]).to_pylist()
    ]
    return ItemIndex(held, posted.column("term").to_numpy().view(np.uint64), place, posted.column("impact").to_numpy(), p)


def _runs(words: np.ndarray, run: int) -> tuple[int, np.ndarray]:
    n = min(run, len(words))
    return n, np.unique(tk.windows(words, n))


def candidates(w: tk.Words, index: ItemIndex) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, first word, end word, segment, score) of every passage and segment above the threshold."""
    p = index.p
    if not index.segments:
        return
    term = index.lookup(w.hashes)
    known = np.flatnonzero(term >= 0)
    counts = np.diff(w.offsets)
    passages = np.maximum(1, -(-(counts - p.stride) // p.stride)) * (counts > 0)
    row = np.repeat(np.arange(len(counts)), passages)
    nth = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(passages)[:-1]]), passages)
    lo = w.offsets[row] + nth * p.stride
    hi = np.minimum(lo + p.passage, w.offsets[row + 1])
    first, end = np.searchsorted(known, lo), np.searchsorted(known, hi)
    step = max(1, (4 << 20) // max(1, index.blocks))
    for at in range(0, len(row), min(step, 2048)):
        some = slice(at, at + min(step, 2048))
        sizes = end[some] - first[some]
        place = np.repeat(first[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * np.int64(len(index.terms)) + term[known[place]])
        for k, segment, score in zip(*index.retrieve(pairs // len(index.terms), pairs % len(index.terms), len(sizes)), strict=True):
            yield int(row[at + k]), int(lo[at + k]), int(hi[at + k]), int(segment), float(score)


def _match_batches(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    index: ItemIndex = held.value
    p = index.p
    for batch in batches:
        for part in tk.slices(batch, "text"):
            w = tk.words(part.column(1))
            best: dict[tuple[int, int], tuple] = {}
            for row, lo, hi, k, score in candidates(w, index):
                segment = index.segments[k]
                margin = max(p.passage, segment.item_words)
                near = w.hashes[max(w.offsets[row], lo - margin) : min(w.offsets[row + 1], hi + margin)]
                question, answer = (float(np.isin(runs, tk.windows(near, n)).mean()) for n, runs in segment.parts)
                old = best.get((row, segment.item))
                if question >= p.question and answer >= p.answer and (old is None or score > old[0]):
                    best[row, segment.item] = (score, question, answer, lo - w.offsets[row], hi - w.offsets[row])
            found = np.array(list(best.values()), dtype=float).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array([r for r, _ in best], type=pa.int64())),
                    pa.array([i for _, i in best], type=pa.int64()),
                    *(pa.array(x) for x in found[:3]),
                    *(pa.array(x.astype(np.int64)) for x in found[3:]),
                ],
                names=["doc", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "end_word"],
            )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: DecontamParams = DecontamParams()) -> DataFrame:
    """Verified (document, item) pairs: ``id_col, item_id, score`` (of the best passage),
    ``question_overlap, answer_overlap`` and that passage's ``first_word``, ``end_word``.

    ``items(item_id, text)`` are the test items.  Their last ``answer_part`` words are the answer; an
    item of one word has only an answer.  Items without an id or words match nothing; rows of items with
    one id are one item.  Null and empty texts match nothing; very long texts are searched whole; rows
    that repeat an id each give their pairs; other columns are ignored; empty tables give an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long, end_word long"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    segments, passes = item_segments(items, p)
    weights = impacts(segments, p)
    found = None
    for k in range(passes):
        held = docs.sparkSession.sparkContext.broadcast(item_index(*(t.where(F.col("pass") == k).drop("pass") for t in (segments, weights)), p))
        matched = rows.mapInArrow(lambda b, held=held: _match_batches(b, held), schema)
        found = matched if found is None else found.unionByName(matched)
    return found.withColumnRenamed("doc", id_col)
