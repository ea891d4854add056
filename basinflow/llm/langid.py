"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to ``order`` bytes the counts
of the byte that followed it in training.  The code length of a byte is found from the longest
context, escaping to the next shorter one when the byte is new there: the escape probability is
distinct / (total + distinct), and what is escaped to leaves out the bytes already excluded.  The
statistics stay frozen while a text is scored; the language with the shortest code wins.

The trees of all languages are stored together and sparsely: for each order the (context, byte) pairs
that training has, with their bits in each language, and for each context the bits of its escape.
Frozen code lengths depend only on the last ``order`` bytes, so each distinct byte run of a slice of
texts is coded once: from the longest context down, escapes added up, until the pair is known.  Texts are coded after lower-casing A-Z and turning each run of other ASCII than letters
into one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk

ORDER = 3


@dataclass(frozen=True)
class LangParams:
    """``sample`` is the expected number of training texts of each language that has more: those whose
    hash of id and text lies below the share that they make up of all its texts.  Every context that
    they hold counts.  The broadcast model is bounded by the sample and the languages."""

    sample: int = 2000


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def normalised(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of all texts, each text preceded by ``ORDER`` spaces, and where each text's own start."""
    raw, bounds = tk.text_bytes(array)
    data = tk.LOWER[raw]
    letter = _LETTER[data]
    keep = letter.copy()
    if len(data):
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        before = np.concatenate([[False], letter[:-1]])
        before[first] = False
        keep |= before
    data = np.where(letter, data, np.uint8(32))[keep]
    sizes = np.concatenate([[0], np.cumsum(keep)])[bounds]
    sizes = np.diff(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)]) + ORDER * np.arange(1, len(sizes) + 2)
    out = np.full(int(sizes.sum()) + ORDER * len(sizes), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(sizes) + 1), sizes)] = data
    return out, np.stack([starts[:-1], starts[:-1] + sizes])


def _own_positions(spans: np.ndarray) -> np.ndarray:
    sizes = spans[1] - spans[0]
    return np.arange(sizes.sum()) + np.repeat(spans[0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at each place and the ``ORDER`` before it, the last in the lowest bits."""
    return sum(data[at - k].astype(np.int64) << (8 * k) for k in range(ORDER + 1))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            data, spans = normalised(part.column(0))
            at = _own_positions(spans)
            gram = grams_at(data, at)
            lang, names = part.column(1).dictionary_encode().indices.to_numpy(), part.column(1).dictionary_encode().dictionary
            key, n = np.unique((np.repeat(lang, spans[1] - spans[0]).astype(np.int64) << 32) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(key >> 32)), pa.array(key & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class Trees:
    """Training counts of byte runs of length ``ORDER`` + 1: ``grams``, and ``counts`` per language."""

    langs: list[str]
    grams: np.ndarray
    counts: np.ndarray


class Coder:
    """Bits of bytes after their contexts, for each language, from sparse trees.

    ``base`` holds the bits of each byte without a context.  For each longer order there are the sorted
    runs (context and byte) with their ``bits``, and the sorted contexts with the bits of an ``escape``."""

    def __init__(self, trees: Trees) -> None:
        self.langs = trees.langs
        seen = np.unique(np.append(trees.grams & 0xFF, 32))
        width = len(seen) + 1  # all other bytes count as one more
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        last = np.append(np.searchsorted(seen, trees.grams & 0xFF), [])
        counts = np.stack([np.bincount(last.astype(np.int64), weights=c, minlength=width) for c in trees.counts.T], axis=1)
        bits, _ = self._level(counts, np.full(counts.shape, 1.0 / width), np.zeros(1, dtype=np.int64), width)
        self.base = np.repeat(bits[-1:], 256, axis=0)
        self.base[seen] = bits[:-1]
        for order in range(1, ORDER + 1):
            runs, at = np.unique(trees.grams & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
            counts = np.stack([np.bincount(at, weights=c, minlength=len(runs)) for c in trees.counts.T], axis=1)
            contexts, starts = np.unique(runs >> 8, return_index=True)
            bits, escape = self._level(counts, np.exp2(-self.bits(runs).astype(float)), starts, width)
            self.levels.append((runs, bits, contexts, escape))

    @staticmethod
    def _level(counts: np.ndarray, shorter: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the pairs of some contexts, which begin at ``starts``, and of the contexts' escapes."""
        if not len(counts):
            return counts.astype(np.float32), counts.astype(np.float32)
        hit = counts > 0
        total, distinct, taken = (np.add.reduceat(x, starts, axis=0) for x in (counts, hit.astype(float), np.where(hit, shorter, 0)))
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / np.maximum(1 - taken, 1e-12), 1.0)
        each = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(counts))))
        size = total + np.where(distinct == width, 0, distinct)
        own = np.where(hit, counts / np.maximum(size, 1)[each], escape[each] * shorter)
        return -np.log2(own).astype(np.float32), -np.log2(escape).astype(np.float32)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after those before it, per language."""
        out = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(grams))
        for order in range(len(self.levels), 0, -1):
            runs, bits, contexts, escape = self.levels[order - 1]
            run = grams[todo] & ((1 << (8 * (order + 1))) - 1)
            at, hit = place(runs, run)
            out[todo[hit]] += bits[at[hit]]
            todo, run = todo[~hit], run[~hit]
            at, hit = place(contexts, run >> 8)
            out[todo[hit]] += escape[at[hit]]
        out[todo] += self.base[grams[todo] & 0xFF]
        return out


def place(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    coder = model.value
    names = pa.array(coder.langs)
    for batch in batches:
        for part in tk.slices(batch, "text", 2 << 20):
            data, spans = normalised(part.column(1))
            at = _own_positions(spans)
            grams, which = np.unique(grams_at(data, at), return_inverse=True)
            code = coder.bits(grams)[which]
            sizes = spans[1] - spans[0]
            ends = np.cumsum(sizes)
            lengths = np.zeros((len(sizes), len(coder.langs)))
            some = sizes > 0
            if some.any():
                lengths[some] = np.add.reduceat(code, (ends - sizes)[some], axis=0, dtype=np.float64)
            best = lengths.argmin(axis=1)
            share = 1 / np.exp2(np.clip(lengths.min(axis=1, keepdims=True) - lengths, -1000, 0)).sum(axis=1)
            known = part.column(2)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pc.if_else(known, names.take(pa.array(best)), "und"),
                    pc.if_else(known, pa.array(share), 0.0),
                    pa.array(np.where(sizes > 0, lengths.min(axis=1) / np.maximum(sizes, 1), 0.0)),
                ],
                names=["doc", "lang_pred", "score", "bits_per_byte"],
            )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", p: LangParams = LangParams()) -> Trees:
    """Learn from the rows of ``docs`` with a text and a language; none give a model without languages."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    shares = rows.groupBy(F.col(lang_col).alias("lang")).agg((F.lit(float(p.sample)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    texts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), place.alias("place"))
    texts = texts.join(F.broadcast(shares), "lang").where("place < share").select("text", "lang")  # one row per language, as in the model
    counted = texts.mapInArrow(_gram_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > 0).orderBy("gram", "lang").toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    grams, at = np.unique(found.column("gram").to_numpy(), return_inverse=True)
    counts = np.zeros((len(grams), len(names)))
    lang = np.searchsorted(np.array(names), np.array(found.column("lang").to_pylist())) if names else []
    counts[at, lang] = found.column("n").to_numpy()
    return Trees(names, grams, counts)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``lang_pred``, ``score`` (its posterior under equal priors) and ``bits_per_byte``.

    A text that is null or has no letter gets ``und`` with score 0, as does every text when no
    language was learned.  Ties go to the alphabetically first language; repeated rows come back each;
    very long texts are coded whole; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(trees.langs))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), known.alias("known"))
    held = trees if trees.langs else Trees(["und"], np.zeros(0, dtype=np.int64), np.zeros((0, 1)))
    model = docs.sparkSession.sparkContext.broadcast(Coder(held))
    return rows.mapInArrow(lambda b: _score_batches(b, model), f"doc {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("doc", id_col)
