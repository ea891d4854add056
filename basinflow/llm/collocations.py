"""Phrases whose words occur together more often than their parts would suggest.

Texts are cut at punctuation and line ends into pieces, pieces into words, and everything is counted per
language.  Documents form blocks (runs of rows of one file).  A block numbers its words, sorts the
suffixes of its pieces by prefix doubling, to the depth of the longest phrase, and reads off the common
prefixes of neighbours; each interval of them is one n-gram with its count.  Blocks send n-grams of all
lengths, as sorted hashes with counts, to buckets by ranges of the hash; a bucket adds up what the
blocks counted.  No n-gram is pruned before its counts have met.  For those that are frequent in the whole
corpus one of the blocks is asked for the words; it is the block with the smallest number that has them,
so few blocks are read again, and none is asked for more n-grams than it has.

What follows is joins on the table of frequent n-grams: counts of both sides of each cut, the lowest score
of the cuts, and the longer phrases that contain a phrase.  n-grams are told apart by 62-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm import textkit as tk
from basinflow.llm.lm import LMParams, block_runs, bucket_of, in_blocks, pack_counts, pack_keys, unpack, unpack_keys
from basinflow.sources.shared import materialise

#: Bytes that end a piece, and all bytes that are in no word.
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = PIECE_END.copy()
BETWEEN[[0x09, 0x20]] = True
#: The low bits of an n-gram's key hold its length less one.
LENGTH_BITS = np.uint64(3)
UNKNOWN = "und"


@dataclass(frozen=True)
class CollocationParams:
    """``longest`` phrase in words (2 to 4); phrases occur ``least`` times or more; a phrase goes where a longer
    one with it has ``contained`` percent of its occurrences; ``top`` phrases a language are returned.
    Blocks hold about ``block_bytes`` of text, buckets the n-grams of about ``bucket_bytes``; ``salts`` parts of a
    language are ranked before the whole."""

    longest: int = 4
    least: int = 30
    contained: int = 80
    top: int = 2000
    block_bytes: int = 4 << 20
    bucket_bytes: int = 3 << 20
    salts: int = 16


def suffix_order(words: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words, and the length of the prefix that each shares
    with the one before it, counted to ``depth`` words.

    ``left`` is the number of words from each place to the end of its piece, which no suffix crosses.
    Words are numbered, then pairs of ranks are: each round doubles the words that a rank tells apart.
    """
    rank = np.unique(words, return_inverse=True)[1] + 1
    levels, size = [(1, rank)], 1
    while size < depth:
        far = np.flatnonzero(left > size)
        after = np.zeros(len(rank), dtype=np.int64)
        after[far] = rank[far + size]
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
        size *= 2
        levels.append((size, rank))
    order = np.argsort(rank, kind="stable")
    here, there = order[1:], order[:-1]
    shared = np.zeros(len(here), dtype=np.int64)
    for size, rank in reversed(levels):
        far = np.flatnonzero((left[here] > shared) & (left[there] > shared))
        far = far[rank[here[far] + shared[far]] == rank[there[far] + shared[far]]]
        shared[far] = np.minimum(shared[far] + size, left[here[far]])
    return order, np.append(0, np.minimum(shared, depth))[: len(order)]


@dataclass
class Shard:
    """The n-grams of a block: sorted ``keys``, the first place and the number of occurrences of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    left: np.ndarray
    doc: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(table: pa.Table, longest: int) -> Shard:
        table = table.combine_chunks()
        texts = table.column("text").chunk(0) if table.num_rows else pa.array([], type=pa.string())
        raw, bounds = tk.text_bytes(texts)
        data = tk.LOWER[raw]
        starts, ends = tk.runs(~BETWEEN[data], bounds)
        doc = np.searchsorted(bounds, starts, "right") - 1
        langs = table.column("lang").chunk(0) if table.num_rows else pa.array([], type=pa.string())
        named, at = tk.text_bytes(langs)
        tongue = tk.mix64(tk.span_hashes(named, at[:-1], at[1:]) * tk.MIX[2])
        words = tk.mix64(tk.span_hashes(data, starts, ends) ^ tongue[doc])
        marks = np.cumsum(PIECE_END[data])[starts] if len(starts) else starts
        ending = np.flatnonzero(np.append((np.diff(marks) > 0) | (np.diff(doc) > 0), True)) if len(starts) else starts
        left = ending[np.searchsorted(ending, np.arange(len(starts)))] - np.arange(len(starts)) + 1
        order, shared = suffix_order(words, left, longest)
        keys, places, counts = [], [], []
        key = words
        for n in range(1, longest + 1):
            if n > 1:
                key = tk.mix64(key[:-1] * tk.MIX[0] + words[n - 1 :])
            first = np.flatnonzero(shared < n)
            size, place = np.diff(np.append(first, len(order))), order[first]
            long = left[place] >= n
            keys.append((key[place[long]] & ~LENGTH_BITS) | np.uint64(n - 1))
            places.append(place[long])
            counts.append(size[long])
        keys, places, counts = (np.concatenate(x) for x in (keys, places, counts))
        by = np.argsort(keys, kind="stable")
        return Shard(data, starts, ends, words, left, doc, keys[by], places[by], counts[by])


ASKED = "bucket int, block long, keys binary, counts binary, langs array<struct<lang: string, n: long>>"
FREQUENT = "block long, keys binary, counts binary, langs array<struct<lang: string, n: long>>"
_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))


def _ask_batches(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each block and their counts, by bucket; the first row has the block's words by language."""
    for number, table in block_runs(batches):
        shard = Shard.of(table, longest)
        if not len(shard.keys):
            continue
        bucket = bucket_of(shard.keys, buckets)
        found, starts = np.unique(bucket, return_index=True)
        cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]
        sizes = pa.table({"lang": table.column("lang"), "n": np.bincount(shard.doc, minlength=table.num_rows)}).group_by("lang").aggregate([("n", "sum")])
        langs = [{"lang": a, "n": b} for a, b in zip(sizes.column("lang").to_pylist(), sizes.column("n_sum").to_pylist(), strict=True)]
        columns = [found, np.full(len(found), number, dtype=np.int64), [pack_keys(shard.keys[c]) for c in cuts], [pack_counts(shard.counts[c]) for c in cuts], [langs, *[None] * (len(found) - 1)]]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), _LANGS)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "keys", "counts", "langs"])


def _count_bucket(table: pa.Table, least: int) -> pa.Table:
    """The n-grams of a bucket that occur ``least`` times or more, each in the row of one block that has it."""
    blocks, place = np.unique(table.column("block").to_numpy(), return_inverse=True)
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = [unpack(x.as_py()) for x in table.column("counts")]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    owner = np.full(len(found), len(blocks))
    np.minimum.at(owner, at, np.repeat(place, [len(k) for k in keys]))
    langs = [x for x in table.column("langs").to_pylist() if x]
    rows = [(int(blocks[k]), found[mine], total[mine]) for k in range(len(blocks)) if (mine := (owner == k) & (total >= least)).any()]
    numbers = [r[0] for r in rows] + [None] * len(langs)
    columns = [numbers, [pack_keys(r[1]) for r in rows] + [None] * len(langs), [pack_counts(r[2]) for r in rows] + [None] * len(langs), [None] * len(rows) + langs]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), _LANGS), strict=True)], names=["block", "keys", "counts", "langs"])


PHRASES = "lang string, key long, words int, f long, phrase string, firsts array<long>, rests array<long>, inner array<long>"


def parts_of(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Every (offset, length) of a part of a phrase, as two arrays."""
    return tuple(np.array(x) for x in zip(*[(at, n) for n in range(1, longest + 1) for at in range(longest - n + 1)], strict=True))


def _name_phrases(texts: pa.Table, asked: pa.Table, longest: int) -> pa.Table:
    """Words and parts of the n-grams that a block was asked for."""
    shard = Shard.of(texts, longest)
    keys = np.concatenate([unpack_keys(x.as_py()) for x in asked.column("keys")])
    f = np.concatenate([unpack(x.as_py()).astype(np.int64) for x in asked.column("counts")])
    place = shard.places[np.searchsorted(shard.keys, keys)]
    words = (keys & LENGTH_BITS).astype(np.int64) + 1
    langs = texts.column("lang").to_pylist()

    def key_at(places: np.ndarray, n: int) -> np.ndarray:
        key = shard.words[places]
        for k in range(1, n):
            key = tk.mix64(key * tk.MIX[0] + shard.words[places + k])
        return ((key & ~LENGTH_BITS) | np.uint64(n - 1)).view(np.int64)

    out = []
    for n in np.unique(words).tolist():
        mine = np.flatnonzero(words == n)
        at = place[mine]
        part = {(a, m): key_at(at + a, m) for m in range(1, n) for a in range(n - m + 1)}
        pieces = [[shard.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(shard.starts[at + k], shard.ends[at + k], strict=True)] for k in range(n)]
        lists = [[part[0, k] for k in range(1, n)], [part[k, n - k] for k in range(1, n)], [v for (_, m), v in part.items() if m > 1]]
        arrays = [pa.array(list(np.stack(x, axis=1)) if x else [[]] * len(mine), type=pa.list_(pa.int64())) for x in lists]
        named = [langs[d] for d in shard.doc[at]]
        out.append(pa.Table.from_arrays([pa.array(named, type=pa.string()), pa.array(keys[mine].view(np.int64)), pa.array(np.full(len(mine), n, dtype=np.int32)), pa.array(f[mine]), pa.array([" ".join(x) for x in zip(*pieces, strict=True)]), *arrays], names=["lang", "key", "words", "f", "phrase", "firsts", "rests", "inner"]))
    return pa.concat_tables(out)


def frequent_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", p: CollocationParams = CollocationParams()) -> tuple[DataFrame, DataFrame]:
    """``phrases(lang, key, words, f, phrase, firsts, rests, inner)``: n-grams of 1 to ``longest`` words that occur
    ``least`` times or more in their language, with the keys of both sides of each cut and of all parts of two
    words or more; and ``sizes(lang, n)``, the words of each language that has any.

    A null language is ``und``; a null or empty text has no words; a very long text is read whole, within its
    block; repeated rows count each; other columns are ignored; an empty table gives empty results.
    """
    if not 2 <= p.longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    rows, buckets = in_blocks(docs, lang_col, text_col, F.lit(True), LMParams(block_bytes=p.block_bytes, bucket_bytes=p.bucket_bytes))
    rows = rows.select("block", F.coalesce(F.col("doc").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    asked = rows.mapInArrow(functools.partial(_ask_batches, buckets=buckets, longest=p.longest), ASKED)
    counted = materialise(asked.groupBy("bucket").applyInArrow(lambda t: _count_bucket(t, p.least), FREQUENT), "ngrams")
    sizes = counted.where("langs is not null").select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).where("n > 0")
    owned = counted.where("block is not null").select("block", "keys", "counts")
    texts = rows.join(owned.select("block").distinct(), "block", "left_semi").select("block", "lang", "text")
    named = texts.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(lambda left, right: _name_phrases(left, right, p.longest), PHRASES)
    return materialise(named, "phrases"), sizes


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, key, words, phrase, a, l, r, score`` of the phrases of two words and more: the cut with the lowest
    score floor(2000000 * a / (l + r)), ties to the earliest."""
    counts = phrases.select("key", "f")
    cuts = phrases.where("words > 1").select("key", F.col("f").alias("a"), F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut"))
    cuts = cuts.select("key", "a", "k", "cut.firsts", "cut.rests")
    cuts = cuts.join(counts.select(F.col("key").alias("firsts"), F.col("f").alias("l")), "firsts")
    cuts = cuts.join(counts.select(F.col("key").alias("rests"), F.col("f").alias("r")), "rests")
    exact = F.expr("cast(cast(a as decimal(30, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as long)")
    lowest = cuts.withColumn("score", exact).groupBy("key").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    return phrases.select("lang", "key", "words", "phrase", F.col("f").alias("a")).join(lowest, "key").select("lang", "key", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def within_longer(phrases: DataFrame) -> DataFrame:
    """``key, longer``: the most occurrences of a longer phrase that contains each phrase."""
    longer = phrases.where("words > 2").select(F.explode("inner").alias("key"), "f")
    return longer.groupBy("key").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", p: CollocationParams = CollocationParams()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases, by score, then
    occurrences (both falling), then the phrase in the order of its bytes.

    Phrases that a longer one covers in ``contained`` percent of their occurrences are left out, whether or not
    that one is left out itself.  Rows are used as in :func:`frequent_ngrams`.
    """
    phrases, sizes = frequent_ngrams(docs, lang_col, text_col, p)
    rows = scored(phrases).join(within_longer(phrases), "key", "left")
    covered = F.lit(100) * F.col("longer").cast("decimal(20, 0)") >= F.lit(p.contained) * F.col("a").cast("decimal(20, 0)")
    rows = rows.where(~F.coalesce(covered, F.lit(False))).withColumn("salt", F.pmod("key", F.lit(p.salts)))
    for groups in (["lang", "salt"], ["lang"]):
        best = Window.partitionBy(*groups).orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= p.top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
