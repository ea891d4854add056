"""Quality statistics, curve shards and the classifier chain, held against plain definitions."""

import math
import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import awkward, prose, words
from pyspark.sql import functions as F

from basinflow.llm import quality, sharding, textkit, toxicity

# --- quality ------------------------------------------------------------------------------------


def kind(byte):
    if byte >= 128:
        return "multibyte"
    c = chr(byte)
    for name, some in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", "0123456789"), ("blanks", " \t\x0b\x0c\r"), ("lines", "\n"), ("punctuation", "!',-.:;?")):
        if c in some:
            return name
    return "symbols"


def plain_statistics(text):
    """By name, one text after the other; every text has the ordinary bytes and words added to its own."""
    order = ["symbols", "lower", "upper", "digits", "multibyte", "blanks", "lines", "punctuation"]
    kinds = dict(zip(order, quality.PRIOR_BYTES, strict=True))
    for byte in (text or "").encode():
        kinds[kind(byte)] += 1
    share = {k: n / sum(kinds.values()) for k, n in kinds.items()}
    found = words(text)
    n = len(found) + quality.PRIOR_WORDS
    lengths = [len(w.encode()) for w in found]
    mean = (sum(lengths) + quality.PRIOR_WORDS * quality.PRIOR_LENGTH) / n
    square = (sum(x * x for x in lengths) + quality.PRIOR_WORDS * quality.PRIOR_SQUARE) / n
    pairs = Counter(zip(found, found[1:], strict=False))
    small = lambda x: math.log(x + 0.002)
    return {
        "log_words": math.log1p(len(found)),
        "word_length": math.log1p(mean),
        "word_length_spread": math.log1p(math.sqrt(max(square - mean * mean, 0))),
        "symbols": small(share["symbols"]),
        "lower": share["lower"],
        "upper": small(share["upper"]),
        "digits": small(share["digits"]),
        "multibyte": share["multibyte"],
        "blanks": share["blanks"],
        "lines": small(share["lines"]),
        "punctuation": small(share["punctuation"]),
        "distinct_words": (len(set(found)) + quality.PRIOR_DISTINCT * quality.PRIOR_WORDS) / n,
        "top_word": small((max(Counter(found).values(), default=0) + quality.PRIOR_TOP * quality.PRIOR_WORDS) / n),
        "repeated_pairs": small(sum(m - 1 for m in pairs.values()) / n),
        "symbol_ends": small(sum(kind(w.encode()[-1]) == "symbols" for w in found) / n),
    }


def test_statistics_follow_the_definition():
    rng = random.Random(21)
    signs = "abcXYZ019 \t\n\x0b\r.,;!?'-#$%é漢\x85\x1c"
    texts = [None, "", " \n", "one", "One one ONE one", "a b a b a b", "end# of$ each% word."]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 400))) for _ in range(200)] + [prose(rng, 300)]
    got = quality.statistics(pa.array(texts, type=pa.string()))
    want = [plain_statistics(t) for t in texts]
    assert got == pytest.approx(np.array([[w[name] for name in quality.STATISTICS] for w in want]))


def test_moments_follow_the_definition(spark):
    """The factors learned in Spark are those of all labelled rows, however they are dealt to tasks."""
    docs = awkward(spark).where("doc_id is not null and doc_id <> 3").repartition(7)
    stats = quality.document_statistics(docs)
    rows = {r.doc: np.array(r.x) for r in stats.collect()}
    marks = {i: int(i % 3 > 0) for i in rows}
    labels = spark.createDataFrame(list(marks.items()), "doc long, label int")
    model = quality.train(stats, labels)
    sums = []
    for label in (0, 1):
        x = np.array([[1.0, *rows[i]] for i in sorted(rows) if marks[i] == label])
        sums.append(x.T @ x)
    want = quality.fit_moments(np.array(sums), quality.QualityParams())
    assert model.scores(np.array(list(rows.values()))) == pytest.approx(want.scores(np.array(list(rows.values()))), rel=1e-6)


# --- sharding -----------------------------------------------------------------------------------


def plain_levels(values, levels):
    """The level of each value: how many split points lie below it.

    Numbers are split at the values of rank ceil(k * n / levels), strings at the values where the share of
    rows, in order of the values' bytes, passes another k / levels.
    """
    some = sorted(x.encode() if isinstance(x, str) else x for x in values if x is not None)
    if some and isinstance(some[0], bytes):
        points, before = [], 0
        for value, n in sorted(Counter(some).items()):
            points += [value] if before * levels // len(some) < (before + n) * levels // len(some) else []
            before += n
        points = points[: levels - 1]
    else:
        points = sorted({some[math.ceil(k * len(some) / levels) - 1] for k in range(1, levels)})
    return [0 if x is None else sum((x.encode() if isinstance(x, str) else x) > p for p in points) for x in values]


def test_shards_and_slots_follow_the_definition(spark):
    """Rows in order of the curve, salt, hash of the id and id; shards are runs of that order."""
    rng = random.Random(44)
    rows = [(k * 7919 - 300, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "ß", None]), rng.randint(0, 40) if rng.random() < 0.9 else None, rng.random()) for k in range(701)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id long, source string, size long, x double").repartition(5)
    dims, bits, shards = ["source", "size", "x"], 3, 8
    curve = {r.id: r["at"] for r in spark.range(1 << (3 * bits)).select("id", sharding.curve_index(F.col("id"), 3, bits).alias("at")).collect()}
    levels = [plain_levels([r[1 + d] for r in rows], 1 << bits) for d in range(3)]
    keyed = []
    for row, *at in zip(rows, *levels, strict=True):
        mixed = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", row[0]), seed=42)))[0]
        keyed.append((curve[sum(level << (bits * d) for d, level in enumerate(at))], mixed % 16, mixed, row[0]))
    want, total = [], len(rows)
    for rank, (index, _, _, name) in enumerate(sorted(keyed)):
        shard = rank * shards // total
        want.append((name, index, shard, rank - math.ceil(shard * total / shards)))
    placed = sharding.assign_shards(df, "id", dims, shards, bits=bits, accuracy=1 << 20).select("id", "curve_index", "shard", "slot")
    assert sorted(map(tuple, placed.collect())) == sorted(want)


@pytest.mark.parametrize("dims", [2, 3])
def test_the_curve_refines_itself(spark, dims):
    """A cell's place among finer cells begins with its place among the coarser ones, so ranges nest."""
    bits = 3
    fine = spark.range(1 << (dims * bits)).select("id", sharding.curve_index(F.col("id"), dims, bits).alias("at")).collect()
    coarse = {r.id: r["at"] for r in spark.range(1 << (dims * (bits - 1))).select("id", sharding.curve_index(F.col("id"), dims, bits - 1).alias("at")).collect()}
    for r in fine:
        place = [(r.id >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]
        assert r["at"] >> dims == coarse[sum((x >> 1) << ((bits - 1) * d) for d, x in enumerate(place))]


# --- toxicity -----------------------------------------------------------------------------------


def test_a_link_helps_the_next_where_labels_are_few():
    """A category known on many rows lends what it learned to one that is known on few."""
    rng = np.random.default_rng(5)
    n, size = 3000, 200
    words_of = np.array([rng.choice(size, 5, replace=False) for _ in range(n)])
    first = ((words_of < size // 2).sum(axis=1) >= 3).astype(float)
    second = np.where(rng.random(n) < 0.02, 1 - first, first)
    rows, cols = np.repeat(np.arange(n), 5), words_of.ravel()
    labels = np.column_stack([first, second])
    labels[2000:] = np.nan
    labels[80:, 1] = np.nan
    vocabulary, p = toxicity.Vocabulary(np.arange(size, dtype=np.uint64)), toxicity.ToxicityParams()
    fresh = rows >= 2000
    right = {}
    for name, some in (("chain", labels), ("alone", labels[:, 1:])):
        chain = toxicity.fit_chain(rows, cols, some, vocabulary, p)
        found = chain.probabilities(rows[fresh] - 2000, cols[fresh], n - 2000)[:, -1]
        right[name] = np.mean((found >= 0.5) == (second[2000:] == 1))
    assert right["chain"] > 0.9 and right["chain"] > right["alone"] + 0.1


def test_features_are_words_and_beginnings():
    texts = ["Idiotic fool, FOOL", None, "", "12 ab1cd", "éclair"]
    rows, features = toxicity.word_features(pa.array(texts), (5,))
    one = lambda w: textkit.span_hashes(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0]), np.array([len(w.encode())]))[0]
    begins = lambda w: textkit.mix64(np.array([one(w)]) + np.uint64(5))[0]
    want = [(0, one("idiotic")), (0, one("fool")), (0, one("fool")), (0, begins("idiot")), (3, one("ab")), (3, one("cd")), (4, one("éclair")), (4, begins("écla"))]
    assert sorted(zip(rows.tolist(), features.tolist(), strict=True)) == sorted((r, int(f)) for r, f in want)
