"""Awkward tables and plain-Python definitions that the operators are held against."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["doc", "node", "row", "rank", "shard", "slot", "size", "score", "held_out", "bucket", "label", "file", "key", "id", "hash", "c0"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def documents(spark, rows):
    """``doc_id, text, lang, source, n_chars`` and columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in EXTRA})


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


_rng = random.Random(1)
VOCABULARY = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randint(2, 8))) for _ in range(400)]


def awkward(spark):
    """Nulls, empties, one very long text, copies, repeated rows and rows without an id."""
    rng = random.Random(7)
    long = prose(rng, 120_000)
    rows = [(k, prose(rng, rng.randint(1, 60)), "en") for k in range(40)]
    rows += [(100, None, None), (101, "", "en"), (102, " \t\n", None), (103, "one", "en"), (104, long, "en"), (105, long, "de"), (106, "é ü 漢字 " * 30, "xx")]
    rows += [(3, rows[3][1], "en"), (None, rows[5][1], "en"), (None, None, None), (107, rows[5][1], "en"), (108, "!!! ??? 12", "en")]
    return documents(spark, rows)
