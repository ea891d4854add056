"""Substring removal, collocations and exact whitening against plain definitions, and awkward tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinflow.llm import collocations, substrings, whitening
from basinflow.llm.collocations import CollocationParams
from basinflow.llm.substrings import SubstringParams
from tests.llm.helpers import WORD, awkward, documents, lower, prose

# --- substrings ---------------------------------------------------------------------------------

SMALL_BLOCKS = SubstringParams(block_bytes=3000, bucket_bytes=5000)


def plain_removal(rows, n=13):
    """``{(id, text): (words, removed, kept)}`` by the definition."""
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, ws in texts:
        for k in range(len(ws) - n + 1) if i is not None else ():
            w = tuple(ws[k : k + n])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, ws in texts:
        gone = set()
        for k in range(len(ws) - n + 1) if i is not None else ():
            if first[tuple(ws[k : k + n])] < i:
                gone |= set(range(k, k + n))
        spans = [k for k in range(len(ws)) if k in gone and k - 1 not in gone], [k + 1 for k in range(len(ws)) if k in gone and k + 1 not in gone]
        out.append((i is None, i, len(ws), len(gone), list(zip(*spans, strict=True)), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=lambda r: (r[0], r[1] or 0, r[5]))


def removal(df, p=SMALL_BLOCKS):
    rows = substrings.remove_repeated(df, p=p).collect()
    return sorted([(r.doc_id is None, r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept) for r in rows], key=lambda r: (r[0], r[1] or 0, r[5]))


def test_rabin_karp_is_the_polynomial():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 50, dtype=np.uint64)
    plain = [sum(int(x) * pow(substrings.BASE, 12 - k, 2**64) for k, x in enumerate(h[i : i + 13])) % 2**64 for i in range(38)]
    assert substrings.rabin_karp(h, 13).tolist() == substrings.tk.mix64(np.array(plain, dtype=np.uint64)).tolist()
    assert len(substrings.rabin_karp(h[:12], 13)) == 0 and len(substrings.rabin_karp(h[:13], 13)) == 1


def test_repeated_passages_go_as_the_definition_says(spark):
    rng = random.Random(2)
    shared = [prose(rng, n) for n in (12, 13, 14, 40, 70)]
    rows = []
    for k in range(120):
        parts = [prose(rng, rng.randint(0, 30))] + [x for _ in range(rng.randint(0, 3)) for x in (rng.choice(shared), prose(rng, rng.randint(0, 9)))]
        rows.append((1000 - 7 * k, rng.choice([" ", "\n", "  \t"]).join(parts), "en"))
    rows += [(k, "same " * 60, "en") for k in (5000, 5001)]  # repeats within a document are none; the copy goes whole
    for p in (SMALL_BLOCKS, SubstringParams()):
        found = removal(documents(spark, rows).repartition(5), p)
        assert found == plain_removal(rows)
    by = {r[1]: r for r in found}
    assert by[5000][3] == 0 and by[5001][3] == 60 and by[5001][5] == ""
    assert any(len(r[4]) > 1 for r in found)


def test_substring_edge_cases(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert removal(df) == plain_removal(rows)
    assert removal(df.limit(0)) == []


def test_a_file_split_by_the_scan_is_the_same_blocks(spark, tmp_path):
    rng = random.Random(4)
    passage = prose(rng, 30)
    rows = [(k, prose(rng, 40) + (" " + passage if k % 3 == 0 else ""), "en") for k in range(400)]
    documents(spark, rows).coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        found = removal(spark.read.parquet(str(tmp_path / "d")), SubstringParams(block_bytes=30000, bucket_bytes=8000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == plain_removal(rows)


def test_substring_query_equals_sql(compare):
    compare("op11_substring_dedup")


# --- collocations -------------------------------------------------------------------------------


def plain_collocations(rows, least, top=2000, longest=4):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                for k in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[k : k + m])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, w), a in found.items():
        if any(x[0] == lang and len(x[1]) > len(w) and 100 * b >= 80 * a and any(x[1][k : k + len(w)] == w for k in range(len(x[1]))) for x, b in found.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rs in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rs)[:top]))


def test_suffixes_are_ordered_and_share_what_they_share():
    rng = random.Random(5)
    words, left = [], []
    for _ in range(80):
        n = rng.randint(1, 9)
        words += [rng.randint(0, 3) for _ in range(n)]
        left += list(range(n, 0, -1))
    words, left = np.array(words), np.array(left)
    order, shared = collocations.suffix_order(words, left, 4)
    heads = [tuple(words[i : i + min(4, left[i])].tolist()) for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(words)))
    for k in range(1, len(heads)):
        same = next((m for m, (a, b) in enumerate(zip(heads[k - 1], heads[k])) if a != b), min(len(heads[k - 1]), len(heads[k])))
        assert shared[k] == same


def phrase_rows(seed=6):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "hall", "été", "a-b", "x1"]
    sets = ["New York City Hall", "city of the", "x1 a-b"]
    rows = []
    for k in range(150):
        parts = [rng.choice([rng.choice(vocabulary), rng.choice(sets)]) for _ in range(rng.randint(0, 20))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(x + rng.choice(["", "", "", ".", ",", "\n", "!"]) for x in parts), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .,! \n", "de")]


@pytest.mark.parametrize("block_bytes", [400, 6 << 20])
def test_collocations_follow_the_definition(spark, block_bytes):
    rows = phrase_rows()
    df = documents(spark, [(k % 50, t, lang) for k, (t, lang) in enumerate(rows)]).repartition(3)
    p = CollocationParams(least=5, block_bytes=block_bytes, bucket_bytes=600)
    found = sorted(tuple(r) for r in collocations.collocations(df, p=p).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == plain_collocations(rows, 5)
    cut = sorted(tuple(r) for r in collocations.collocations(df, p=CollocationParams(least=3, top=4, salts=2)).collect())
    assert cut == plain_collocations(rows, 3, top=4)


def test_collocation_edge_cases(spark):
    df = awkward(spark)
    found = collocations.collocations(df, p=CollocationParams(least=40))
    rows = [(r.text, r.lang) for r in df.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 40)
    assert collocations.collocations(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent_ngrams(df, p=CollocationParams(longest=5))


def test_scores_pass_64_bits(spark):
    rows = [("en", 1, 1, 6 * 10**12, "a", [], [], []), ("en", 2, 1, 6 * 10**12, "b", [], [], []), ("en", 3, 2, 6 * 10**12 - 1, "a b", [1], [2], [])]
    one = collocations.scored(spark.createDataFrame(rows, collocations.PHRASES)).first()
    assert (one.l, one.r, one.score) == (6 * 10**12, 6 * 10**12, 2_000_000 * (6 * 10**12 - 1) // (12 * 10**12))


def test_collocation_query_equals_sql(compare):
    compare("op12_collocations")


# --- whitening ----------------------------------------------------------------------------------


def vectors(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(c) for c in ("id", "dims", "vec", "deviation", "component", "at", "n")}).repartition(partitions)


def test_whole_numbers_come_back_from_residues():
    rng = random.Random(8)
    bound = 10**40
    primes = whitening.enough_primes(bound)
    assert math.prod(primes) > 2 * bound and all(p < 2**21 for p in primes) and len(set(primes)) == len(primes)
    values = [rng.randint(-bound, bound) for _ in range(50)] + [0, 1, -1, bound, -bound]
    residues = [np.array([v % p for v in values]) for p in primes]
    assert whitening.from_residues(residues, primes).tolist() == values


def test_scatter_is_exact_and_rows_are_whitened(spark):
    rng = np.random.default_rng(9)
    data = (rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)).astype(np.float32)
    data[3] = data[4]  # repeated rows count each
    df = vectors(spark, [(int(k), v.tolist()) for k, v in enumerate(data)])
    x = np.floor(64 * data.astype(float)).astype(int) + 1_000_000
    centred = [[len(x) * int(v) - int(s) for v, s in zip(row, x.sum(axis=0), strict=True)] for row in x]
    model = whitening.fit(df, components=4)
    rows = whitening.usable_rows(df, "embedding").select("vec")
    exact = [[sum(r[i] * r[j] for r in centred) for j in range(6)] for i in range(6)]
    assert whitening.exact_scatter(rows, model).tolist() == exact
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(model.values, values[:4]) and math.isclose(model.trace, values.sum())
    found = whitening.components_of(df, components=4).collect()
    assert len(found) == 700 * 4 and {r.component for r in found} == {1, 2, 3, 4}
    assert all(r.deviation == sum(c * c for c in centred[r.vec_id]) and r.n == 700 for r in found)
    whitened = np.zeros((700, 4))
    for r in found:
        whitened[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(4)).max() < 1e-9 and found[0].identity_error < 1e-9
    assert np.allclose(whitened, (x - x.mean(axis=0)) @ model.vectors / np.sqrt(model.values))
    assert math.isclose(sum({r.component: r.explained for r in found}.values()), values[:4].sum() / values.sum())


def test_whitening_edge_cases(spark):
    good = [(k, [float(k), 2.0 * k, 7.0]) for k in range(5)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]), (94, [1.0, math.inf, 0.0]), (95, [1.0, 2.0]), (96, [0.0] * 9)]
    found = whitening.components_of(vectors(spark, good + bad + [(None, [9.0, 1.0, 7.0])])).collect()
    assert sorted({r.vec_id for r in found if r.vec_id is not None}) == [0, 1, 2, 3, 4] and len(found) == 6 * 3
    flat = [r for r in found if r.component == 3]
    assert all(r.whitened is None and r.explained == 0.0 for r in flat) and all(r.whitened is not None for r in found if r.component < 3)
    one = whitening.components_of(vectors(spark, [(1, [3.0, 4.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    assert whitening.components_of(vectors(spark, bad[:1])).collect() == []
    far = whitening.components_of(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(far) == 6 and all(r.n == 3 and r.deviation is None for r in far if r.vec_id != 3)


def test_whitening_query(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["op13_residue_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(rows["embedding"].to_numpy()).astype(float)).astype(int) + 1_000_000
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    plain = (x - x.mean(axis=0)) @ basis[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    signs = np.sign((plain * wide).sum(axis=0))
    assert np.abs(plain * signs - wide).max() < 1e-6 and found["identity_error"].max() < 1e-4
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert (found.drop_duplicates("vec_id").set_index("vec_id").loc[rows["vec_id"], "deviation"].to_numpy() == deviation).all()


def test_digests_of_kept_words(spark):
    import __spark_entry__

    found = {r.doc_id: r for r in __spark_entry__.queries()["op11_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for _, i, words, removed, _, kept in plain_removal(rows):
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (words, removed, hashlib.sha256(kept.encode()).hexdigest())
