"""Toxicity, language, quality, language model and decontamination."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import awkward, documents, lower, prose, words
from pyspark.sql import functions as F

from basinflow.llm import decontam, langid, lm, quality, queries, textkit, toxicity
from basinflow.llm.sampling import fold, held_out


def crc_fold(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_words_of_a_column():
    texts = ["Ab  cD\té\x0bx", None, "", " \n", "ÉA\x85b c", "x" * 5000 + " y"]
    w = textkit.words(pa.array(texts))
    found = [[bytes(w.data[w.starts[k] : w.ends[k]]).decode() for k in range(w.offsets[d], w.offsets[d + 1])] for d in range(len(texts))]
    assert found == [words(t) for t in texts]
    sliced = textkit.words(pa.array(texts).slice(1, 4))
    assert list(np.diff(sliced.offsets)) == [0, 0, 0, 2 if len(words(texts[4])) == 2 else 1]


def test_shingles_of_a_column():
    texts = ["a b c d e f a b c d e", "a b", "", None, "a b c d e"]
    sets, at = textkit.shingle_sets(pa.array(texts), 5)
    assert list(np.diff(at)) == [6, 1, 0, 0, 1]
    assert sets[at[4]] in sets[at[0] : at[1]]


def test_slices_cut_between_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5])], names=["doc", "text"])
    parts = list(textkit.slices(batch, "text", 12))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2


def test_held_out_of_null_is_false(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(held_out("doc_id", 5, crc_fold(5, 5))).collect()] == [True, False]
    assert df.select(fold("doc_id", 5)).first()[0] == crc_fold(5, 5)


# --- toxicity -----------------------------------------------------------------------------------


def toxic_corpus(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(rng, 40) + (f" you {rng.choice(['idiot', 'scum', 'pathetic'])} " if bad else " friend ") + prose(rng, 10)
        rows.append((k, text, "en"))
        if k < n // 2:
            labels.append((k, 1, int(bad)))
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_unlabelled_toxic_texts(spark):
    docs, labels = toxic_corpus(spark)
    chain = toxicity.train_on_labels(docs, labels)
    assert len(chain.models) == 2 and [len(m.dense) for m in chain.models] == [0, 1]
    found = {r.doc_id: r.toxic for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect()}
    assert sum(found[k] == (k % 4 == 0) for k in range(300, 600)) >= 297


def test_toxicity_out_of_fold_odds_are_not_those_of_the_final_model():
    """A category that is pure noise must not look predictable to the next model."""
    rng = np.random.default_rng(0)
    rows, cols = np.repeat(np.arange(200), 5), rng.integers(0, 300, 1000)
    labels = np.column_stack([rng.integers(0, 2, 200), rng.integers(0, 2, 200)]).astype(float)
    chain = toxicity.fit_chain(rows, cols, labels, toxicity.Vocabulary(np.arange(300, dtype=np.uint64)), toxicity.ToxicityParams())
    assert abs(chain.models[1].dense[0]) < 1.0


def plain_fit(x, y, size, p):
    """Ridge logistic regression on a dense matrix, one step after the other."""
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w = np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    one = np.column_stack([x, np.ones(len(x))])
    squares = np.full(len(w), 1e-8)
    for _ in range(p.steps):
        slope = one.T @ ((1 / (1 + np.exp(-one @ w))) - y) / len(y) + p.ridge * np.append(w[:-1], 0)
        squares += slope**2
        w = w - 0.5 * slope / np.sqrt(squares)
    return w


def test_the_chain_follows_the_definition():
    """Each model is fitted on the words and on the odds that models of the other folds gave."""
    rng = np.random.default_rng(4)
    p = toxicity.ToxicityParams(steps=40)
    x = (rng.random((150, 12)) < 0.3).astype(float)
    labels = np.column_stack([(x[:, 0] + rng.random(150) > 1), (x[:, 0] * x[:, 1] + 0.3 * rng.random(150) > 0.25)]).astype(float)
    labels[::7, 0] = np.nan
    rows, cols = np.nonzero(x)
    chain = toxicity.fit_chain(rows, cols, labels, toxicity.Vocabulary(np.arange(12, dtype=np.uint64)), p)
    part = textkit.mix64(np.arange(150, dtype=np.uint64)) % np.uint64(p.folds)
    seen, models = x, []
    for y in labels.T:
        known = ~np.isnan(y)
        models.append(plain_fit(seen[known], y[known], 12, p))
        out = np.zeros(150)
        for k in range(p.folds):
            w = plain_fit(seen[known & (part != k)], y[known & (part != k)], 12, p)
            out[part == k] = (np.column_stack([seen, np.ones(150)]) @ w)[part == k]
        seen = np.column_stack([seen, np.clip(out, -12, 12)])
    fresh = (rng.random((20, 12)) < 0.3).astype(float)
    want, odds = [], fresh
    for w in models:
        o = np.column_stack([odds, np.ones(20)]) @ w
        want.append(1 / (1 + np.exp(-np.clip(o, -12, 12))))
        odds = np.column_stack([odds, np.clip(o, -12, 12)])
    assert chain.probabilities(*np.nonzero(fresh), 20) == pytest.approx(np.column_stack(want), rel=1e-6, abs=1e-9)


def test_fitting_holds_few_bytes_besides_its_input():
    """The driver fits the chain: beyond the words themselves it holds under 16 bytes for each."""
    rng, count, size, n = np.random.default_rng(9), 10_000, 2_000, 2_000_000
    rows, cols = np.sort(rng.integers(count, size=n, dtype=np.int32)), rng.integers(size, size=n, dtype=np.int32)
    labels = rng.integers(2, size=(count, 2)).astype(float)
    vocabulary = toxicity.Vocabulary(np.arange(size, dtype=np.uint64))
    tracemalloc.start()
    toxicity.fit_chain(rows, cols, labels, vocabulary, toxicity.ToxicityParams(steps=1))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 16 * n
    values = rng.random(size)
    assert toxicity.summed(rows, values, cols, count, 1000) == pytest.approx(np.bincount(rows, weights=values[cols], minlength=count))


def test_a_labelled_id_counts_once_however_often_it_occurs(spark):
    docs, labels = toxic_corpus(spark, 120)
    twice = docs.unionByName(docs.where("doc_id < 40").withColumn("text", F.lit("other words"))).unionByName(docs)
    p = toxicity.ToxicityParams(sample=30, least_g=1.0)
    chain = toxicity.train_on_labels(twice, labels, p)
    assert len(chain.models) == 2
    assert toxicity.score(twice, chain, toxicity.CATEGORIES).count() == twice.count()


def test_filters_of_the_pipeline_carry_no_row_through_python(spark):
    """They keep what the scores keep, and of the columns Python reads the text, once."""
    docs, labels = toxic_corpus(spark, 120)
    rows = docs.unionByName(awkward(spark))
    chain = toxicity.train_on_labels(docs, labels)
    model = quality.train(quality.document_statistics(docs), labels.select(F.col("doc_id").alias("doc"), F.col("toxic").alias("label")))
    toxic = toxicity.score(rows, chain, toxicity.CATEGORIES).where("toxic").select("doc_id")
    good = quality.score_texts(rows, model).where("predicted = 1").select("doc_id")
    for kept, want in ((rows.where(toxicity.rejected(rows["text"], chain)), toxic), (rows.where(quality.accepted(rows["text"], model)), good)):
        assert kept.columns == rows.columns
        assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, want.collect())) != []
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert rows.limit(0).where(toxicity.rejected(F.col("text"), chain)).count() == 0


def test_the_pipeline_filters_without_rows_in_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for stage in (corpus_pipeline.without_toxic, corpus_pipeline.of_quality):
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()


def test_toxicity_edge_cases(spark):
    docs, labels = toxic_corpus(spark, 80)
    chain = toxicity.train_on_labels(docs, labels)
    odd = awkward(spark)
    scored = toxicity.score(odd, chain, toxicity.CATEGORIES)
    assert scored.count() == odd.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    rates = {r.score for r in scored.where("doc_id in (100, 101, 102, 108)").collect()}
    assert len(rates) == 1
    assert toxicity.score(odd.limit(0), chain, toxicity.CATEGORIES).count() == 0
    none = toxicity.train_on_labels(odd, labels.limit(0))
    assert toxicity.score(odd, none, toxicity.CATEGORIES).where("toxic").count() == 0


# --- language -----------------------------------------------------------------------------------


def languages(spark, n=240):
    rng = random.Random(5)
    sounds = {"aa": "abcde", "bb": "fghij", "cc": "aeiou"}
    rows = []
    for k in range(n):
        lang = sorted(sounds)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(5)) for _ in range(20)), lang))
    return documents(spark, rows)


def plain_bits(trees, text):
    """PPM code length per language by the definition, byte by byte."""
    coded = bytearray(b"   ")
    raw = lower(text).encode()
    is_letter = lambda b: 97 <= b <= 122 or b >= 128
    for k, b in enumerate(raw):
        if is_letter(b):
            coded.append(b)
        elif k == 0 or is_letter(raw[k - 1]):
            coded.append(32)
    seen = sorted({int(g) & 0xFF for g in trees.grams} | {32})
    width = len(seen) + 1
    symbol = {b: k for k, b in enumerate(seen)}
    code = lambda b: symbol.get(b, len(seen))
    totals = []
    for j in range(len(trees.langs)):
        tables = [dict() for _ in range(langid.ORDER + 1)]
        for g, row in zip(trees.grams, trees.counts, strict=True):
            b = [code((int(g) >> (8 * k)) & 0xFF) for k in range(langid.ORDER + 1)]
            for order in range(langid.ORDER + 1):
                context = tuple(b[order:0:-1])
                if row[j]:
                    tables[order].setdefault(context, Counter())[b[0]] += row[j]

        def chance(context, s, tables=tables):
            if context is None:
                return 1.0 / width
            order = len(context)
            shorter = (lambda x: chance(context[1:] if order else None, x))
            seen_here = tables[order].get(context)
            if not seen_here:
                return shorter(s)
            total, distinct = sum(seen_here.values()), len(seen_here)
            if s in seen_here:
                return seen_here[s] / (total + (0 if distinct == width else distinct))
            left = max(1 - sum(shorter(x) for x in seen_here), 1e-12)
            return distinct / (total + distinct) * shorter(s) / left

        totals.append(-sum(math.log2(chance(tuple(code(b) for b in coded[k - 3 : k]), code(coded[k]))) for k in range(3, len(coded))))
    return totals, len(coded) - 3


def test_code_lengths_follow_the_definition(spark):
    docs = languages(spark, 30)
    trees = langid.train(docs)
    text = "Abcd efg, AEIOU xyz"
    bits, size = plain_bits(trees, text)
    got = langid.score(documents(spark, [(1, text, None)]), trees).first()
    assert got.lang_pred == trees.langs[int(np.argmin(bits))]
    assert got.bits_per_byte == pytest.approx(min(bits) / size, rel=1e-4)


def test_languages_are_told_apart(spark):
    docs = languages(spark)
    trees = langid.train(docs.where(fold("doc_id", 5) != 0))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.score(docs, trees).collect()}
    assert all(found[k][0] == ["aa", "bb", "cc"][k % 3] and 0 <= found[k][1] <= 1 for k in range(240))


def test_language_edge_cases(spark):
    odd = awkward(spark)
    trees = langid.train(languages(spark, 60))
    scored = langid.score(odd, trees)
    assert scored.count() == odd.count()
    assert {r.lang_pred for r in scored.where("doc_id in (100, 101, 102, 108)").collect()} == {"und"}
    assert scored.where("doc_id = 106").first().lang_pred != "und"
    assert langid.score(odd.limit(0), trees).count() == 0
    nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.score(odd, nothing).collect()} == {"und"}


# --- quality ------------------------------------------------------------------------------------


def test_discriminant_follows_the_definition():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) * 2 + 1
    moment = lambda x: (y := np.column_stack([np.ones(len(x)), x])).T @ y
    p = quality.QualityParams()
    model = quality.fit_moments(np.array([moment(a), moment(b)]), p)
    pooled = (np.cov(a.T, bias=True) * 200 + np.cov(b.T, bias=True) * 150) / 350
    logs = []
    x = rng.normal(size=(5, 3))
    for rows in (a, b):
        cov = (1 - p.pool) * np.cov(rows.T, bias=True) + p.pool * pooled
        cov = (1 - p.diagonal) * cov + p.diagonal * np.diag(np.diag(cov)) + p.floor * np.eye(3)
        gap = x - rows.mean(axis=0)
        logs.append(-0.5 * np.einsum("nd,de,ne->n", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0] + math.log(151 / 201)))))


def test_statistics_do_not_depend_on_how_rows_are_batched():
    texts = ["Some plain words, and more of them.", None, "", "!!! $$$ ###", "again again again again", "x" * 3000]
    whole = quality.statistics(pa.array(texts))
    assert np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([quality.statistics(pa.array([t], type=pa.string())) for t in texts]))


def test_quality_learns_and_edge_cases(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 60) if k % 3 else " ".join(["$$$ !!!"] * 30), "en") for k in range(300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)] + [(None, 1), (2, None)], "doc long, label int")
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels)
    found = {r.doc_id: r.predicted for r in quality.score(stats, model).collect()}
    assert all(found[k] == int(k % 3 > 0) for k in range(1, 300, 2))
    odd = awkward(spark)
    scored = quality.score(quality.document_statistics(odd), model)
    assert scored.count() == odd.count() and scored.where("score is null or not (score between 0 and 1)").count() == 0
    assert quality.score(quality.document_statistics(odd.limit(0)), model).count() == 0
    one_class = quality.train(stats, labels.where("label = 1"))
    assert quality.score(stats, one_class).where("score is null").count() == 0
    assert quality.score(stats, quality.train(stats, labels.limit(0))).where("score is null").count() == 0


# --- language model -----------------------------------------------------------------------------


def plain_model(rows, train, p):
    """Smoothed n-grams by the definition, one text and token after the other."""
    grams = Counter()
    for (_, text, _), use in zip(rows, train, strict=True):
        tokens = ["\0end", *words(text), "\0end"]
        for at in range(1, len(tokens)) if use else ():
            grams.update(tuple(tokens[at - m : at + 1]) for m in range(min(at + 1, p.order)))
    total = sum(n for g, n in grams.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in grams)

    def chance(context, t):
        if not context:
            return (grams[(t,)] + 1) / (total + distinct + 1)
        shorter, n = chance(context[1:], t), grams[context]
        types = p.types_scale * n**p.types_power
        return (grams[(*context, t)] + types * shorter) / (n + types) if n else shorter

    out = {}
    for k, (_, text, _) in enumerate(rows):
        tokens = ["\0end", *words(text), "\0end"]
        places = range(1, len(tokens))
        base = sum(math.log10(chance((), tokens[at])) for at in places)
        model = sum(math.log10(chance(tuple(tokens[max(0, at - p.order + 1) : at]), tokens[at])) for at in places)
        out[k] = (len(tokens) - 1, sum(grams[(tokens[at],)] > 0 for at in places), total, base, model)
    return out


def test_language_model_follows_the_definition(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 30))), "en") for k in range(120)]
    rows += [(500, None, None), (501, "", None), (502, "Zebra A b", None)]
    docs = documents(spark, rows)
    for p in (lm.LMParams(block_bytes=700, bucket_bytes=500, lane=7), lm.LMParams(order=2, lane=1), lm.LMParams(order=1), lm.LMParams(order=4)):
        got = lm.score(docs, fold("doc_id", 7) != 2, p=p).collect()
        want = plain_model(rows, [crc_fold(i, 7) != 2 for i, _, _ in rows], p)
        by_id = {rows[k][0]: v for k, v in want.items()}
        assert len(got) == len(rows)
        for r in got:
            n, known, total, base, model = by_id[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model)


def test_query_scores_by_two_words_and_by_what_training_has_once(spark, tmp_path):
    """A trigram and a bigram that training has once raise the scores of held-out texts."""
    ids = [k for k in range(1, 400) if crc_fold(k, 7) != 2]
    asked = [k for k in range(1, 400) if crc_fold(k, 7) == 2]
    rows = [(ids[0], "p b x"), (ids[1], "q b y"), (ids[2], "r b x"), (ids[3], "s b y"), (ids[4], "once seen")]
    rows += [(k, t) for k, t in zip(asked, ["p b x", "p b y", "q b y", "q b x", "once seen", "once x"], strict=False)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_backoff_automaton(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[k].held_out and np.isfinite(got[k].score) for k in asked[:6])
    of = [got[k].score for k in asked[:6]]
    assert of[0] > of[1] + 0.2 and of[2] > of[3] + 0.2 and of[4] > got[asked[4]].base_score + 0.5


def test_language_model_of_blocks_that_the_scan_splits(spark, tmp_path):
    """Several tasks read rows of one block; its contexts still count once."""
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(20, 40))), "en") for k in range(120)]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    pq.write_table(table, tmp_path / "docs.parquet", row_group_size=5)
    small = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(str(tmp_path / "docs.parquet"))
        for p in (lm.LMParams(), lm.LMParams(block_bytes=700, bucket_bytes=900)):
            assert docs.rdd.getNumPartitions() > 5
            got = {r.doc_id: r.score for r in lm.score(docs, fold("doc_id", 7) != 2, p=p).collect()}
            want = plain_model(rows, [crc_fold(i, 7) != 2 for i, _, _ in rows], p)
            assert got == {k: pytest.approx(v[4]) for k, v in want.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_language_model_probabilities_sum_to_one(spark):
    """After any context, all words, an unseen one and the end together have probability 1."""
    rows = [(k, t, "en") for k, t in enumerate(["a b a c a b b", "b c a", "a", ""] * 5)]
    asked = [(100 + k, f"{c} {w}", "en") for k, (c, w) in enumerate((c, w) for c in ("a b", "c a", "x a", "x y", "a") for w in ("a", "b", "c", "unseen"))]
    asked += [(200 + k, c, "en") for k, c in enumerate(("a b", "c a", "x a", "x y", "a"))]
    docs = documents(spark, [*rows, *asked])
    train = [i < 100 for i, _, _ in [*rows, *asked]]
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 100).collect()}
    want = {i: v[4] for (i, _, _), v in zip([*rows, *asked], plain_model([*rows, *asked], train, lm.LMParams()).values(), strict=True)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    tokens = np.array([lm.END, 1, 2, lm.END, lm.END, 2, 2, 1, lm.END], dtype=np.uint64) * np.uint64(8)
    begins = np.array([0, 4])
    for context in ([1, 2], [2, 2], [7, 2], [7, 7], []):
        chances = 0.0
        for last in (1, 2, 9, int(lm.END)):
            text = np.array([lm.END, *context, last], dtype=np.uint64) * np.uint64(8)
            grams = lm.Grams.of(np.concatenate([tokens, text]), np.append(begins, len(tokens)), 3)
            counted = np.arange(len(tokens) + len(text)) < len(tokens)
            counted[begins] = False
            machine = lm.Automaton(grams, grams.counts(counted), 7, 3, lm.LMParams())
            chances += 10 ** machine.read(np.append(begins, len(tokens)), len(tokens) + len(text))[-1]
        assert chances == pytest.approx(1.0)


def test_the_automaton_is_walked_state_by_state():
    """Targets, failure arcs and lanes: a plain walk over the stored arcs gives the same weights."""
    rng = np.random.default_rng(14)
    sizes = rng.integers(0, 40, 60)
    tokens = np.concatenate([[lm.END, *rng.integers(1, 9, n).astype(np.uint64) * np.uint64(8), lm.END] for n in sizes]).astype(np.uint64)
    begins = np.cumsum(sizes + 2) - sizes - 2
    grams = lm.Grams.of(tokens, begins, 3)
    counted = np.repeat(np.arange(60) % 3 > 0, sizes + 2)
    counted[begins] = False
    p = lm.LMParams(lane=5)
    machine = lm.Automaton(grams, grams.counts(counted), int(counted.sum()), 9, p)
    arcs = {}
    for m in range(3):
        for place in range(len(tokens)):
            gram = grams.at[m][place]
            if gram < machine.root and (m == 0 or machine.counts[gram]):
                arcs[grams.at[m - 1][place - 1] if m else machine.root, tokens[place]] = gram
    logs = machine.read(begins, len(tokens))
    for lo, n in zip(begins, sizes, strict=True):
        state = grams.at[0][lo]
        for place in range(lo + 1, lo + n + 2):
            log = 0.0
            while (state, tokens[place]) not in arcs:
                log += machine.backoff[state]
                state = machine.shorter[state]
            log += machine.weight[arcs[state, tokens[place]]]
            state = machine.target[arcs[state, tokens[place]]]
            assert logs[place] == pytest.approx(log)


def test_language_model_edge_cases(spark):
    odd = awkward(spark)
    scored = lm.score(odd, F.col("doc_id").isNotNull())
    assert scored.count() == odd.count()
    assert {r.n_tokens for r in scored.where("doc_id in (100, 101, 102)").collect()} == {1}
    assert scored.where("doc_id = 104").first().n_tokens == 120_001
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
    untrained = lm.score(odd, F.lit(None).cast("boolean"))
    assert {(r.score, r.n_known) for r in untrained.collect()} == {(0.0, 0)}


def test_language_model_query_equals_sql(compare):
    compare("op3_backoff_automaton")


# --- decontamination ----------------------------------------------------------------------------


def plain_bm25(items, passage_words, p):
    """Share of its own score that each segment (item, part) gets from a set of words, by the definition."""
    bags = {}
    for i, t in items:
        found = words(t)
        for k, part in enumerate(np.array_split(np.array(found, dtype=object), -(-len(found) // (p.passage - p.stride))) if found else []):
            bags[i, k] = list(part)
    mean = np.mean([len(b) for b in bags.values()])
    df = Counter(t for b in bags.values() for t in set(b))
    out = {}
    for key, bag in bags.items():
        weight = {t: math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * len(bag) / mean)) for t, n in Counter(bag).items()}
        out[key] = sum(w for t, w in weight.items() if t in passage_words) / sum(weight.values())
    return out


def test_block_max_retrieval_finds_what_plain_bm25_finds(spark):
    """All segments whose BM25 reaches the threshold, with their scores, in any number of passes."""
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(3, 14))) for k in range(50)] + [(80, prose(rng, 40)), (81, "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(rng, 50) + " " + items[k % 50][1] + " " + prose(rng, 20) for k in range(20)] + [items[50][1]]
    w = textkit.words(pa.array(texts))
    base = decontam.DecontamParams(passage=32, stride=16, threshold=0.3, block=3)
    want = {}
    for row, text in enumerate(texts):
        n = len(words(text))
        for nth in range(max(1, -(-(n - base.stride) // base.stride))):
            inside = set(words(text)[nth * base.stride : nth * base.stride + base.passage])
            want |= {(row, nth * base.stride, key): x for key, x in plain_bm25(items, inside, base).items() if x >= base.threshold}
    assert len(want) >= 20
    for p in (base, decontam.DecontamParams(passage=32, stride=16, threshold=0.3, block=1), decontam.DecontamParams(passage=32, stride=16, threshold=0.3, pass_words=100)):
        segments, passes = decontam.item_segments(tests, p)
        weights = decontam.impacts(segments, p)
        assert passes == (1 if p.pass_words > 1000 else -(-sum(len(words(t)) for _, t in items) // 100))
        found = {}
        for k in range(passes):
            own = segments.where(F.col("pass") == k)
            index = decontam.item_index(own, weights.where(F.col("pass") == k), p)
            keys = [(r["item"], r["part"]) for r in own.orderBy("item", "part", "segment").collect()]
            found |= {(row, lo - int(w.offsets[row]), keys[s]): x for row, lo, _, s, x in decontam.candidates(w, index)}
        assert found == {k: pytest.approx(v) for k, v in want.items()}


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(22)
    items = [(k, prose(rng, 14)) for k in range(30)] + [(90, prose(rng, 300)), (91, prose(rng, 14).upper())]
    rows = [(k, prose(rng, 200), "en") for k in range(60)]
    rows += [(1000 + k, prose(rng, rng.randint(0, 300)) + " " + t + " " + prose(rng, 150), "en") for k, t in items]
    tests = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontam.DecontamParams(), decontam.DecontamParams(pass_words=300)):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents(spark, rows), tests, p=p).collect()}
        assert found == {(1000 + k, k) for k, _ in items}


def test_question_without_its_answer_is_not_contamination(spark):
    rng = random.Random(23)
    item = prose(rng, 20).split()
    rows = [(1, " ".join([*item[:14], *prose(rng, 40).split()]), "en"), (2, " ".join(item), "en")]
    tests = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(documents(spark, rows), tests).collect()] == [2]


def test_decontamination_edge_cases(spark):
    odd = awkward(spark)
    tests = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, "unheard"), (4, "one"), (4, "one")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(odd, tests).collect())
    assert found == [(103, 4)]
    assert decontam.contaminated(odd, tests.limit(0)).count() == 0
    assert decontam.contaminated(odd.limit(0), tests).count() == 0
