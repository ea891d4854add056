"""Neighbours, near-duplicates, sharding, packing, archives, and the pipeline."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, prose, words
from pyspark.sql import functions as F

from basinflow.llm import ann, minhash, packing, sharding, warc
from basinflow.llm.components import connected_components
from basinflow.sources.shared import fresh_path

# --- approximate nearest neighbours -------------------------------------------------------------


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("shard", "hash", "ids", "dim", "rank", "score", "query_id", "id", "vec")})


def brute_force(rows, k=10):
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in usable:
        if q % 100 == 0:
            rest = [(float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in usable if len(b) == len(a)]
            rest.remove((0.0, q))
            out[q] = [(j, d) for d, j in sorted(rest)[:k]]
    return out


def found_neighbours(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_graph_search_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, 24)).astype(np.float32))]
    x = vectors(spark, rows)
    p = ann.HnswParams(least_rows=700, most_rows=700)
    found = found_neighbours(ann.nearest(x, x.where("vec_id % 100 = 0"), p=p))
    want = brute_force(rows)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95
    exact = dict(rows_to_vectors(rows))
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        assert all(abs(d - np.sqrt(((exact[q] - exact[j]) ** 2).sum())) < 1e-12 for j, d in near)


def rows_to_vectors(rows):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows]


def test_layers_are_navigable():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(900, 8))
    order, graph = ann.build(data, np.arange(900, dtype=np.uint64), ann.HnswParams(links=4))
    assert sorted(order.tolist()) == list(range(900)) and len(graph.layers) > 2
    assert np.array_equal(graph.exact, data[order])
    for level, links in enumerate(graph.layers):
        assert links.max() < len(links)
        assert not (links == np.arange(len(links))[:, None]).any()
        assert level == 0 or len(links) < len(graph.layers[level - 1])


def test_ties_wider_than_the_beam_go_to_the_smallest_ids(spark):
    """One-hot vectors are all equally far from each other."""
    rows = [(i, [float(i == j) for j in range(200)], 0) for i in range(200)]
    rows += [(1000 + i, [2.0 * (i == j) for j in range(200)], 0) for i in range(200)]
    x = vectors(spark, rows)
    for p in (ann.HnswParams(), ann.HnswParams(search=4, links=4, least_rows=150, most_rows=150)):
        found = found_neighbours(ann.nearest(x, x.where("vec_id in (0, 100)"), p=p))
        assert [j for j, _ in found[100]] == [1100, *range(9)]
        assert [j for j, _ in found[0]] == [1000, *range(1, 10)]


def test_recall_of_a_shard_of_unclustered_vectors():
    """The hardest kind: 64 independent normal components."""
    rng = np.random.default_rng(12)
    data, p = rng.normal(size=(6000, 64)), ann.HnswParams()
    order, graph = ann.build(data, np.arange(6000, dtype=np.uint64), p)
    nodes, _ = graph.search(data[::100], p.search)
    want = np.argsort(((data[None, :, :] - data[::100, None, :]) ** 2).sum(axis=2), axis=1)[:, :10]
    hits = sum(len(set(order[n[:10]].tolist()) & set(w.tolist())) for n, w in zip(nodes, want, strict=True))
    assert hits >= 0.95 * want.size


def test_a_search_sees_a_small_part_of_a_shard():
    """Recall at a tenth of the distances that a scan works out."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    data = centres[rng.integers(0, 60, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))
    p = ann.HnswParams()
    order, graph = ann.build(data, np.arange(20_000, dtype=np.uint64), p)
    asked = data[::200]
    evaluated = 0
    distances = graph.distances

    def counted(points, nodes):
        nonlocal evaluated
        evaluated += int((nodes >= 0).sum())
        return distances(points, nodes)

    graph.distances = counted
    nodes, _ = graph.search(asked, p.search)
    want = np.argsort(((data[None, :, :] - asked[:, None, :]) ** 2).sum(axis=2), axis=1)[:, :10]
    hits = sum(len(set(order[n[:10]].tolist()) & set(w.tolist())) for n, w in zip(nodes, want, strict=True))
    assert hits >= 0.9 * 10 * len(asked) and evaluated < 0.1 * 20_000 * len(asked)


def test_search_edge_cases(spark):
    rng = np.random.default_rng(3)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot, 0) for i in range(0, 350)]
    rows += [(1000 + i, rng.normal(size=3).tolist(), 0) for i in range(30)]
    rows += [(2000, None, 0), (2100, [], 0), (2200, [0.0, 0.0, 0.0], 0), (2300, [1.0, None, 2.0], 0), (2400, [1.0, float("nan"), 0.0], 0), (2500, [float("inf"), 0.0, 0.0], 0), (None, hot, 0)]
    rows += [(2600, [1.0, 1.0], 0), (2601, [1.0, 2.0], 0), (2700, [-0.0, 1.0], 0), (2701, [0.0, 1.0], 0), (2800, [1e30, 1e30, 0.0, 1.0], 0), (2800, [1e30, 1e30, 0.0, 1.0], 0)]
    x = vectors(spark, rows)
    found = found_neighbours(ann.nearest(x, x.where("vec_id % 100 = 0")))
    want = brute_force([r for r in rows if r[0] != 2800])
    assert found.pop(2800) == [(2800, 0.0)]
    assert found.keys() == {k for k, v in want.items() if v}
    for q, near in found.items():
        assert [j for j, _ in near] == [j for j, _ in want[q]]
    assert ann.nearest(x.limit(0), x).count() == 0
    assert ann.nearest(x, x.limit(0)).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(sets[k]), least[top(k)], least[top(k)] == i) for k, (i, _, _) in enumerate(rows))


def edited(rng, text, share):
    return " ".join(rng.choice(["x", "y", "z"]) + w if rng.random() < share else w for w in text.split())


def test_near_duplicate_groups_equal_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(20, 120))
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.06])), "en"))
            base = rng.choice([base, rows[-1][1]])
    rows += [(len(rows) + k, t, None) for k, t in enumerate([None, "", "one two", "ONE  two", "one two three", " \n"])]
    for p in (minhash.MinHashParams(), minhash.MinHashParams(partners=1, chunk=3, hot_rows=2)):
        found = minhash.near_duplicate_groups(documents(spark, rows), p=p).collect()
        assert sorted(map(tuple, found)) == brute_groups(rows)


def test_links_are_found_in_a_crowd_just_below_the_threshold(spark):
    """Many texts resemble each other without being linked; a few pairs among them are."""
    rng = random.Random(33)
    base = prose(rng, 150).split()
    rows = []
    for _ in range(60):
        text = list(base)
        for at in rng.sample(range(0, 150, 6), 4):
            text[at] = f"w{rng.random()}"
        rows.append((len(rows), " ".join(text), "en"))
    for k in range(0, 60, 15):
        rows.append((len(rows), rows[k][1] + " and one more", "en"))
    for p in (minhash.MinHashParams(), minhash.MinHashParams(partners=1, chunk=16)):
        found = minhash.near_duplicate_groups(documents(spark, rows), p=p).collect()
        assert sorted(map(tuple, found)) == brute_groups(rows)


def test_no_estimate_hides_a_pair_that_shares_a_bucket():
    """Pairs of similarity 0.75 are proposed whatever their sketches estimate, the unlike are not."""
    rng = np.random.default_rng(34)
    p = minhash.MinHashParams()

    def proposed(left, right, most):
        """Whether each pair of texts shares a bucket, and whether a bucket of the two proposes it."""
        a, b = (pa.Table.from_batches(minhash._signature_batches([pa.record_batch({"doc": list(range(len(x))), "text": x, "known_as": list(range(len(x)))})], p)).to_pydict() for x in (left, right))
        shares, found = np.zeros(len(left), dtype=bool), np.zeros(len(left), dtype=bool)
        for k in range(len(left)):
            for band in np.flatnonzero(np.array(a["bands"][k]) == np.array(b["bands"][k])):
                both = {"bucket": [k, k], "cell": [0, 0], "side": [0, 1], "band": [int(band)] * 2, "node": [1, 2], "part": [1, 2]}
                both |= {"n": [x["n_shingles"][k] for x in (a, b)], "sketch": [x["sketch"][k] for x in (a, b)]}
                shares[k] = True
                found[k] |= any(x.num_rows for x in minhash._proposal_batches([pa.record_batch(both)], p, most))
        return shares, found

    def pairs(common, own, n):
        """Texts of ``n`` pairs that have ``common`` five-word shingles in common and ``own`` more each."""
        words = [[f"w{x}" for x in rng.integers(1 << 60, size=common + 4 + 2 * own)] for _ in range(n)]
        return [" ".join(w[: common + 4 + own]) for w in words], [" ".join([*w[: common + 4], *w[common + 4 + own :]]) for w in words]

    for common, own in ((150, 25), (600, 100), (3000, 500)):
        shares, found = proposed(*pairs(common, own, 1000 if common < 3000 else 200), None if own < 100 else 8)
        assert shares.mean() > 0.99 and (found == shares).all()
    shares, found = proposed(*pairs(100, 75, 500), None)
    assert shares.sum() > 100 and found.sum() < 0.05 * shares.sum()


def test_rows_without_an_id_and_rows_that_share_one_are_grouped_by_their_texts(spark):
    """Groups are those of the same rows under ids of their own."""
    rng = random.Random(35)
    bases = [prose(rng, 60) for _ in range(8)]
    texts = [t for b in bases for t in (b, edited(rng, b, 0.02), b + " tail")]
    rows = [(7, t, "en") for t in texts[::3]] + [(None, t, "en") for t in texts[1::3]] + [(20 + k, t, "en") for k, t in enumerate(texts[2::3])]
    rows += [(7, texts[1], "en"), (None, texts[0], "en"), (None, prose(rng, 40), "en"), (50, texts[3].upper(), "en")]
    own = {k: c for k, _, c, _ in brute_groups([(k, t, g) for k, (_, t, g) in enumerate(rows)])}
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[own[k]] = min(least.get(own[k], i), i)
    want = [(i, len(shingles(t)), least.get(own[k], i), least.get(own[k], i) == i) for k, (i, t, _) in enumerate(rows)]
    found = minhash.near_duplicate_groups(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_the_map_of_texts_is_small_on_the_driver(spark):
    """Every carrier's text comes, whichever bit is its own; the driver holds the map's bits, not a number for each."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, prose(rng, 8)) for k in range(400)], "doc_id long, text string")
    known = docs.select(F.col("doc_id").alias("node"), minhash.text_key("text").alias("known_as"))
    carriers = known.where("node % 2 = 0")
    places = {r.known_as % 32 for r in carriers.collect()}
    assert places == set(range(32))
    p = minhash.MinHashParams()
    tracemalloc.start()
    texts = minhash.texts_of(docs, "text", carriers, p)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < p.filter_bits
    assert {(r.node, r.text) for r in texts.collect()} == {(r.doc_id, r.text) for r in docs.collect() if r.doc_id % 2 == 0}


def test_every_pair_of_a_bucket_meets_in_one_cell(spark):
    """Members are dealt to cells of two blocks; all pairs that need comparing meet, once for each cell."""
    sizes = {0: 37, 1: 9, 2: 1, 3: 14}
    nodes = [(k, part) for part, m in sizes.items() for k in range(100 * part, 100 * part + m)]
    buckets = spark.createDataFrame([(b, 3, k, 0) for b in (5, 6) for k, part in nodes if b == 5 or part < 2], "bucket long, band int, node long, centre long")
    groups = spark.createDataFrame(nodes, "node long, label long")
    sketches = groups.select("node", F.lit(9).cast("long").alias("n"), F.lit(b"x").alias("sketch"))
    rows = minhash.unsettled(buckets, groups, sketches, minhash.MinHashParams(chunk=8)).collect()
    for bucket in (5, 6):
        met, held = set(), {}
        for r in rows:
            if r.bucket == bucket:
                held.setdefault(r.cell, []).append(r)
        assert max(map(len, held.values())) < 40
        for cell in held.values():
            met |= {frozenset((x.node, y.node)) for x in cell if x.side > 0 for y in cell if y.side != 1 and x.part != y.part}
        mine = [x for x in nodes if bucket == 5 or x[1] < 2]
        assert met == {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(mine, 2) if x != y}


def test_a_crowd_of_unlike_texts_meets_by_set_size(spark):
    """Every pair whose sizes allow a link meets in exactly one cell, and rows are copied less often than blocks say."""
    n, p = 10_000, minhash.MinHashParams()
    nodes = [(k, int(5 * 1.0008**k)) for k in range(n)]
    groups = spark.createDataFrame([(k, 0 if k % 10 == 0 else k) for k, _ in nodes], "node long, label long")
    sketches = spark.createDataFrame(nodes, "node long, n long").withColumn("sketch", F.lit(b"x"))
    buckets = groups.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), "node", F.lit(0).cast("long").alias("centre"))
    rows = minhash.unsettled(buckets, groups, sketches, p).select("cell", "side", "node").toPandas()
    assert len(rows) < n * n / p.chunk / 2 and rows.groupby("cell").size().max() <= 4 * p.chunk
    size = dict(nodes)
    rng, held = random.Random(38), {}
    for r in rows.itertuples():
        held.setdefault(r.node, {})[r.cell] = r.side
    for _ in range(20_000):
        a = rng.randrange(n)
        b = min(n - 1, a + rng.randrange(1, 370))
        if a != b and 4 * size[a] >= 3 * size[b] and (a % 10 or b % 10):
            cells = [c for c in held[a].keys() & held[b].keys() if (held[a][c], held[b][c]) in ((0, 1), (1, 0), (2, 2))]
            assert len(cells) == 1


def test_a_pair_meets_in_its_own_bucket_where_an_earlier_one_looks_alike():
    """A band whose keys agree in part only does not count as shared."""
    p = minhash.MinHashParams()
    marks, counts = bytes(p.bins), bytes([0x11]) * (p.bins // 2)
    keys = np.arange(2 * p.bands, dtype="<u8").reshape(2, -1)
    keys[:, 0] |= np.uint64(5 << 48)
    keys[:, 3] = 77
    both = {"bucket": [77, 77], "cell": [0, 0], "side": [0, 1], "band": [3, 3], "node": [1, 2], "part": [1, 2], "n": [128, 128]}
    both["sketch"] = [marks + k.tobytes() + counts for k in keys]
    found = pa.Table.from_batches(minhash._proposal_batches([pa.record_batch(both)], p, None)).to_pydict()
    assert found == {"a": [1], "b": [2]}


def test_a_large_group_of_near_copies_stays_one_group(spark):
    """Every text is near its neighbours in a chain and in a crowd whose ends are unlike each other."""
    rng = random.Random(32)
    w = prose(rng, 60).split()
    rows = []
    for k in range(150):
        w = list(w)
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w), "en"))
    assert sorted(map(tuple, minhash.near_duplicate_groups(documents(spark, rows)).collect())) == brute_groups(rows)


def test_every_signature_bin_is_filled_the_same_way():
    rng = np.random.default_rng(5)
    sets = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    whole = minhash.signature(sets, 128)
    assert len(whole) == 128 and set(whole) <= set(sets)
    small = minhash.signature(sets[:1], 128)
    assert set(small) == {sets[0]}
    other = np.sort(np.concatenate([sets[20:], np.unique(rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]))
    truth = len(np.intersect1d(sets, other)) / len(np.union1d(sets, other))
    assert abs((minhash.signature(other, 128) == whole).mean() - truth) < 0.15


def test_near_duplicate_edge_cases(spark):
    odd = awkward(spark)
    found = minhash.near_duplicate_groups(odd)
    assert found.count() == odd.count()
    by_id = {r.doc_id: r for r in found.where("doc_id is not null").collect()}
    assert by_id[105].component_id == 104 and not by_id[105].kept and by_id[104].kept
    assert by_id[107].component_id == 5 and [r.component_id for r in found.where("doc_id is null and n_shingles > 0").collect()] == [5]
    assert [by_id[k].n_shingles for k in (100, 101, 102, 103)] == [0, 0, 0, 1]
    assert minhash.near_duplicate_groups(odd.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (5, 5), (None, 3), (100, 90)], "a long, b long")
    found = {r.node: r.label for r in connected_components(links).collect()}
    assert found == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(links.limit(0)).count() == 0


# --- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_is_a_path_through_all_cells(spark, dims, bits):
    df = spark.range(1 << (dims * bits)).select("id", sharding.curve_index(F.col("id"), dims, bits).alias("at"))
    cells = [r.id for r in sorted(df.collect(), key=lambda r: r["at"])]
    assert sorted(r["at"] for r in df.collect()) == list(range(1 << (dims * bits)))
    place = lambda c: [(c >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]
    for a, b in itertools.pairwise(cells):
        assert sum(abs(x - y) for x, y in zip(place(a), place(b), strict=True)) == 1


def test_shards_are_even_gapless_and_follow_the_curve(spark):
    rng = random.Random(41)
    rows = [(k, "s" if rng.random() < 0.4 else rng.choice("abcd"), rng.randint(0, 10) if rng.random() < 0.9 else None, rng.random()) for k in range(1001)]
    df = spark.createDataFrame(rows, "id long, source string, size long, x double").withColumn("rank", F.lit(1)).withColumn("cell", F.lit(2))
    placed = sharding.assign_shards(df, "id", ["source", "size", "x"], 8).collect()
    assert len({r.id for r in placed}) == 1001
    sizes = [sum(r.shard == s for r in placed) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sizes[s]))
    order = sorted(placed, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in placed)


def test_shards_prune_better_than_a_sort_on_one_column(spark):
    rng = random.Random(42)
    df = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(4000)], "id long, x double, y double")
    placed = sharding.assign_shards(df, "id", ["x", "y"], 16).toPandas()
    spans = placed.groupby("shard")[["x", "y"]].agg(lambda v: v.max() - v.min())
    assert spans.mean().max() < 0.5


def test_strings_with_one_prefix_are_told_apart(spark):
    rng = random.Random(43)
    rows = [(k, f"https://www.example.org/{rng.choice('abcdefgh') * 3}/{k % 50}", rng.random()) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, url string, x double")
    for most in (10_000, 60):
        placed = sharding.assign_shards(df, "id", ["url"], 8, most_values=most).collect()
        order = [r.url for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
        assert len({r.curve_index for r in placed}) >= 8
        spans = [set(u[len("https://www.example.org/")] for u in order[k * 250 : (k + 1) * 250]) for k in range(8)]
        assert sum(map(len, spans)) <= 24


def test_split_points_come_from_every_value(spark):
    """Exact ranks where a column has more values than the driver adds up, and the same where it has fewer."""
    rng = random.Random(45)
    rows = [(None if k % 50 == 0 else f"u{rng.randint(0, 700) ** 2}", None if k % 40 == 0 else rng.choice([math.nan, -0.0, 0.0, rng.gauss(0, 1), 7.0]), k % 900) for k in range(3000)]
    df = spark.createDataFrame(rows, "url string, x double, k long").repartition(7)
    want = []
    for d in range(3):
        some = sorted((r[d].encode() if isinstance(r[d], str) else float(r[d]) for r in rows if r[d] is not None), key=lambda v: (v != v, v))
        ranks = dict.fromkeys(some[math.ceil(j * len(some) / 16) - 1] for j in range(1, 16))
        want.append([repr(v) for v in ranks if v == v])
    for most in (10_000, 300):
        found = sharding.split_points(df, ["url", "x", "k"], 16, most_values=most)
        assert [[repr(v + 0.0 if isinstance(v, float) else v) for v in points if v == v] for points in found] == want
    assert sharding.split_points(df.limit(0), ["url", "x"], 16, most_values=0) == [[], []]


def test_sharding_edge_cases(spark):
    odd = awkward(spark)
    placed = sharding.assign_shards(odd, "doc_id", ["source", "lang", "n_chars"], 4)
    assert placed.count() == odd.count() and placed.where("shard is null or slot is null").count() == 0
    assert placed.select("shard", "slot").distinct().count() == odd.count()
    assert sharding.assign_shards(odd.limit(0), "doc_id", ["source"], 4).count() == 0
    few = sharding.assign_shards(odd.limit(2), "doc_id", ["source"], 8)
    assert few.select("shard").distinct().count() == 2


def test_shards_are_written_in_curve_order(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 37 % 200).alias("x"))
    sharding.write_shards(sharding.assign_shards(df, "id", ["x"], 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


# --- packing ------------------------------------------------------------------------------------


def test_packing_holds_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(51)
    rows = [(k, prose(rng, rng.choice([0, 3, 40, 400, 3000])), "en") for k in range(80)] + [(200, None, None), (201, "a <|endoftext|> b", "en"), (202, "Ünï 漢字 \n\n x", "en")]
    pieces = packing.pack(documents(spark, rows).repartition(3)).collect()
    ids = {i: [*full.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    for i, want in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, dtype="<u4") for p in mine]).tolist() == want
        assert [p.start for p in mine] == np.cumsum([0] + [p.length for p in mine])[:-1].tolist()
        assert {p.doc_tokens for p in mine} == {len(want)}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for members in sequences.values():
        members.sort(key=lambda p: p.offset)
        assert [p.offset for p in members] == np.cumsum([0] + [p.length for p in members])[:-1].tolist()
        total = sum(p.length for p in members)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def counted(texts, p):
    """Document frequencies of some texts, as one task counts them."""
    found = next(packing._frequency_batches(iter([pa.record_batch({"text": pa.array(texts, type=pa.string())})]), p)).column("counts")
    total = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in found])
    return packing.Frequencies(*total[p.slots : p.slots + 3].tolist(), total[: p.slots])


def test_encoding_by_units_is_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(55)
    parts = ["a", "b1", " ", "  ", "\n", "\r\n ", "\t", "\u00a0", "\u3000", "\u2009", "\x1c", "\x85", "é", "漢字", "don't", "!?", " !", "x\u00a0", "12", "😀", "Zebra", "_", "\u200b", "\ufeff"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " ", " a", "a ", "plain words in a row"]
    for some in (pa.array(texts), pa.array(texts).slice(7, 400), pa.array([None, ""], type=pa.string())):
        found = packing.encode(some, packing.PackParams())
        for text, ids in zip(some.to_pylist(), found, strict=True):
            assert ids.tolist() == [*full.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_documents_of_a_topic_meet_from_anywhere_in_the_table(spark):
    """Shards are built of documents that share rare words, not of neighbouring rows, and not by batches."""
    rng = random.Random(54)
    topics = [[f"t{k}w{j}" for j in range(25)] for k in range(40)]
    rows = [(k, prose(rng, 20) + " " + " ".join(rng.choice(topics[k % 40]) for _ in range(30)), "en") for k in range(800)]
    p = packing.PackParams(shard_bytes=8000, window=512)
    packed = {}
    for size in ("4m", "2k"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        packed[size] = packing.pack(documents(spark, rows).repartition(5), p=p).collect()
    assert sorted(map(tuple, packed["4m"])) == sorted(map(tuple, packed["2k"]))
    together, mates = {}, 0
    for r in packed["4m"]:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 40)
    full = [t for s, t in together.items() if sum(r.length for r in packed["4m"] if r.sequence_id == s) == 512]
    mates = sum(len(t) for t in full) / len(full)
    per_window = 512 * 800 / sum(r.length for r in packed["4m"])
    assert mates < 0.6 * per_window


def test_words_that_gather_too_many_are_split(spark):
    rows = [(k, "same words in every text " + str(k % 3), "en") for k in range(500)]
    p = packing.PackParams(shard_bytes=2000)
    f = counted([t for _, t, _ in rows], p)
    from basinflow.llm import textkit

    route, parts = packing.routes(textkit.words(pa.array([t for _, t, _ in rows])), f, p)
    assert (parts >= 2).all() and (route >= 0).all()
    assert packing.pack(documents(spark, rows), p=p).where("start = 0").count() == 500


@pytest.mark.parametrize("slots", [1 << 12, 1 << 27])
def test_routes_follow_the_definition(slots):
    """A document goes by its rarest word that gathers, of equally rare ones by the smallest slot; pairs of a
    document and a word are told apart by one sort of narrow numbers, or of wide ones where those are too few."""
    from basinflow.llm import textkit

    rng = random.Random(56)
    texts = [prose(rng, rng.choice([0, 1, 5, 60])) + rng.choice(["", " rare" + str(rng.randint(0, 9))]) for _ in range(150)] + [None, ""]
    p = packing.PackParams(slots=slots, shard_bytes=3000, part_rows=40)
    w = textkit.words(pa.array(texts))
    held = [sorted({int(h) & (slots - 1) for h in w.hashes[w.offsets[d] : w.offsets[d + 1]]}) for d in range(len(texts))]
    doc, slot = packing.distinct_slots(w, slots)
    assert list(zip(doc.tolist(), slot.tolist(), strict=True)) == [(d, x) for d, some in enumerate(held) for x in some]
    f = packing.Frequencies(len(texts), len(w.hashes), len(w.data), np.bincount(slot, minlength=slots))
    least, rows = max(2.0, p.gather * p.shard_bytes * f.docs / f.size), min(p.part_rows, max(1, p.shard_bytes * f.docs // f.size))
    route, parts = packing.routes(w, f, p)
    for d, some in enumerate(held):
        rarest = min(((int(f.by_slot[x]), x) for x in some if f.by_slot[x] >= least), default=(f.docs, -1))
        assert (route[d], parts[d]) == (rarest[1], max(1, -(-rarest[0] // rows)))


def test_values_are_coded_by_one_pass():
    from basinflow.llm import textkit

    values = np.array([5, 2**63, 5, 0, 2**63, 7], dtype=np.uint64)
    code, found = textkit.coded(values)
    assert found[code].tolist() == values.tolist() and len(found) == 4
    assert textkit.distinct(values).tolist() == [0, 5, 7, 2**63]
    assert [len(x) for x in textkit.coded(values[:0])] == [0, 0] and len(textkit.distinct(values[:0])) == 0


def test_windows_are_filled_with_lexical_neighbours():
    import pyarrow as pa

    from basinflow.llm import textkit

    rng = random.Random(52)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    order = [k % 6 for k in range(60)]
    texts = [" ".join(rng.choice(topics[k]) for _ in range(100)) for k in order]
    p = packing.PackParams()
    index = packing.ShardIndex(textkit.words(pa.array(texts)), counted(texts, p), p)
    scores = index.scores(0)
    same = [k for k in range(60) if order[k] == 0]
    assert min(scores[same]) > max(np.delete(scores, same))
    pieces = packing.fill(np.full(60, 100), index, 1000)
    first = [order[d] for d, _, _, s, _ in pieces if s == 0]
    assert first.count(first[0]) == 10


def test_bm25_scores_follow_the_definition():
    import math

    import pyarrow as pa

    from basinflow.llm import textkit

    rng = random.Random(53)
    texts = [prose(rng, rng.randint(5, 50)) for _ in range(20)] + ["", None]
    p = packing.PackParams()
    index = packing.ShardIndex(textkit.words(pa.array(texts)), counted(texts, p), p)
    bags = [words(t) for t in texts]
    mean = np.mean([len(b) for b in bags])
    for q in (0, 7, 20):
        want = [sum(math.log1p((22 - n + 0.5) / (n + 0.5)) * b.count(t) * (p.k1 + 1) / (b.count(t) + p.k1 * (1 - p.b + p.b * len(b) / mean)) for t in set(bags[q]) if t in b for n in [sum(t in c for c in bags)]) for b in bags]
        assert index.scores(q) == pytest.approx(want, rel=1e-5)


def test_packing_edge_cases(spark):
    odd = awkward(spark)
    pieces = packing.pack(odd)
    assert pieces.where("start = 0").count() == odd.count()
    assert pieces.where("doc_id = 104").agg(F.sum("length")).first()[0] == pieces.where("doc_id = 104").first().doc_tokens
    assert packing.pack(odd.limit(0)).count() == 0


# --- archives -----------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(61)
    body = "<html>" + prose(rng, 60) + "</html>"
    rows = [(k, f"http://h{k % 3}/p{k}", "<p>" + prose(rng, rng.randint(20, 200)) + "</p>") for k in range(50)]
    rows += [(60, None, body), (55, "http://x/1", body), (58, "http://x/2\r\nEvil: 1", body), (70, "u", None), (71, "u", ""), (72, "u", "short"), (73, "u", "short")]
    rows += [(80, "ü", "é" * 49 + "ab"), (81, "u", "é" * 49 + "ab"), (82, "u", "é" * 49 + "a"), (83, "u", "é" * 49 + "a"), (90, "u", "WARC/1.1\r\n\r\n" * 20), (91, "u", "z" * 3_000_000)]
    return rows


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "file", "offset", "first")})


@pytest.mark.parametrize("p", [warc.WarcParams(), warc.WarcParams(hot_rows=2)])
def test_archives_round_trip(spark, p):
    rows = page_rows()
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows).repartition(3), folder, p=p)
    back = {r.page_id: r for r in warc.read_archives(index, folder).collect()}
    firsts = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        if len(data) >= 100:
            firsts.setdefault(data, i)
    assert len(back) == len(rows)
    for i, url, html in rows:
        data, r = (html or "").encode(), back[i]
        first = firsts.get(data, i)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload == (data if first == i else None)
        assert r.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_selected_records_are_read_by_range(spark):
    rows = page_rows()
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows), folder)
    places = index.orderBy("file", "offset").collect()
    for a, b in itertools.pairwise(places):
        assert b.file != a.file or b.offset == a.offset + a.length
    wanted = index.where("page_id in (3, 7, 55, 91)")
    for p in (warc.WarcParams(), warc.WarcParams(gap=-1, read_bytes=1)):
        assert sorted(r.page_id for r in warc.read_archives(wanted, folder, p).collect()) == [3, 7, 55, 91]


def test_members_are_standard_records(spark):
    data = warc.record("response", 5, "http://a/", b"<p>", 3, "ab")
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and "WARC-Type: response" in lines and rest.endswith(b"<p>\r\n\r\n")
    length = next(int(x.split(": ")[1]) for x in lines if x.startswith("Content-Length"))
    assert len(rest) == length + 4
    assert warc.parse(data)["payload"] == b"<p>"


def test_archive_edge_cases(spark):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, "u", "x" * 200), (2, "u", "x" * 200), (None, None, None)]
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows), folder)
    back = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(index, folder).collect()), key=str)
    assert back == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "revisit", 1), (None, "response", None)], key=str)
    empty = warc.write_archives(pages(spark, rows).limit(0), fresh_path(spark, "warc-test"))
    assert empty.count() == 0


# --- pipeline -----------------------------------------------------------------------------------


def corpus(tmp_path, spark):
    rng = random.Random(71)
    rows, labels, items = [], [], [(k, prose(rng, 16)) for k in range(10)]
    for k in range(400):
        kind = k % 8
        text = prose(rng, rng.randint(40, 90))
        if kind == 0:
            text += " you " + rng.choice(["idiot", "scum", "pathetic"])
        if kind == 1:
            text = "$$$ !!! ### " * rng.randint(20, 40)
        rows.append((k, text, "en"))
        if k < 300:
            labels.append((k, int(kind != 1), int(kind == 0)))
    clean = [r for r in rows if r[0] % 8 > 1]
    rows += [(1000 + k, clean[k][1], "en") for k in range(30)]
    rows += [(2000 + k, prose(rng, 50) + " " + t + " " + prose(rng, 30), "en") for k, t in items]
    rows += [(None, prose(rng, 60), "en"), (None, prose(rng, 60), None), (5, rows[5][1], "en")]
    docs = documents(spark, rows)
    sf = str(tmp_path)
    docs.repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, rows


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    sf, docs, rows = corpus(tmp_path, spark)
    kept, columns = spark.read.parquet(f"{sf}/documents.parquet"), docs.columns
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns
        assert kept.schema.simpleString() == docs.schema.simpleString()
        path = f"{sf}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids[name] = [r.doc_id for r in kept.select("doc_id").collect()]
    toxic, junk = {k for k in range(400) if k % 8 == 0}, {k for k in range(400) if k % 8 == 1}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(ids["toxicity"]) >= len(rows) - len(toxic) - 3
    assert not junk & set(ids["quality"]) and len(ids["quality"]) >= len(ids["toxicity"]) - len(junk) - 5
    assert not {1000 + k for k in range(30)} & set(ids["near_duplicates"])
    assert ids["near_duplicates"].count(5) == 1 and ids["near_duplicates"].count(None) == 2
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {2000 + k for k in range(10)}
    assert ids["decontamination"].count(None) == 2
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.collect()} == set(ids["decontamination"])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    sf, docs, _ = corpus(tmp_path, spark)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


# --- queries ------------------------------------------------------------------------------------


def test_neighbour_query_equals_exact_sql(compare):
    compare("op4_hnsw")


def test_archive_query_equals_sql(compare):
    compare("op10_warc")


def test_near_duplicate_query_equals_sql(compare):
    compare("op7_minhash_near_dedup")


def test_digests_of_pieces(spark):
    from basinflow.llm.queries import digest_pieces

    rows = digest_pieces(packing.pack(documents(spark, [(1, "hello world", "en")]))).collect()
    data = b"".join(int(x).to_bytes(4, "little") for x in packing.encode(pa.array(["hello world"]), packing.PackParams())[0])
    assert [(r.start, r.length, r.ids_crc32) for r in rows if r.start == 0 and r.length * 4 == len(data)] in ([(0, len(data) // 4, zlib.crc32(data))], [])
    assert Fraction(sum(r.length for r in rows), 1) == len(data) // 4
