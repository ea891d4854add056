"""Neighbour graphs, densities, persistence and evaluation against plain Python, and edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basinflow.functions.vectors import ln_factorial, normalised, pnorm
from basinflow.operators import coreset, density, evaluation, finetune, knn, modes, persistence, reduction
from basinflow.operators.knn import Codebooks, InvertedFile, Knn
from basinflow.sources import archive, metrics, tables


def plain_sweep(near, f, tau, greedy=False):
    """The sequential definition, written for clarity."""
    root = list(range(len(f)))
    pairs = []
    for i in sorted(range(len(f)), key=lambda v: (-f[v], v)):
        up = [j for j in near[i] if f[j] > f[i]]
        if not up:
            continue
        seen = list(dict.fromkeys(root[j] for j in up))
        top = max(seen, key=lambda r: f[r])
        root[i] = top if greedy else root[max(up, key=lambda j: f[j])]
        for c in seen:
            if c != top and f[c] - f[i] < tau:
                root = [top if r == c else r for r in root]
                pairs.append((c, i))
    return root, sorted(pairs), sorted(set(root))


def random_graphs(count, seed=5):
    """Disjoint graphs as one: ragged lists, ties, loops; vertex ids shifted per graph."""
    rng = random.Random(seed)
    near, f = [], []
    for _ in range(count):
        base, n = len(f), rng.randint(1, 40)
        levels = [rng.choice([rng.random(), rng.randint(0, 5) / 5]) for _ in range(n)]
        f += levels
        near += [[base + rng.randrange(n) for _ in range(rng.randint(0, 6))] for _ in range(n)]
    return near, f


def h0(spark, near, f, taus, greedy=False, **how):
    cluster = persistence.cluster_h0_greedy if greedy else persistence.cluster_h0
    assignment, pairs = cluster(*tables.graph_table(spark, f, near), taus, **how)
    roots, ends = {}, {}
    for r in assignment.collect():
        roots.setdefault(r.tau, {})[r.i] = r.root
    for r in pairs.collect():
        ends.setdefault(r.tau, []).append((r.birth, r.death))
    return roots, ends


def check_against_plain(spark, near, f, taus, greedy=False, **how):
    roots, ends = h0(spark, near, f, taus, greedy, **how)
    for tau in taus:
        root, finite, alive = plain_sweep(near, f, tau, greedy)
        assert [roots[tau][i] for i in range(len(f))] == root
        assert sorted(p for p in ends[tau] if p[1] is not None) == finite
        assert sorted(b for b, d in ends[tau] if d is None) == alive


@pytest.mark.parametrize("greedy", [False, True])
def test_contracted_sweep_equals_the_plain_one(spark, greedy):
    near, f = random_graphs(150)
    check_against_plain(spark, near, f, [0.0, 0.1, 0.3, 0.7, math.inf], greedy)


def test_greedy_with_infinite_densities(spark):
    near = [[], [], [0, 1], [2, 0], [1, 2]]
    check_against_plain(spark, near, [math.inf, math.inf, 2.0, 1.0, -math.inf], [0.0, math.inf], greedy=True)


def test_four_vertices(spark):
    roots, ends = h0(spark, [[2], [0], [1], [1, 2]], [1.0, 2.0, 3.0, 2.5], [0.0, 5.0])
    assert roots[0.0] == roots[5.0] == {0: 2, 1: 1, 2: 2, 3: 2}
    assert sorted(ends[5.0]) == [(1, None), (2, None)]


def test_nine_vertices(spark):
    near = [[1, 3], [0], [0, 1], [1, 3], [1, 2], [2, 3, 4], [5, 6, 0], [2, 1, 4], [5, 4, 0]]
    f = [1.0, 2.0, 3.0, 2.5, 5.0, 3.5, 4.1, 0.5, 2.7]
    assignment, pairs = persistence.cluster_h0(*tables.graph_table(spark, f, near), [10.0, 0.0])
    at = {t: {r.i: r.root for r in assignment.where(F.col("tau") == t).collect()} for t in (10.0, 0.0)}
    assert [at[10.0][i] for i in range(9)] == [4, 4, 4, 4, 4, 4, 6, 4, 4]
    assert [at[0.0][i] for i in range(9)] == [3, 1, 2, 3, 4, 4, 6, 4, 4]
    ranked = persistence.persistence_pairs(pairs.where("tau = 10"), tables.graph_table(spark, f, near)[1])
    assert [(r.birth, r.death, round(r.persistence, 9)) for r in ranked.where("death is not null").orderBy("rank").collect()] == [(2, 7, 2.5), (3, 7, 2.0), (1, 0, 1.0)]
    assert [r.birth for r in persistence.components(ranked).orderBy("position").collect()] == [4, 6, 2, 3, 1]
    assert [r.x for r in persistence.rank_curve(ranked).orderBy("x").collect()] == [3, 4, 5]
    assert persistence.losses(ranked, 2).first().asDict() == {"saliency": -2.5, "shrinkage": 3.0, "loss": 0.5}


@pytest.mark.parametrize(
    ("tau", "expected"),
    [
        (0.0, [0, 1, 2, 2, 4, 5, 6, 8, 8, 9, 10]),
        (0.31, [0, 1, 2, 2, 2, 5, 6, 8, 8, 9, 10]),
        (0.51, [0, 1, 2, 2, 2, 5, 8, 8, 8, 9, 10]),
        (0.56, [0, 1, 8, 8, 8, 5, 8, 8, 8, 9, 10]),
    ],
)
@pytest.mark.parametrize("greedy", [False, True])
def test_plateaus(spark, tau, expected, greedy):
    roots, _ = h0(spark, tables.ELEVEN_NEIGHBOURS, tables.ELEVEN_DENSITIES, [tau], greedy)
    assert [roots[tau][i] for i in range(11)] == expected


def test_merging_is_strict_and_infinite_roots_stay(spark):
    roots, _ = h0(spark, [[], [], [0, 1]], [2.0, 1.5, 1.0], [0.5, 0.6])
    assert roots[0.5] == {0: 0, 1: 1, 2: 0}
    assert roots[0.6] == {0: 0, 1: 0, 2: 0}
    roots, _ = h0(spark, [[], [], [0, 1]], [math.inf, math.inf, 1.0], [math.inf])
    assert roots[math.inf] == {0: 0, 1: 1, 2: 0}


def test_bad_graphs_are_errors(spark):
    with pytest.raises(ValueError):
        tables.graph_table(spark, [1.0], [[0], [0]])
    with pytest.raises(ValueError):
        tables.graph_table(spark, [math.nan], [[]])
    edges, dens = tables.graph_table(spark, [1.0], [[0]])
    with pytest.raises(Exception, match="not a number"):
        persistence.cluster_h0(edges, dens.withColumn("f", F.lit(math.nan)), [0.0])


def test_empty_graph(spark):
    edges, dens = (spark.createDataFrame([], s) for s in ("i long, rk int, j long", "i long, f double"))
    assignment, pairs = persistence.cluster_h0(edges, dens, [0.0, math.inf])
    assert assignment.count() == pairs.count() == 0


def test_counts_for_every_threshold_from_one_run(spark):
    near, f = random_graphs(20, seed=9)
    edges, dens = tables.graph_table(spark, f, near)
    taus = [0.0, 0.2, 0.5, math.inf]
    _, every = persistence.cluster_h0(edges, dens, taus)
    whole = every.where(F.col("tau") == math.inf)
    counts = {r.tau: r.clusters for r in persistence.cluster_counts(whole, taus).collect()}
    for tau in taus:
        rows = every.where(F.col("tau") == tau)
        assert counts[tau] == rows.where("death is null").count()
        below = persistence.pairs_below(whole, tau).select("birth", "death")
        assert sorted(map(tuple, below.collect())) == sorted(map(tuple, rows.where("death is not null").select("birth", "death").collect()))


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_search_in_chunks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 5)), 1).astype(np.float32)
    x = points(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    wide = vectors.astype(float)
    for spec, dist in ((Knn(7), lambda d: (d**2).sum(-1)), (Knn(7, p=3, root=True), lambda d: (np.abs(d) ** 3).sum(-1) ** (1 / 3)), (Knn(7, p=math.inf), lambda d: np.abs(d).max(-1)), (Knn(7, p=-math.inf), lambda d: np.abs(d).min(-1))):
        far = np.round(dist(wide[:, None] - wide[None]), 9)
        best = [sorted(range(300), key=lambda j, i=i: (far[i, j], j))[:7] for i in range(300)]
        found = knn.knn_exact(x, spec, chunk_rows=64).collect()
        got = {(r.i, r.rk): (r.j, r.dist) for r in found}
        assert len(got) == 2100
        assert all(abs(got[i, k + 1][1] - far[i, j]) < 1e-9 for i, row in enumerate(best) for k, j in enumerate(row))


def test_search_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0), (4, [float("nan"), 0.0], 0), (5, [], 0), (None, [1.0, 0.0], 0), (6, [1.0, 2.0, 3.0], 0), (7, [None, 1.0], 0), (2, [1.0, 0.0], 0)]
    x = points(spark, rows).withColumn("dist", F.lit("clash")).withColumn("cell", F.lit(9))
    got = sorted((r.i, r.rk, r.j, r.dist) for r in knn.knn_exact(x, Knn(10)).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0), (2, 3, 2, 0.0), (6, 1, 6, 0.0)]
    assert knn.knn_exact(x.limit(0), Knn(3)).count() == 0
    packed = {r.i: [s.j for s in r.neighbours] for r in knn.packed(knn.knn_exact(x, Knn(2))).collect()}
    assert packed == {1: [1, 2], 2: [1, 2], 6: [6]}


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 4
    vectors = (centres[rng.integers(0, 8, 600)] + rng.normal(size=(600, 16))).astype(np.float32)
    x = points(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    exact = {(r.i, r.j) for r in knn.knn_exact(x, Knn(5)).collect()}
    file = InvertedFile.fit(x, Knn(5), nlist=8)
    assert {(r.i, r.j) for r in knn.knn_ivf(x, file, nprobe=8, chunk_rows=50).collect()} == exact
    some = {(r.i, r.j) for r in knn.knn_ivf(x, file, nprobe=2).collect()}
    assert len(some & exact) / len(exact) > 0.95
    for width in (4, 5):  # the last of the narrower books holds one dimension
        found = knn.knn_ivfpq(x, file, Codebooks.fit(x, file, bits=4, width=width), nprobe=4).collect()
        assert len({(r.i, r.j) for r in found} & exact) / len(exact) > 0.95
        assert all(abs(r.dist - ((vectors[r.i].astype(float) - vectors[r.j]) ** 2).sum()) < 1e-9 for r in found)


def test_recall_of_the_searches_on_embeddings(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = {(r.i, r.j) for r in knn.knn_exact(x, Knn(10)).collect()}
    file = InvertedFile.fit(x, Knn(10), nlist=5)
    for found in (knn.knn_ivf(x, file, nprobe=4), knn.knn_ivfpq(x, file, Codebooks.fit(x, file), nprobe=4)):
        assert len({(r.i, r.j) for r in found.collect()} & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("one_task", [0, 40])
def test_merge_tree_in_rounds_equals_the_plain_sweep(spark, one_task):
    near, f = random_graphs(70, seed=11)
    check_against_plain(spark, near, f, [0.0, 0.1, 0.3, 0.7, math.inf], one_task=one_task)


def test_rounds_with_many_basins_at_a_saddle(spark):
    """Saddles of three basins and more, few heights (so many ties), and infinite ones."""
    rng = random.Random(12)
    near, f = [], []
    for _ in range(40):
        base, peaks, n = len(f), rng.randint(3, 9), rng.randint(3, 14)
        f += [rng.choice([3.0, 4.0, 5.0, 3.5 + rng.random(), math.inf]) for _ in range(peaks)] + [rng.choice([rng.random() * 3, 1.0, 2.0]) for _ in range(n)]
        near += [[] for _ in range(peaks)] + [[base + rng.randrange(peaks + n) for _ in range(rng.randint(2, 5))] for _ in range(n)]
    check_against_plain(spark, near, f, [0.0, 1.0, 2.0, 2.5, 3.0, math.inf], one_task=0)


def test_a_chain_of_waiting_clusters(spark):
    """Heights fall and saddles rise along a path: each cluster waits for the next."""
    n = 8
    peaks, passes = [100.0 - k for k in range(n)], [10.0 + k for k in range(n - 1)]
    near = [[] for _ in peaks] + [[k, k + 1] for k in range(n - 1)]
    check_against_plain(spark, near, peaks + passes, [0.0, 84.0, 88.0, math.inf], one_task=0)


@pytest.mark.parametrize("hot_rows", [3, 1 << 18])
def test_pointers_in_rounds_equal_one_task(spark, hot_rows):
    rng = random.Random(13)
    parent = [i if i < 5 or rng.random() < 0.02 else rng.randrange(max(0, i - 9), i) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(parent)), "i long, parent long")
    root = {}
    for i, p in enumerate(parent):
        root[i] = i if p == i else root[p]
    for one_task in (0, 1 << 20):
        assert {r.i: r.root for r in modes.seek_modes(df, one_task, hot_rows).collect()} == root
    assert modes.seek_modes(df.limit(0)).count() == modes.seek_modes(df.limit(0), 0).count() == 0


def test_keys_that_many_rows_share_are_joined_where_they_are(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("key"))
    table = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    found = {r.id: r.x for r in modes.join_unique(rows, table, "key", hot_rows=100).collect()}
    assert found == {i: 2 if i < 600 else 2 * i for i in range(900)}


def test_too_many_labels_for_one_task_are_an_error():
    with pytest.raises(ValueError, match="more than one task"):
        evaluation._assign(pd.DataFrame({"truth": range(20_000), "pred": range(20_000), "n": 1}))


def test_density_of_coinciding_points_is_infinite(spark):
    found = knn.knn_exact(points(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [2.0], 0)]), Knn(2))
    assert {r.i: r.f for r in density.log_density(found, 1, 2).collect()} == {1: math.inf, 2: math.inf, 3: pytest.approx(0.5 * math.log(2))}
    assert {r.f for r in density.dtm_density(found.where("rk = 1"), 1).collect()} == {math.inf}
    with pytest.raises(ValueError):
        density.dtm_density(found, 1, normalize=True)


def test_pnorm_of_null_and_unequal_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], None), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(pnorm(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(11)
    for rows, cols in ((1, 1), (2, 5), (4, 4), (3, 6), (5, 5)):
        gain = rng.integers(0, 9, size=(rows, cols)).astype(float)
        best = max(sum(gain[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(cols), rows))
        chosen = evaluation.maximum_assignment(gain)
        assert len(set(chosen)) == rows
        assert gain[np.arange(rows), chosen].sum() == best


@pytest.mark.parametrize("seed", range(4))
def test_sparse_assignment_is_as_good_as_the_matrix(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for block in range(6):  # parts of their own, some of them of certain pairs alone
        for _ in range(rng.randint(1, 14)):
            rows[10 * block + rng.randrange(5), 100 + 10 * block + rng.randrange(6)] = rng.choice([0, 1, 1, 2, 3, 50])
    table = spark.createDataFrame([(t, p, n) for (t, p), n in rows.items()], "truth long, pred long, n long")
    gain = {(r.truth, r.pred): r.n for r in table.collect()}
    plain = evaluation.optimal_assignment(table).collect()
    found = evaluation.optimal_assignment(table, whole_cells=0).orderBy("position").collect()
    assert sum(gain.get((r.truth, r.pred), 0) for r in found) == sum(gain.get((r.truth, r.pred), 0) for r in plain)
    assert len(found) == len(plain) == len({r.truth for r in found}) == len({r.pred for r in found})
    assert [r.position for r in found] == list(range(len(found))) and [r.truth for r in found] == sorted(r.truth for r in found)
    few = evaluation.sparse_assignment(table, rounds=0).collect()  # all by parts
    assert sum(gain.get((r.truth, r.pred), 0) for r in few) == sum(gain.get((r.truth, r.pred), 0) for r in plain)
    assert evaluation.sparse_assignment(table.limit(0)).count() == 0


def test_measures_of_many_tables_at_once(spark):
    rng = random.Random(61)
    rows = [(c, t, p, rng.randint(0, 9)) for c in range(3) for t in range(3 + c) for p in range(10, 14)] + [(7, 1, 1, 5)]
    table = spark.createDataFrame([r for r in rows if r[3]], "cell int, truth long, pred long, n long")
    by = ["cell"]
    every = evaluation.adjusted_mutual_information(table, by).join(evaluation.normalized_mutual_information(table, by), "cell").join(evaluation.accuracies(table, "cell"), "cell").collect()
    mixed = {r.cell: r.accuracy for r in evaluation.accuracies(table, "cell", whole_cells=12).collect()}
    assert {r.cell for r in every} == {0, 1, 2, 7}
    for r in every:
        one = table.where(F.col("cell") == r.cell).drop("cell")
        assert abs(r.ami - evaluation.adjusted_mutual_information(one).first().ami) < 1e-9
        assert abs(r.nmi - evaluation.normalized_mutual_information(one).first().nmi) < 1e-9
        assert abs(r.accuracy - evaluation.clustering_accuracy(one).first().accuracy) < 1e-9 and abs(r.accuracy - mixed[r.cell]) < 1e-9


def test_more_classes_than_clusters_keeps_the_right_names(spark):
    rows = [(0, 5)] * 1 + [(7, 5)] * 4 + [(9, 5)] * 2
    table = evaluation.contingency(spark.createDataFrame(rows, "truth int, pred int"), "truth", "pred")
    assert [(r.pred, r.truth) for r in evaluation.optimal_assignment(table).collect()] == [(5, 7)]
    assert evaluation.clustering_accuracy(table).first()[0] == pytest.approx(100 * 4 / 7)


def test_perfect_clusters_under_other_names(spark):
    df = spark.createDataFrame([(i % 3, 0, 10 - i % 3) for i in range(30)], "s int, g int, pred int")
    found = {r.metric: r.value for r in evaluation.clustering_metrics(df, "pred", "s", "g", 1, "run").collect()}
    assert found == {k: pytest.approx(1.0) for k in ("run/ARI", "run/AMI", "run/NMI", "run/Cluster_Acc/0", "run/Cluster_Acc/1", "run/Cluster_Acc/2", "run/Cluster_Acc/Total")}


def test_trivial_labellings(spark):
    table = evaluation.contingency(spark.createDataFrame([(1, 1)] * 4 + [(None, 1)], "truth int, pred int"), "truth", "pred")
    assert [m(table).first()[0] for m in (evaluation.adjusted_rand, evaluation.adjusted_mutual_information, evaluation.normalized_mutual_information)] == [1.0, 1.0, 1.0]
    square = sorted(map(tuple, evaluation.dense_cost(table, 2).collect()))
    assert square == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 4)]


def test_ln_factorial(spark):
    got = {r.id: r.v for r in spark.range(0, 400, 7).select("id", ln_factorial(F.col("id")).alias("v")).collect()}
    assert all(v == pytest.approx(math.lgamma(k + 1), rel=1e-13, abs=1e-13) for k, v in got.items())


def test_core_sets_are_farthest_first(spark):
    rng = np.random.default_rng(2)
    x = points(spark, [(i, rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(60)])
    vectors = {r.vec_id: np.array(r.embedding) for r in x.collect()}
    found = coreset.greedy_core_sets(x, budget=8, oversampling_factor=3, num_batches=3).orderBy("batch", "position").collect()
    batches = [[r.id for r in found if r.batch == b] for b in range(3)]
    assert [len(set(b)) for b in batches] == [8, 8, 8] and batches[0] != batches[1]
    for batch in batches:
        gaps = [min(((vectors[a] - vectors[b]) ** 2).sum() for b in batch[:k]) for k, a in enumerate(batch) if k]
        assert gaps == sorted(gaps, reverse=True)
    assert coreset.greedy_core_sets(x.limit(5), 8, 3).count() == 5


def test_dense_index_numbers_in_order(spark):
    values = [3, 9, -4, 3, 100, 9]
    got = modes.dense_index(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect()
    assert sorted((r.v, r.n) for r in got) == [(-4, 0), (3, 1), (9, 2), (100, 3)]


def test_projection_and_sample(spark):
    x = points(spark, [(i, [float(i), 1.0], 0) for i in range(50)] + [(99, None, 0)])
    got = {r.vec_id: r.reduced for r in reduction.RandomProjector(2).fit_transform(x).collect()}
    assert got[99] is None and len(got[3]) == 2
    assert np.allclose(np.array(got[4]) - np.array(got[3]), np.array(got[9]) - np.array(got[8]))
    first = [r.vec_id for r in tables.sample_rows(x, 10).collect()]
    assert first == [r.vec_id for r in tables.sample_rows(x.repartition(7), 10).collect()]
    assert tables.sample_rows(x, 500).count() == 51
    with pytest.raises(ValueError):
        reduction.plot_points(x, x)


def test_images_are_listed(spark, tmp_path):
    for name in ("a.png", "b.jpg", ".c.png", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert tables.image_files(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        tables.image_files(spark, str(tmp_path / "empty"))


def test_gather_and_metrics_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, x string")
    ids = spark.createDataFrame([(2,), (2,), (7,)], "vec_id long")
    assert [r.x for r in tables.gather(df, ids).collect()] == ["b", "b"]
    rows = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    path = str(tmp_path / "m")
    assert metrics.read_metrics(spark, path).count() == 0
    for _ in range(2):
        metrics.write_metrics(evaluation.prefixed(rows, "ft"), path, "a/b")
    metrics.write_metrics(rows.withColumn("value", F.lit(None).cast("double")), path, "c")
    assert sorted(tuple(r) for r in metrics.read_metrics(spark, path).collect()) == [("a/b", "ft/m", 1.0), ("c", "m", None)]
    metrics.write_metrics(rows.limit(0), path, "a/b")
    assert [r.run for r in metrics.read_metrics(spark, path).collect()] == ["c"]


def test_a_retried_task_and_a_failed_run_leave_no_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    writer = metrics.MetricWriter(path, "run")
    row = [{"metric": "m", "value": 1.0}]
    lost, kept = writer.write(iter(row)), writer.write(iter(row))  # two attempts at one partition
    assert lost.file != kept.file
    writer.commit([kept, None, metrics.Part(None)])
    assert [tuple(r) for r in metrics.read_metrics(spark, path).collect()] == [("run", "m", 1.0)]
    failed = metrics.MetricWriter(path, "failed")
    failed.abort([failed.write(iter(row)), None])
    bad = spark.createDataFrame([("m", "1"), ("n", "x")], "metric string, value string").select("metric", F.expr("CASE WHEN value = 'x' THEN raise_error('no number') ELSE 2.0D END").alias("value"))
    with pytest.raises(Exception, match="no number"):
        metrics.write_metrics(bad, path, "run")
    assert [tuple(r) for r in metrics.read_metrics(spark, path).collect()] == [("run", "m", 1.0)]


def test_archives_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(31)
    vectors, labels = rng.normal(size=(50, 7)).astype(np.float32), rng.integers(0, 9, 50)
    path = tmp_path / "one.pt"
    path.write_bytes(archive.archive_bytes({"encodings": vectors, "labels": labels, "half": vectors[:, 0].astype(np.float64)}))
    df = archive.read_archives(spark, str(path), split_bytes=200)
    assert df.rdd.getNumPartitions() == 13  # four rows of 44 bytes each
    assert df.schema.simpleString() == "struct<archive:string,row:bigint,encodings:array<float>,labels:bigint,half:double>"
    rows = sorted(df.collect(), key=lambda r: r.row)
    assert np.array_equal(np.array([r.encodings for r in rows], dtype=np.float32), vectors) and [r.labels for r in rows] == labels.tolist()
    system, folder = archive.arrow_folder(str(path))
    tensors, places = archive.describe(system, folder)
    assert tensors["labels"].shape == (50,) and path.read_bytes()[places["0"] :].startswith(vectors.tobytes())


def test_archives_that_hold_anything_else_are_errors(spark, tmp_path):
    import pickle
    import zipfile

    path = tmp_path / "bad.pt"
    for content, match in ((pickle.dumps(print), "not a part of"), (archive.archive_bytes({"a": np.zeros(3), "b": np.zeros(4)}), "one length"), (archive.archive_bytes({"a": np.zeros((2, 2, 2))}), "one or two dim")):
        if content[:2] == b"PK":
            path.write_bytes(content)
        else:
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("x/data.pkl", content)
        with pytest.raises(Exception, match=match):
            archive.read_archives(spark, str(path)).collect()
    with pytest.raises(Exception, match="no archive"):
        archive.read_archives(spark, str(tmp_path / "none")).collect()


def test_archives_round_trip(spark, tmp_path):
    x = points(spark, [(k, [float(k), k / 2], k % 3) for k in range(101)])
    assert archive.write_archives(x.coalesce(2), str(tmp_path / "a"), archive_rows=20) >= 6
    back = archive.read_archives(spark, str(tmp_path / "a"))
    assert sorted((r.ids, r.encodings, r.labels) for r in back.collect()) == [(k, [float(k), k / 2], k % 3) for k in range(101)]
    assert {r.row for r in back.groupBy("archive").agg(F.max("row").alias("row")).collect()} <= set(range(20))
    with pytest.raises(Exception, match="no nulls"):
        archive.write_archives(points(spark, [(1, None, 0)]), str(tmp_path / "b"))


def test_a_core_set_of_the_whole_table_covers_it(spark):
    rng = np.random.default_rng(32)
    vectors = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(3, 3)) + 40])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(900, None, 0), (None, [0.0] * 3, 0), (5, [99.0] * 3, 0)]
    x = points(spark, rows)
    for how in ({"group_rows": 40, "fan_in": 8}, {"group_rows": 20, "fan_in": 3}, {}):
        chosen = coreset.covering_core_set(x, 12, **how)
        found = chosen.orderBy("position").collect()
        assert [r.position for r in found] == list(range(12)) and len({r.id for r in found}) == 12
        assert found[0].distance is None and all(a.distance >= b.distance for a, b in zip(found[1:], found[2:]))
        kept = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows[:303]}
        plain = [vectors[k].astype(np.float32).astype(float) for k in coreset.farthest_first(vectors, 12)]
        cover = lambda centres: max(min(float(np.linalg.norm(v - c)) for c in centres) for v in kept.values())
        radius = cover([kept[r.id] for r in found])
        assert radius <= 4 * cover(plain)
        assert abs(coreset.covering_radius(x.where("vec_id <> 5 or embedding[0] < 99"), chosen).first().radius - radius) < 1e-6
    assert coreset.covering_core_set(x, 1000).count() == 303
    assert coreset.covering_core_set(x.limit(0), 5).count() == 0


def test_core_sets_of_many_groups_are_traversed_together(spark, monkeypatch):
    """Two levels whatever the fan-in, as in SQL; the rounds over all tasks find what one task finds."""
    rng = np.random.default_rng(36)
    vectors = np.concatenate([rng.normal(size=(400, 3)), np.repeat(rng.normal(size=(8, 3)) * 2, 10, axis=0)]).astype(np.float32).astype(float)
    x = points(spark, [(k, v.tolist(), 0) for k, v in enumerate(vectors)])
    key = [hashlib.md5(f"47 {k}".encode()).hexdigest() for k in range(len(vectors))]

    def walk(ids):
        ids = sorted(ids, key=lambda k: key[k])
        return [ids[k] for k in coreset.farthest_first(vectors[ids], 6)]

    parts = {}
    for k in range(len(vectors)):
        parts.setdefault(int(key[k][:7], 16) % 32, []).append(k)
    plain = walk([k for ids in parts.values() for k in walk(ids)])
    for rows, candidates in ((1 << 16, 4096), (10, 4096), (10, 7), (10, 1)):
        monkeypatch.setattr(coreset, "POOL_ROWS", rows)
        monkeypatch.setattr(coreset, "CANDIDATES", candidates)
        found = coreset.covering_core_set(x, 6, group_rows=15, fan_in=3).orderBy("position").collect()
        assert [r.id for r in found] == plain and found[0].distance is None
        for n, r in enumerate(found[1:], 1):
            assert r.distance == pytest.approx(min(np.linalg.norm(vectors[r.id] - vectors[k]) for k in plain[:n]))
    monkeypatch.setattr(coreset, "CANDIDATES", 50)
    assert coreset.covering_core_set(x, 1000, group_rows=240, fan_in=0).count() == 480


def plain_loss(x, k, dim, q, components):
    """Saliency and shrinkage of points by the sequential definition."""
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = [sorted(range(len(x)), key=lambda j, i=i: (far[i, j], j))[:k] for i in range(len(x))]
    f = [-(dim / q) * math.log(np.mean(far[i, near[i]] ** q)) for i in range(len(x))]
    _, pairs, _ = plain_sweep(near, f, math.inf)
    lives = sorted((f[b] - f[d] for b, d in pairs), reverse=True)
    return sum(lives[components - 1 :]) - sum(lives[: components - 1])


def test_fine_tuning_follows_the_slope(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(size=(15, 2)) + c for c in ([0, 0], [4, 0], [0, 5])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = knn.knn_exact(df, Knn(4)).cache()
    dens = density.log_density(found, 2, 2)
    _, pairs = persistence.cluster_h0(found.select("i", "rk", "j"), dens, [math.inf])
    slopes = persistence.persistence_gradient(persistence.persistence_pairs(pairs, dens), 3)
    got = {r.i: r.gradient for r in finetune.point_gradient(df, found, slopes, 2, 2).collect()}
    for i in range(len(x)):
        for d in range(2):
            up, down = x.copy(), x.copy()
            up[i, d] += 1e-6
            down[i, d] -= 1e-6
            slope = (plain_loss(up, 4, 2, 2, 3) - plain_loss(down, 4, 2, 2, 3)) / 2e-6
            assert got.get(i, [0.0, 0.0])[d] == pytest.approx(slope, rel=1e-4, abs=1e-5)
    moved, history = finetune.fine_tune(df, 2, 4, 3, 3)
    assert moved.count() == 45 and history[0]["loss"] == pytest.approx(plain_loss(x, 4, 2, 2, 3))
    assert history[2]["loss"] < history[0]["loss"]


def plain_fine_tune(x, k, q, wanted, iters, o=finetune.AdamW()):
    """Fine-tuning with everything worked out anew in each step, in numpy."""
    n, dim = x.shape
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, iters + 1):
        gaps = x[:, None, :] - x[None, :, :]
        dist = (gaps**2).sum(axis=2)
        near = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), dist), axis=1)[:, :k]
        measure = (np.take_along_axis(dist, near, axis=1) ** q).mean(axis=1)
        f = -dim / q * np.log(measure)
        _, pairs, _ = plain_sweep(near.tolist(), f.tolist(), math.inf)
        pairs.sort(key=lambda p: (-(f[p[0]] - f[p[1]]), p))
        slope = np.zeros(n)
        for rank, (birth, death) in enumerate(pairs, 1):
            sign = -1.0 if rank <= wanted - 1 else 1.0
            slope[birth] += sign
            slope[death] -= sign
        g = np.zeros_like(x)
        for i in np.flatnonzero(slope):
            for j in near[i]:
                w = slope[i] * -dim / measure[i] / k * dist[i, j] ** (q - 1) * 2
                g[i] += w * gaps[i, j]
                g[j] -= w * gaps[i, j]
        m, v = o.beta1 * m + (1 - o.beta1) * g, o.beta2 * v + (1 - o.beta2) * g * g
        x = x * (1 - o.lr * o.weight_decay) - o.lr * (m / (1 - o.beta1**step)) / (np.sqrt(v / (1 - o.beta2**step)) + o.eps)
    return x


@pytest.mark.parametrize("spare", [0, 10])
def test_fine_tuning_equals_everything_anew(spark, spare):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 150")
    held = sorted(rows.collect(), key=lambda r: r.vec_id)
    plain = plain_fine_tune(np.array([r.embedding for r in held], dtype=float), 5, 2, 4, 3)
    found = {r.vec_id: r.embedding for r in finetune.fine_tune(rows, 64, 5, 4, 3, spare=spare)[0].collect()}
    assert max(np.abs(np.array(found[r.vec_id]) - plain[k]).max() for k, r in enumerate(held)) < 1e-6


def test_lists_search_again_only_where_they_must(spark):
    rng = np.random.default_rng(41)
    place = rng.normal(size=(200, 3))
    kept = finetune.NeighbourLists(4, 6)
    for step in range(5):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(place)], "i long, x array<double>")
        found = sorted((r.i, r.rk, r.j, round(r.dist, 9)) for r in kept.nearest(df).collect())
        assert found == sorted((r.i, r.rk, r.j, round(r.dist, 9)) for r in knn.knn_exact(df, Knn(4), id_col="i", vector_col="x").collect())
        place = place + rng.normal(size=place.shape) * 0.01
        place[step] += 1.5  # one that jumps
        place[150:] += 0.001
    assert 0 < kept.searched[0] and kept.searched[1] == 1000


def test_lists_are_not_measured_where_all_fall_short(spark, monkeypatch):
    """The first search's distances are used as they are; after moves beyond every list's reach one search follows, and no join of lists."""
    rng = np.random.default_rng(43)
    kept, joined = finetune.NeighbourLists(4, 2), []
    monkeypatch.setattr(finetune, "merged", lambda *a: joined.append(1) or knn.merged(*a))
    place = rng.normal(size=(200, 3))
    for _ in range(2):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(place)], "i long, x array<double>")
        found = sorted((r.i, r.rk, r.j, round(r.dist, 9)) for r in kept.nearest(df).collect())
        assert found == sorted((r.i, r.rk, r.j, round(r.dist, 9)) for r in knn.knn_exact(df, Knn(4), id_col="i", vector_col="x").collect())
        place = place + rng.normal(size=place.shape)
    assert kept.searched == (200, 400) and not joined


def test_optimiser_step():
    """One AdamW step from rest moves each coordinate by the step size against its slope."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    state = spark.createDataFrame([(1, [1.0, 2.0], [0.0, 0.0], [0.0, 0.0]), (2, [5.0], [0.0], [0.0])], "i long, x array<double>, m array<double>, v array<double>")
    slopes = spark.createDataFrame([(1, [3.0, -0.5])], "i long, gradient array<double>")
    got = {r.i: r for r in finetune.adamw_step(state, slopes, 1).collect()}
    assert got[1].x == pytest.approx([0.9999 - 0.01, 2 * 0.9999 + 0.01], abs=1e-6)
    assert got[2].x == pytest.approx([5 * 0.9999]) and got[1].m == pytest.approx([0.3, -0.05])


def test_densities_straight_from_points(spark):
    x = points(spark, [(i, [float(i * i)], 0) for i in range(6)])
    assert {r.i: r.dtm for r in density.dtm_of_points(x, Knn(2)).collect()}[5] == pytest.approx(math.sqrt(81 / 2))
    plain = {r.i: r.f for r in density.density_of_points(x, Knn(2), 1).collect()}
    scaled = {r.i: r.f for r in density.density_of_points(x, Knn(2), 1, normalize=True).collect()}
    assert scaled[3] == pytest.approx(plain[3] * 1.5 / (6 * 2))


def test_tiles_of_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(9)
    x = points(spark, [(i, rng.normal(size=4).astype(np.float32).tolist(), 0) for i in range(90)])
    one = sorted(tuple(r) for r in knn.knn_exact(x, Knn(5), chunk_rows=90).collect())
    assert len(one) == 450
    assert sorted(tuple(r) for r in knn.knn_exact(x, Knn(5), chunk_rows=7).collect()) == one


def clustered(spark, n, dims, centres, seed=14, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 4
    return points(spark, [(i, (middle[rng.integers(0, centres)] + rng.normal(size=dims) * spread).astype(np.float32).tolist(), 0) for i in range(n)])


@pytest.mark.parametrize("spec", [Knn(5), Knn(5, p=1), Knn(3, p=math.inf), Knn(4, p=3, root=True), Knn(5, normalize=True)])
def test_pruned_search_equals_the_exact_one(spark, spec):
    x = clustered(spark, 400, 4, 6).unionByName(points(spark, [(1000 + k, [0.5, 0.5, 0.5, 0.5], 0) for k in range(30)] + [(2000, None, 0), (2001, [1.0, math.nan, 0.0, 0.0], 0), (None, [0.0] * 4, 0)]))
    exact = sorted(tuple(r) for r in knn.knn_exact(x, spec).collect())
    for count, chunk in ((6, 40), (1, 25), (500, 10)):
        assert sorted(tuple(r) for r in knn.knn_pruned(x, knn.Pivots.fit(x, spec, count), chunk_rows=chunk).collect()) == exact
    y = x.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 5000)
    crossed = sorted(tuple(r) for r in knn.knn_exact(x, spec, y).collect())
    assert sorted(tuple(r) for r in knn.knn_pruned(x, knn.Pivots.fit(y, spec, 5), y, chunk_rows=20).collect()) == crossed


def test_pruning_skips_most_tiles_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)  # several blocks a chunk
    x = clustered(spark, 2000, 8, 20)
    corpus, asked, tiles = knn.pruned_tiles(x, knn.Pivots.fit(x, Knn(5), 20), chunk_rows=50)
    share = tiles.count() / (asked.count() * corpus.select("cell", "chunk").distinct().count())
    assert share < 1 / 3, share
    assert sorted(tuple(r) for r in knn.knn_pruned(x, knn.Pivots.fit(x, Knn(5), 20), chunk_rows=50).collect()) == sorted(tuple(r) for r in knn.knn_exact(x, Knn(5)).collect())


def test_pruned_search_edge_cases(spark):
    empty = points(spark, [])
    assert knn.knn_pruned(empty, knn.Pivots.fit(empty, Knn(2))).count() == 0
    few = points(spark, [(1, [0.0, 1.0], 0), (2, [3.0, 1.0], 0), (3, [1.0], 0)])
    assert {(r.i, r.j) for r in knn.knn_pruned(few, knn.Pivots.fit(few, Knn(5))).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    with pytest.raises(ValueError):
        knn.knn_pruned(few, knn.Pivots.fit(few, Knn(2, p=-math.inf)))


def test_blocks_of_queries_find_what_one_by_one_finds():
    rng = np.random.default_rng(15)
    corpus, ids = rng.integers(0, 4, size=(300, 3)).astype(float), rng.permutation(300)
    queries = rng.integers(0, 4, size=(40, 3)).astype(float)
    for spec in (Knn(7), Knn(7, p=1), Knn(7, p=math.inf), Knn(400), Knn(7, root=True)):
        rows, near, dist = knn.compare(corpus, ids, queries, spec)
        for q in range(40):
            plain = sorted((float(knn.power_sums(c - queries[q], spec.p)), int(i)) for c, i in zip(corpus, ids))[: spec.k]
            assert [(round(d**2 if spec.root else d, 9), j) for d, j in zip(dist[rows == q].tolist(), near[rows == q].tolist())] == plain


@pytest.mark.parametrize("p", [1, 2])
def test_rough_distances_lose_nobody(p):
    """Codes and single precision choose whom to measure; ties, outliers, offsets and scales change no result."""
    rng = np.random.default_rng(38)
    c = rng.normal(size=(700, 12))
    wild = np.concatenate([c, [c[0] * 1e12]])
    cases = [(c, c), (np.round(c), np.round(c)), (c + 1e9, c + 1e9), (c * 1e-30, c * 1e-30), (c * 1e150, c * 1e150), (wild, wild[-20:]), (c, c * 1e20)]
    cases += [(np.repeat(c[:70], 10, axis=0), c[:20]), (np.zeros((700, 3)), np.ones((5, 3))), (np.concatenate([c, c * 1e-9]), c * 1e-9), (rng.normal(size=(700, 150)), rng.normal(size=(20, 150)))]
    for corpus, queries in cases:
        ids, queries, spec = rng.permutation(len(corpus)), queries[:20], Knn(7, p=p)
        rows, near, dist = knn.compare(corpus, ids, queries, spec)
        for q in range(len(queries)):
            exact = knn.power_sums(corpus - queries[q], p)
            order = np.lexsort((ids, exact))[:7]
            assert near[rows == q].tolist() == ids[order].tolist() and dist[rows == q].tolist() == exact[order].tolist()


@pytest.mark.parametrize("p", [1, 2])
def test_few_are_measured_exactly(p):
    rng = np.random.default_rng(39)
    corpus = rng.normal(size=(5000, 64))
    chunk = knn.Chunk(corpus, np.arange(5000), Knn(10, p=p))
    rows, cols, _ = chunk.narrow(corpus[:32] + 0.1)
    assert 320 <= len(rows) < 32 * 30


def test_a_norm_is_worked_out_once_a_vector(spark):
    """Not once for each component, as a norm inside the function of a component is."""
    x = points(spark, [(1, [3.0, -1.0], 0), (2, None, 0), (3, [0.0, 0.0], 0)]).select("vec_id", normalised(F.col("embedding"), 1).alias("v"))
    assert {r.vec_id: r.v for r in x.collect()} == {1: [0.75, -0.25], 2: None, 3: [0.0, 0.0]}
    plan = x._jdf.queryExecution().analyzed().toString()
    assert "greatest" in plan and "/ greatest" not in plan


def test_tiles_are_dealt_in_turn(spark):
    """As many tiles as partitions: each has its own."""
    for n in (3, 16, 76):
        tiles = spark.range(n).withColumn("x", F.lit(1)).repartition(n, knn.in_turn(spark, F.col("id"), n))
        assert tiles.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_codes_are_stored_and_searched(spark):
    x = clustered(spark, 1500, 16, 12, spread=1.0)
    file = InvertedFile.fit(x, Knn(5), nlist=6)
    books = Codebooks.fit(x, file, bits=6, width=2)
    codes = knn.coded_table(x, file, books)
    assert codes.columns == ["id", "cell", "code"] and {len(r.code) for r in codes.collect()} == {8}
    exact = {(r.i, r.j) for r in knn.knn_exact(x, Knn(5)).collect()}
    found = knn.knn_ivfpq(x, file, books, nprobe=2, codes=codes, chunk_rows=100).collect()
    assert len({(r.i, r.j) for r in found} & exact) >= 0.95 * len(exact)
    rough = {(r.i, r.j): r.dist for r in knn.knn_ivfpq(x, file, books, nprobe=6, codes=codes, rerank=0).collect()}
    assert len(set(rough) & exact) >= 0.4 * len(exact)
    wide = Codebooks(np.random.default_rng(1).normal(size=(2, 300, 8)))
    assert {len(r.code) for r in knn.coded_table(x, file, wide).collect()} == {4}


@pytest.mark.parametrize("width, chunk_rows", [(2, 1 << 17), (2, 150), (3, 1 << 17)])
def test_coded_search_is_that_of_its_definition(spark, width, chunk_rows):
    """The best rows by coded distance of all cells a query probes, whatever the blocks and chunks; then exact order."""
    x = clustered(spark, 1500, 16, 12, spread=1.0)
    file = InvertedFile.fit(x, Knn(5), nlist=6)
    books = Codebooks.fit(x, file, bits=6, width=width)
    codes = knn.coded_table(x, file, books)
    held = sorted(x.collect(), key=lambda r: r.vec_id)
    vectors = np.array([r.embedding for r in held], dtype=float)
    stored = {r.id: (r.cell, np.frombuffer(r.code, dtype=np.uint8)) for r in codes.collect()}
    cells, code = np.array([stored[r.vec_id][0] for r in held]), np.array([stored[r.vec_id][1] for r in held])
    coded = np.concatenate([books.books[m, code[:, m]] for m in range(code.shape[1])], axis=1)[:, :16] + file.centres[cells]
    far = (file.centres**2).sum(axis=1)[None, :] - 2 * vectors @ file.centres.T
    probed = np.argsort(far, axis=1, kind="stable")[:, :3]
    found, rough = ({}, {})
    for rows, rerank in ((found, 2), (rough, 0)):
        for r in knn.knn_ivfpq(x, file, books, nprobe=3, codes=codes, chunk_rows=chunk_rows, rerank=rerank).collect():
            rows.setdefault(r.i, {})[r.rk] = (r.j, r.dist)
    for q in range(0, 1500, 10):
        own = np.flatnonzero(np.isin(cells, probed[q]))
        by_code = ((vectors[q] - coded[own]) ** 2).sum(axis=1)
        best = own[np.argsort(by_code)[:10]]
        exact = ((vectors[q] - vectors[best]) ** 2).sum(axis=1)
        got = [rough[q][k] for k in range(1, 6)]
        assert [d for _, d in got] == pytest.approx(np.sort(by_code)[:5].tolist(), rel=1e-6)
        if np.sort(by_code)[10] - np.sort(by_code)[9] > 1e-9:
            assert [found[q][k][1] for k in range(1, 6)] == pytest.approx(np.sort(exact)[:5].tolist(), rel=1e-9)


def test_coded_search_uses_all_tasks(spark):
    """The codes of a single cell are compared by a task for each block of queries."""
    x = clustered(spark, 3000, 8, 3, spread=1.0)
    file = InvertedFile(np.zeros((1, 8)), Knn(5))
    found = knn.knn_ivfpq(x, file, Codebooks.fit(x, file, bits=4, width=4))
    assert {r.n for r in found.groupBy("i").agg(F.count("*").alias("n")).collect()} == {5}
    assert "block" in found._jdf.queryExecution().optimizedPlan().toString()


def test_projection_of_ragged_vectors(spark):
    x = points(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [], 0), (4, [None, 1.0], 0), (5, None, 0), (6, [3.0, 4.0], 0)])
    projector = reduction.RandomProjector(3, seed=11)
    got = {r.vec_id: r.reduced for r in projector.transform(x).collect()}
    assert got[3] is None and got[4] is None and got[5] is None
    for i, vector in ((1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (6, [3.0, 4.0])):
        assert np.allclose(got[i], np.array(vector) @ projector.matrix(len(vector)))
    entries = np.array([reduction.projection_entry(r, c, 2) * 2 for r in range(1000) for c in range(2)])
    assert abs(entries.mean()) < 0.1 and abs(entries.std() - 1) < 0.05
    with pytest.raises(ValueError):
        reduction.RandomProjector(0)


def test_core_sets_do_not_depend_on_salts(spark):
    x = points(spark, [(i % 50, [float(i), float(i * i % 17)], 0) for i in range(70)])
    one, many = (sorted(tuple(r) for r in coreset.greedy_core_sets(x, 6, 4, 2, salts=s).collect()) for s in (1, 9))
    assert one == many and len(one) == 12
