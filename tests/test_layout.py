"""t-SNE and UMAP against their definitions, and what they keep of neighbourhoods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinflow.operators import layout, reduction
from basinflow.operators.layout import TSNE, UMAP, Block, Grid


@pytest.fixture(scope="module")
def clusters(spark):
    """Sixteen clusters in twenty dimensions; the row's cluster is its label."""
    rng = np.random.default_rng(21)
    middle = rng.normal(size=(16, 20)) * 3
    rows = [(k, (middle[k % 16] + rng.normal(size=20)).astype(np.float32).tolist(), k % 16) for k in range(240)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").cache()


def test_entropy_of_every_row_is_calibrated():
    rng = np.random.default_rng(22)
    dist, sizes = np.sort(rng.random((20, 15)) * rng.random((20, 1)) * 50, axis=1), np.full(20, 15)
    dist[3, 9:], sizes[3] = np.inf, 9
    p = layout.entropy_weights(dist, sizes, 5.0)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1), math.log(5), atol=1e-6)
    assert (p[3, 9:] == 0).all()
    flat = layout.entropy_weights(np.zeros((1, 4)), np.array([4]), 5.0)
    assert np.allclose(flat, 0.25)


def test_memberships_add_up():
    rng = np.random.default_rng(23)
    dist = np.sort(rng.random((30, 10)), axis=1)
    w = layout.fuzzy_weights(dist, np.full(30, 10))
    assert np.allclose(w.sum(axis=1), math.log2(10), atol=1e-6) and np.allclose(w[:, 0], 1)


def test_fields_of_the_grid_are_the_kernel_sums():
    rng = np.random.default_rng(24)
    where = rng.normal(size=(400, 2)) * 3
    grid = Grid(-14.0, 28 / 199, 200)
    found = grid.fields(grid.charges(where), where, grid.kernels())
    gap = where[:, None, :] - where[None, :, :]
    near = 1 / (1 + (gap**2).sum(axis=2))
    plain = np.stack([near.sum(axis=1), (near**2).sum(axis=1), near**2 @ where[:, 0], near**2 @ where[:, 1]])
    assert np.abs(found - plain).max() < 0.02 * np.abs(plain).max()


def test_a_step_follows_the_gradient_of_the_divergence():
    """One step of one block is the negative gradient of KL(p, q), here by differences."""
    rng = np.random.default_rng(25)
    n, where = 12, rng.normal(size=(12, 2))
    p = rng.random((n, n)) * (1 - np.eye(n))
    p /= p.sum()

    def divergence(y):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2)) * (1 - np.eye(n))
        return (p * np.log(np.maximum(p, 1e-300) / (q / q.sum() + np.eye(n)))).sum()

    src, dst = np.nonzero(p)
    half = p[src, dst] / 2  # each directed pull counts at both ends, the back one as a spring at rest
    near = half / (1 + ((where[src] - where[dst]) ** 2).sum(axis=1))
    springs = np.stack([np.bincount(dst, weights=near * v, minlength=n) for v in (np.ones(len(src)), where[src, 0], where[src, 1])], axis=1)
    block = Block(np.arange(n), where.copy(), np.zeros((n, 2)), springs, src, dst, half)
    method = TSNE(rounds=100, steps=1)
    grid = Grid(-8.0, 16 / 255, 256)
    method.move(block, (grid, grid.charges(where)), 99, n)
    slope = np.zeros((n, 2))
    for i in range(n):
        for k in (0, 1):
            step = np.zeros((n, 2))
            step[i, k] = 1e-5
            slope[i, k] = (divergence(where + step) - divergence(where - step)) / 2e-5
    moved = block.speed / -200.0
    clipped = np.sqrt((block.speed**2).sum(axis=1)) > 4.9
    assert np.abs(moved - slope)[~clipped].max() < 0.05 * np.abs(slope).max()


@pytest.mark.parametrize("method", [TSNE(rounds=12, perplexity=8, k=24), UMAP(rounds=8, k=10), TSNE(rounds=14, perplexity=8, k=24, block_rows=90), UMAP(rounds=8, k=10, block_rows=90)])
def test_layouts_keep_more_than_principal_components(clusters, method):
    flat = reduction.PrincipalComponents(2).fit_transform(clusters)
    plain = layout.neighbours_kept(clusters, flat.select("vec_id", "reduced")).first().kept
    found = method.fit_transform(clusters).select("vec_id", "reduced", "label").cache()
    assert found.count() == 240 and found.where("reduced is null").count() == 0
    assert layout.neighbours_kept(clusters, found).first().kept > plain + 0.02
    rows = found.collect()
    where, label = np.array([r.reduced for r in rows]), np.array([r.label for r in rows])
    gaps = ((where[:, None] - where[None]) ** 2).sum(axis=2) + np.where(np.eye(240) > 0, np.inf, 0)
    assert (label[gaps.argmin(axis=1)] == label).mean() > 0.9


def test_new_rows_are_placed_among_their_neighbours(clusters):
    method = UMAP(rounds=6, k=10)
    known, new = clusters.where("vec_id < 200"), clusters.where("vec_id >= 200")
    fitted = {r.vec_id: (np.array(r.reduced), r.label) for r in method.fit_transform(known).collect()}
    placed = method.place(new, known).join(new.select("vec_id", "label"), "vec_id").collect()
    assert len(placed) == 40
    nearest = [min(fitted.values(), key=lambda v: ((v[0] - np.array(r.reduced)) ** 2).sum())[1] for r in placed]
    assert sum(a == r.label for a, r in zip(nearest, placed)) > 35


def test_layout_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, x double, i long, js int, block int"
    rows = [(k, [float(k % 5), 1.0, float(k)], 0.0, 1, 2, 3) for k in range(12)] + [(20, [1.0, 1.0, 1.0], 0.0, 1, 2, 3)] * 2 + [(30, None, 0.0, 1, 2, 3), (31, [1.0, math.nan, 0.0], 0.0, 1, 2, 3), (None, [0.0, 0.0, 1.0], 0.0, 1, 2, 3)]
    df = spark.createDataFrame(rows + [(40 + k, [2.0, 2.0, 2.0], 0.0, 1, 2, 3) for k in range(20)], schema)
    for method in (TSNE(k=6, perplexity=2, rounds=2, steps=3), UMAP(k=5, rounds=2, steps=3)):
        found = method.fit_transform(df).select("vec_id", "reduced").collect()
        assert len(found) == 37
        assert all((r.reduced is None) == (r.vec_id in (30, 31, None)) for r in found)
        assert all(math.isfinite(v) for r in found if r.reduced for v in r.reduced)
        two = df.where("vec_id < 2")
        assert method.fit_transform(two).count() == 2


def test_points_to_draw_must_lie_in_a_plane(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, reduced array<double>")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "i long, label long")
    assert reduction.plot_points(points, labels).count() == 2
    with pytest.raises(ValueError):
        reduction.plot_points(points.withColumn("reduced", F.array(F.lit(1.0))), labels)
    with pytest.raises(ValueError):
        reduction.plot_points(points.drop("reduced"), labels)
