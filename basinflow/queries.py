"""Registered queries of the clustering operators and, where SQL can express them, their SQL.

Every query runs over the whole ``embeddings`` table.  Floats are rounded the same way on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions.vectors import pnorm
from basinflow.operators import coreset, density, evaluation, finetune, knn, layout, modes, persistence, reduction
from basinflow.operators.knn import Codebooks, InvertedFile, Knn
from basinflow.plans import experiment
from basinflow.sources import archive, metrics, tables
from basinflow.sources.shared import fresh_path, materialise
from basinflow.streaming import sampler

K, DIM, Q = 10, 64, 2
TAUS = [0.0, 0.5, 2.0, math.inf]

Query = Callable[[SparkSession, str], DataFrame]


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-nearest-neighbour table of the embeddings, written once and read back."""
    return materialise(knn.knn_exact(tables.points(spark, sf_dir), Knn(K)), "knn")


def graph_density(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = graph(spark, sf_dir)
    return found.select("i", "rk", "j"), materialise(density.log_density(found, DIM, Q), "density")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def pnorm_query(p: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = tables.points(spark, sf_dir)
        after = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        return x.join(after, "vec_id").select("vec_id", F.round(pnorm(F.col("embedding"), F.col("other"), p), 6).alias("dist"))

    return run


def knn_query(spec: Knn) -> Query:
    return lambda spark, sf_dir: rounded(knn.knn_exact(tables.points(spark, sf_dir), spec), "dist")


def knn_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in another table, here the same vectors under other ids."""
    x = tables.points(spark, sf_dir)
    return rounded(knn.knn_exact(x, Knn(K), x.withColumn("vec_id", F.col("vec_id") + 1_000_000)), "dist")


def knn_ivf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    return rounded(knn.knn_ivf(x, InvertedFile.fit(x, Knn(K), nlist=5), nprobe=5), "dist")


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    return rounded(knn.knn_ivf(x, InvertedFile.fit(x, Knn(K), nlist=5), nprobe=4), "dist")


def knn_ivf_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`knn_ivf`, with five rows of the table as centres, so that the result is the same everywhere."""
    x = tables.points(spark, sf_dir)
    return rounded(knn.knn_ivf(x, InvertedFile.of_rows(x, Knn(K), 5), nprobe=4), "dist")


def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    return rounded(knn.knn_pruned(x, knn.Pivots.fit(x, Knn(K))), "dist")


def knn_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    file = InvertedFile.fit(x, Knn(K), nlist=5)
    return rounded(knn.knn_ivfpq(x, file, Codebooks.fit(x, file), nprobe=4), "dist")


def knn_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.packed(knn.knn_exact(tables.points(spark, sf_dir), Knn(K)))
    return found.select("i", F.size("neighbours").cast("long").alias("size"), F.array_join(F.transform("neighbours", lambda s: s["j"].cast("string")), ",").alias("js"))


def dtm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.dtm(graph(spark, sf_dir), Q), "dtm")


def density_query(**how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = how | ({"n": tables.points(spark, sf_dir).count()} if how.get("normalize") else {})
        return rounded(density.dtm_density(graph(spark, sf_dir), **options), "f")

    return run


WEIGHTS = [(K + 1 - r) / (K * (K + 1) / 2) for r in range(1, K + 1)]


def log_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.log_density(graph(spark, sf_dir), DIM, Q), "f")


def uphill_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.uphill_edges(*graph_density(spark, sf_dir)).select("i", "rk", "j")


def steepest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, dens = graph_density(spark, sf_dir)
    return modes.steepest_parents(modes.uphill_edges(edges, dens), dens)


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, dens = graph_density(spark, sf_dir)
    return rounded(modes.local_maxima(modes.uphill_edges(edges, dens), dens), "f")


def mode_seeking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.mode_seeking(*graph_density(spark, sf_dir))


def mode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.labelled(mode_seeking(spark, sf_dir))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.cluster_sizes(mode_seeking(spark, sf_dir))


def saddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, dens = graph_density(spark, sf_dir)
    uphill = modes.uphill_edges(edges, dens)
    found = persistence.saddles(uphill, modes.seek_modes(modes.steepest_parents(uphill, dens)))
    return found.select("i", F.size("basins").cast("long").alias("basins"), F.element_at("basins", 1).alias("first"))


def h0_tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignment, _ = persistence.cluster_h0(*graph_density(spark, sf_dir), TAUS)
    return assignment.select(F.col("tau").cast("string").alias("tau"), "i", "root")


def h0_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignment, _ = persistence.cluster_h0_greedy(*graph_density(spark, sf_dir), TAUS)
    return assignment.select(F.col("tau").cast("string").alias("tau"), "i", "root")


def h0_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = persistence.cluster_h0(*graph_density(spark, sf_dir), TAUS)
    return rounded(pairs.select(F.col("tau").cast("string").alias("tau"), "birth", "death", "persistence"), "persistence")


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, dens = graph_density(spark, sf_dir)
    _, pairs = persistence.cluster_h0(edges, dens, [math.inf])
    return materialise(persistence.persistence_pairs(pairs, dens), "pairs")


def persistence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranked_pairs(spark, sf_dir), "birth_density", "death_density", "persistence")


def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = persistence.cluster_counts(ranked_pairs(spark, sf_dir), TAUS)
    return found.select(F.col("tau").cast("string").alias("tau"), "clusters")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.components(ranked_pairs(spark, sf_dir))


def persistence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.rank_curve(ranked_pairs(spark, sf_dir)), "persistence")


def persistence_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.diagram(ranked_pairs(spark, sf_dir)), "x", "y")


def saliency_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.losses(ranked_pairs(spark, sf_dir), 10), "saliency", "shrinkage", "loss", digits=5)


def loss_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.persistence_gradient(ranked_pairs(spark, sf_dir), 10)


def point_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the loss's derivative by the coordinates of each point that it depends on."""
    x = tables.points(spark, sf_dir)
    found = graph(spark, sf_dir)
    dens = materialise(density.log_density(found, DIM, Q), "density")
    _, pairs = persistence.cluster_h0(found.select("i", "rk", "j"), dens, [math.inf])
    slopes = persistence.persistence_gradient(materialise(persistence.persistence_pairs(pairs, dens), "pairs"), 10)
    vectors = finetune.point_gradient(x, found, slopes, DIM, Q)
    return vectors.select("i", F.round(F.sqrt(F.aggregate("gradient", F.lit(0.0), lambda s, v: s + v * v)), 5).alias("norm"))


def fine_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points after two steps of fine-tuning."""
    return finetune.fine_tune(tables.points(spark, sf_dir), DIM, K, 10, 2)[0]


def toy_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.weighted_digraph(*tables.eleven_nodes(spark))


def toy_h0(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignment, _ = persistence.cluster_h0(*tables.eleven_nodes(spark), tables.ELEVEN_THRESHOLDS)
    return assignment


def by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, root, truth``: each point's mode and class."""
    classes = tables.points(spark, sf_dir).select(F.col("vec_id").alias("i"), F.col("label").alias("truth"))
    return mode_seeking(spark, sf_dir).join(classes, "i")


def mode_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(evaluation.contingency(by_mode(spark, sf_dir), "truth", "root"), "contingency")


def encoded_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.encoded(mode_contingency(spark, sf_dir))


def score_query(measure: Callable[[DataFrame], DataFrame], name: str) -> Query:
    return lambda spark, sf_dir: rounded(measure(mode_contingency(spark, sf_dir)), name)


def optimal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in agreement under the optimal assignment (which itself need not be unique)."""
    table = mode_contingency(spark, sf_dir)
    both = table.join(evaluation.optimal_assignment(table), ["pred", "truth"])
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def sparse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`optimal_hits`, by the method for tables of many labels."""
    table = mode_contingency(spark, sf_dir)
    return table.join(evaluation.sparse_assignment(table), ["pred", "truth"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def clustering_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_mode(spark, sf_dir).select("root", F.expr("truth div 2").alias("superclass"), F.expr("truth % 2").alias("subgroup"))
    found = evaluation.clustering_metrics(rows, "root", "superclass", "subgroup", 2, prefix="modes")
    return rounded(found.where(~F.col("metric").rlike(r"Cluster_Acc/\d")), "value")


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the metrics for clusters that a sixth of the rows leave, so that the best map is one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 6 == 0, (label + 1) % 10).otherwise(label) + 100
    rows = tables.points(spark, sf_dir).select(moved.alias("cluster"), F.expr("cast(label div 2 as long)").alias("superclass"), (label % 2).alias("subgroup"))
    found = evaluation.clustering_metrics(rows, "cluster", "superclass", "subgroup", 2)
    return rounded(found.where(F.col("metric").startswith("Cluster_Acc")), "value")


def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cluster_count(mode_seeking(spark, sf_dir), "root")


def dense_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.points(spark, sf_dir).select(F.col("label").cast("long").alias("truth"), (F.col("vec_id") % 10).alias("pred"))
    return evaluation.dense_cost(evaluation.contingency(rows, "truth", "pred"), 10)


def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id: repeated ids repeat their row, unknown ones give nothing."""
    ids = spark.range(0, 120).select(F.expr("id * 7 % 50 * 20").alias("vec_id"))
    return tables.gather(tables.points(spark, sf_dir), ids).select("vec_id", "label")


def pairs_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.pairs_below(ranked_pairs(spark, sf_dir), 2.0).select("birth", "death", "persistence"), "persistence")


def density_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.density_of_points(tables.points(spark, sf_dir), Knn(K), dim=1, q=2), "f")


def subgroup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    return x.select("vec_id", evaluation.subgroup_id(F.expr("label div 2"), F.col("label") % 2, 2).cast("long").alias("class"))


def k_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.k_centre_labels(tables.points(spark, sf_dir), mode_seeking(spark, sf_dir))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = mode_seeking(spark, sf_dir)
    both = roots.join(evaluation.k_centre_labels(tables.points(spark, sf_dir), roots), "i")
    return rounded(evaluation.label_agreement(both, "root", "centre"), "agreement")


def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduction.RandomProjector(3).fit_transform(tables.points(spark, sf_dir))
    return found.select("vec_id", F.posexplode("reduced").alias("component", "value")).select("vec_id", F.col("component").cast("long").alias("component"), F.round("value", 6).alias("value"))


def no_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduction.NoReduce().fit_transform(tables.points(spark, sf_dir))
    return found.select("vec_id", F.round(F.aggregate("reduced", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def principal_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to draw: two principal components, cluster labels, and the ten strongest components."""
    x = tables.points(spark, sf_dir)
    edges, dens = graph_density(spark, sf_dir)
    roots = modes.mode_seeking(edges, dens)
    _, pairs = persistence.cluster_h0(edges, dens, [math.inf])
    top = persistence.top_components(materialise(persistence.persistence_pairs(pairs, dens), "pairs"), 10)
    return reduction.plot_points(reduction.PrincipalComponents(2).fit_transform(x), modes.labelled(roots).select("i", "label"), top)


def layout_query(reducer: Callable[[], reduction.Reducer]) -> Query:
    """Every point's place in a layout of the plane."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = reducer().fit_transform(tables.points(spark, sf_dir))
        return found.select("vec_id", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))

    return run


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sample_rows(tables.points(spark, sf_dir), 300).select("vec_id", "label")


def coreset_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coreset.greedy_core_sets(tables.points(spark, sf_dir), budget=32, oversampling_factor=4, num_batches=4)


def coreset_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A core-set of all vectors, composed from groups of about 128."""
    return rounded(coreset.covering_core_set(tables.points(spark, sf_dir), budget=16, group_rows=128, fan_in=8), "distance")


def covering_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.points(spark, sf_dir)
    return rounded(coreset.covering_radius(x, coreset.covering_core_set(x, budget=16, group_rows=128, fan_in=8)), "radius")


def density_digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour graph with its density steps as weights."""
    return tables.weighted_digraph(*graph_density(spark, sf_dir))


def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as tensor archives and read again by ranges."""
    folder = fresh_path(spark, "archives")
    archive.write_archives(tables.points(spark, sf_dir), folder)
    total = F.aggregate("encodings", F.lit(0.0), lambda s, v: s + v)
    return archive.read_archives(spark, folder, split_bytes=1 << 20).select(F.col("ids").alias("vec_id"), F.col("labels").alias("label"), F.round(total, 6).alias("total"))


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs, one of them written twice, as the table of metrics has them."""
    path, found = fresh_path(spark, "metrics"), materialise(class_metrics(spark, sf_dir), "metrics")
    for run in ("first", "second", "first"):
        metrics.write_metrics(found, path, run)
    return metrics.read_metrics(spark, path)


def coreset_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the vectors read as a stream, worked off and written to a table."""
    stream = sampler.stream_of(spark, f"{sf_dir}/embeddings.parque[t]", "vec_id long, embedding array<float>, label int", files_per_trigger=1000)
    batches = sampler.core_set_batches(stream, budget=8, oversampling_factor=4, slots=4)
    return sampler.run_available(batches, fresh_path(spark, "batches"), fresh_path(spark, "stream"))


def experiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = experiment.run(tables.points(spark, sf_dir), DIM, experiment.Settings(tau_max=2.0, num_tau=3))["scores"]
    return rounded(scores.withColumn("tau", F.col("tau").cast("string")), "agreement", "ami", "nmi", "accuracy")


def experiment_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment by approximate search: 5 cells, of which 4 are probed."""
    scores = experiment.run(tables.points(spark, sf_dir), DIM, experiment.Settings(tau_max=2.0, num_tau=1, nlist=5, nprobe=4))["scores"]
    return rounded(scores.withColumn("tau", F.col("tau").cast("string")), "agreement", "ami", "nmi", "accuracy")


def experiment_ivf_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`experiment_ivf`, around five rows of the table."""
    scores = experiment.run(tables.points(spark, sf_dir), DIM, experiment.Settings(tau_max=2.0, num_tau=1, nlist=5, nprobe=4, given=True))["scores"]
    return rounded(scores.withColumn("tau", F.col("tau").cast("string")), "agreement", "ami", "nmi", "accuracy")


QUERIES: dict[str, Query] = {
    "cluster_sizes": cluster_sizes,
    "pnorm_l1": pnorm_query(1),
    "pnorm_l2": pnorm_query(2),
    "pnorm_l3": pnorm_query(3),
    "pnorm_max": pnorm_query(math.inf),
    "pnorm_min": pnorm_query(-math.inf),
    "knn_exact": knn_query(Knn(K)),
    "knn_lp": knn_query(Knn(K, p=1)),
    "knn_rooted": knn_query(Knn(K, root=True)),
    "knn_normalized": knn_query(Knn(K, p=1, normalize=True)),
    "knn_cross": knn_cross,
    "knn_packed": knn_packed,
    "knn_ivf_full_probe": knn_ivf_full,
    "knn_ivf": knn_ivf,
    "knn_ivf_given": knn_ivf_given,
    "knn_pruned": knn_pruned,
    "knn_ivfpq": knn_ivfpq,
    "dtm": dtm_query,
    "dtm_density": density_query(dim=2, q=2),
    "dtm_density_normalized": density_query(dim=2, q=2, k=K, normalize=True),
    "dtm_density_weighted": density_query(dim=2, q=2, weights=WEIGHTS),
    "log_density": log_density,
    "uphill_edges": uphill_edges,
    "steepest_parent": steepest_parent,
    "local_maxima": local_maxima,
    "mode_seeking": mode_seeking,
    "mode_labels": mode_labels,
    "saddles": saddles,
    "h0_tau_sweep": h0_tau_sweep,
    "h0_greedy": h0_greedy,
    "h0_pairs": h0_pairs,
    "persistence_pairs": persistence_pairs,
    "cluster_counts": cluster_counts,
    "components": components,
    "persistence_rank": persistence_rank,
    "persistence_diagram": persistence_diagram,
    "saliency_shrinkage": saliency_shrinkage,
    "loss_gradient": loss_gradient,
    "point_gradient": point_gradient,
    "fine_tuned": fine_tuned,
    "toy_graph_edges": toy_graph_edges,
    "toy_h0": toy_h0,
    "contingency": mode_contingency,
    "encoded_contingency": encoded_contingency,
    "ari": score_query(evaluation.adjusted_rand, "ari"),
    "nmi": score_query(evaluation.normalized_mutual_information, "nmi"),
    "ami": score_query(evaluation.adjusted_mutual_information, "ami"),
    "clustering_accuracy": score_query(evaluation.clustering_accuracy, "accuracy"),
    "optimal_assignment": optimal_hits,
    "sparse_assignment": sparse_hits,
    "clustering_metrics": clustering_metrics,
    "class_metrics": class_metrics,
    "cluster_count": cluster_count,
    "dense_cost": dense_cost,
    "gather": gather,
    "pairs_below": pairs_below,
    "density_of_points": density_of_points,
    "subgroup_id": subgroup_id,
    "k_centre": k_centre,
    "label_agreement": label_agreement,
    "random_projection": random_projection,
    "no_reduction": no_reduction,
    "principal_plane": principal_plane,
    "tsne_plane": layout_query(layout.TSNE),
    "umap_plane": layout_query(layout.UMAP),
    "sample_rows": sample_rows,
    "coreset_greedy": coreset_greedy,
    "archive_scan": archive_scan,
    "metric_table": metric_table,
    "coreset_covering": coreset_covering,
    "coreset_stream": coreset_stream,
    "covering_radius": covering_radius,
    "density_digraph": density_digraph,
    "experiment": experiment_scores,
    "experiment_ivf": experiment_ivf,
    "experiment_ivf_given": experiment_ivf_given,
}
