"""The whole experiment: neighbours, densities, clusters for every threshold, and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import density, evaluation, modes, persistence
from basinflow.operators.finetune import fine_tune
from basinflow.operators.knn import InvertedFile, Knn, knn_exact, knn_ivf
from basinflow.sources.shared import materialise
from basinflow.sources.tables import sample_rows


@dataclass(frozen=True)
class Settings:
    """``k_density`` None uses the graph's own distances; ``nlist`` None searches exactly, else in cells around
    centres found by k-means, or ``given`` ones (rows of the table); ``ft_iters``
    steps of fine-tuning come first, towards ``n_components`` (None: the number of classes)."""

    k_graph: int = 10
    k_density: int | None = None
    greedy: bool = False
    num_samples: int | None = None
    q: float = 2
    tau_min: float = 0.0
    tau_max: float = 0.0
    num_tau: int = 1
    nlist: int | None = None
    nprobe: int = 4
    given: bool = False
    ft_iters: int = 0
    n_components: int | None = None
    seed: int = 47


def neighbours(x: DataFrame, k: int, s: Settings) -> DataFrame:
    spec = Knn(k)
    if s.nlist is None:
        return materialise(knn_exact(x, spec), "knn")
    file = InvertedFile.of_rows(x, spec, s.nlist) if s.given else InvertedFile.fit(x, spec, s.nlist, seed=s.seed)
    return materialise(knn_ivf(x, file, s.nprobe), "knn")


def graph_and_density(x: DataFrame, dim: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``edges(i, rk, j)`` and ``density(i, f)`` (log density) of the points."""
    graph = neighbours(x, s.k_graph, s)
    basis = graph if s.k_density is None else neighbours(x, s.k_density, s)
    return graph.select("i", "rk", "j"), materialise(density.log_density(basis, dim, s.q), "density")


def run(x: DataFrame, dim: int, s: Settings = Settings()) -> dict[str, DataFrame]:
    """``scores(tau, clusters, agreement, ami, nmi, accuracy)``, ``assignment``, ``pairs`` (ranked, at the
    infinite threshold), ``components``, ``curve`` and ``diagram``, from ``x(vec_id, embedding, label)``."""
    if s.num_samples is not None:
        x = materialise(sample_rows(x, s.num_samples, seed=s.seed), "sample")
    if s.ft_iters:
        wanted = s.n_components or x.select("label").distinct().count()
        moved, _ = fine_tune(x, dim, s.k_graph, wanted, s.ft_iters, s.q)
        x = materialise(moved.join(x.select("vec_id", "label"), "vec_id"), "tuned-points")
    edges, dens = graph_and_density(x, dim, s)
    taus = persistence.tau_grid(s.tau_min, s.tau_max, s.num_tau)
    cluster = persistence.cluster_h0_greedy if s.greedy else persistence.cluster_h0
    assignment, pairs = cluster(edges, dens, taus)
    assignment = materialise(assignment, "assignment")
    scores = score_all(x, assignment, taus)
    ranked = materialise(persistence.persistence_pairs(pairs.where(F.col("tau") == F.lit(float("inf"))), dens), "pairs")
    return {
        "scores": scores,
        "assignment": assignment,
        "pairs": ranked,
        "components": persistence.components(ranked),
        "curve": persistence.rank_curve(ranked),
        "diagram": persistence.diagram(ranked),
    }


def score_all(x: DataFrame, assignment: DataFrame, taus: Sequence[float]) -> DataFrame:
    """``tau, clusters, agreement, ami, nmi, accuracy`` of ``assignment(tau, i, root)``.

    The points are counted and compared with their centres once for all thresholds, and every measure is worked
    out for all of them together, from the table of distinct (threshold, class, cluster).  Measures that need classes
    are null where no point has one.
    """
    cell = (F.array_position(F.array(*[F.lit(float(t)) for t in taus]), F.col("tau")) - 1).cast("int")
    roots = assignment.select(cell.alias("cell"), "i", "root")
    labels = x.select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("truth")).where("truth is not null")
    tables = materialise(roots.join(labels, "i").groupBy("cell", "truth", F.col("root").alias("pred")).agg(F.count("*").alias("n")), "contingency")
    both = roots.join(evaluation.k_centre_labels_by_cell(x, roots, len(taus)), ["cell", "i"])
    agreement = both.groupBy("cell").agg(F.avg((F.col("root") == F.col("centre")).cast("double")).alias("agreement"))
    shared = roots.groupBy("cell").agg(F.count_distinct("root").alias("clusters")).join(agreement, "cell", "left")
    for part in (evaluation.adjusted_mutual_information(tables, ["cell"]), evaluation.normalized_mutual_information(tables, ["cell"]), evaluation.accuracies(tables, "cell")):
        shared = shared.join(F.broadcast(part), "cell", "left")  # a row for each threshold
    back = F.element_at(F.array(*[F.lit(float(t)) for t in taus]), F.col("cell") + 1)
    return materialise(shared.select(back.alias("tau"), "clusters", "agreement", "ami", "nmi", "accuracy"), "scores")


def sizes(x: DataFrame, dim: int, s: Settings = Settings()) -> DataFrame:
    """``root, size`` of the clusters of pure mode seeking."""
    edges, dens = graph_and_density(x, dim, s)
    return modes.cluster_sizes(modes.mode_seeking(edges, dens))
