"""Leaf-proximity clusters and what sets them apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.tails import binomial_spread_p, binomial_two_sided_p, chi_square_tail
from markerloom.operators.presence import exploded, names_literal

BOOTSTRAPS = 1000
CLUSTERS = (0, 1)


def leaf_arrays(transformed: DataFrame, *kept: str) -> DataFrame:
    """Forest output to ``sample_id, leaves``, the leaf reached in each tree, and the kept columns."""
    return transformed.select("sample_id", *kept, vector_to_array("leaf").cast("array<int>").alias("leaves"))


def leaf_rows(leaves: DataFrame) -> DataFrame:
    """``sample_id, tree, leaf`` rows."""
    return leaves.select("sample_id", F.posexplode("leaves").alias("tree", "leaf"))


def candidate_medoids(leaves: DataFrame, count: int = 64, seed: int = 42) -> DataFrame:
    """A fixed number of samples by hashed id; a top-k per task, no full sort."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id")))
    return leaves.withColumn("_d", digest).orderBy("_d", "sample_id").limit(count).drop("_d")


def co_leaf_counts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Trees in which a sample shares the candidate's leaf.

    ``candidates(candidate_id, tree, leaf)`` is a bounded set, so this is
    samples x trees x candidates at most, never samples squared.
    """
    return (
        rows.join(candidates, ["tree", "leaf"])
        .groupBy("sample_id", "candidate_id")
        .agg(F.count("*").alias("shared"))
    )


def shared_leaves(leaves: Column, medoid: Sequence[int]) -> Column:
    """Number of trees in which two leaf arrays agree."""
    agree = F.zip_with(leaves, F.lit([int(leaf) for leaf in medoid]), lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(agree, F.lit(0), lambda total, hit: total + hit)


def pair_costs(leaves: DataFrame, candidates: Sequence[tuple[str, Sequence[int]]]) -> DataFrame:
    """Summed distance to the nearer of two medoids, for every candidate pair.

    Each task adds up its own rows and emits one row per pair, so what is
    shuffled depends on the candidates, not on the samples.
    """
    grid = np.array([list(c[1]) for c in candidates], dtype=np.int32)
    first, second = np.triu_indices(len(candidates), 1)
    trees = grid.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(first))
        for batch in batches:
            for start in range(0, len(batch), 256):
                block = np.stack(batch["leaves"].iloc[start : start + 256].to_numpy())
                near = (block[:, None, :] == grid[None, :, :]).sum(axis=2)
                total += (trees - np.maximum(near[:, first], near[:, second])).sum(axis=0)
        yield pd.DataFrame({"first": first, "second": second, "cost": total / trees})

    return (
        leaves.select("leaves")
        .mapInPandas(partial, "first int, second int, cost double")
        .groupBy("first", "second")
        .agg(F.sum("cost").alias("cost"))
    )


def choose_medoids(leaves: DataFrame, count: int = 64, seed: int = 42) -> list[tuple[str, list[int]]]:
    """The best pair among the candidates; exact when there are no more samples than candidates."""
    candidates = [(row.sample_id, list(row.leaves)) for row in candidate_medoids(leaves, count, seed).collect()]
    candidates.sort()
    if len(candidates) < 2:
        raise ValueError("clustering needs at least two samples")
    best = pair_costs(leaves, candidates).orderBy("cost", "first", "second").first()
    return [candidates[best.first], candidates[best.second]]


def _cost(leaves: DataFrame, medoids: Sequence[tuple[str, Sequence[int]]]) -> int:
    """Trees in which a sample leaves its nearer medoid, summed over all samples."""
    a, b = (shared_leaves(F.col("leaves"), leaf) for _, leaf in medoids)
    return leaves.agg(F.sum(F.size("leaves") - F.greatest(a, b)).alias("cost")).first().cost or 0


def best_members(leaves: DataFrame, medoids: Sequence[tuple[str, Sequence[int]]]) -> list[tuple[str, list[int]]]:
    """The sample of each cluster that is nearest to all of its cluster.

    A sample's similarity to a cluster is the sum over trees of how many members
    share its leaf there. So members are counted per (cluster, tree, leaf) and
    the counts looked up: samples times trees, no pairs. Ties go to the smaller
    id; an empty cluster keeps its medoid.
    """
    a, b = (shared_leaves(F.col("leaves"), leaf) for _, leaf in medoids)
    placed = leaves.select("sample_id", F.when(b > a, 1).otherwise(0).alias("cluster"), "leaves")
    rows = placed.select("sample_id", "cluster", F.posexplode("leaves").alias("tree", "leaf"))
    keys = ["cluster", "tree", "leaf"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("members"))
    sums = rows.join(counts, keys).groupBy("cluster", "sample_id").agg(F.sum("members").alias("near"))
    best = sums.groupBy("cluster").agg(F.min(F.struct((-F.col("near")).alias("far"), "sample_id")).alias("b"))
    chosen = {row.cluster: row.b.sample_id for row in best.collect()}
    held = {row.sample_id: list(row.leaves) for row in leaves.filter(F.col("sample_id").isin(*chosen.values())).collect()}
    return [(chosen[c], held[chosen[c]]) if c in chosen else (medoids[c][0], list(medoids[c][1])) for c in CLUSTERS]


def refined_medoids(leaves: DataFrame, medoids: Sequence[tuple[str, Sequence[int]]]) -> list[tuple[str, list[int]]]:
    """Alternates best members and assignment until the cost falls no more.

    Every sample can become a medoid; the pair it starts from only decides
    where the search begins. The cost is a whole number that falls each round.
    """
    held, cost = [(name, list(leaf)) for name, leaf in medoids], _cost(leaves, medoids)
    while True:
        following = best_members(leaves, held)
        lower = _cost(leaves, following)
        if lower >= cost:
            return held
        held, cost = following, lower


def assign_clusters(leaves: DataFrame, medoids: Sequence[tuple[str, Sequence[int]]], *kept: str) -> DataFrame:
    """``sample_id, cluster`` and the kept columns: the nearer medoid, ties to the lower number."""
    a, b = (shared_leaves(F.col("leaves"), leaf) for _, leaf in medoids)
    return leaves.select("sample_id", *kept, F.when(b > a, 1).otherwise(0).alias("cluster"))


def label_clusters(samples: DataFrame, clusters: DataFrame) -> DataFrame:
    """``sample_id, target, cluster`` for every sample."""
    return samples.select("sample_id", F.col("label").alias("target")).join(clusters, "sample_id", "left")


def composition(clusters: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Cluster by target counts with the empty cells.

    One counter per known target in a single aggregate; no cross product.
    """
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.sum(F.when(F.col("target") == t, 1).otherwise(0)).alias("size"))
            for t in targets
        ]
    )
    return clusters.groupBy("cluster").agg(cells.alias("cells")).select("cluster", F.explode("cells").alias("c")).select(
        "cluster", "c.target", "c.size"
    )


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Samples per cluster."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"))


def size_map(clusters: DataFrame) -> dict[int, int]:
    """Cluster sizes on the driver; there are two clusters."""
    return {row.cluster: row["size"] for row in cluster_sizes(clusters).collect()}


def size_of(sizes: dict[int, int]) -> Column:
    """Size of the row's cluster, from literals instead of a join."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair]), F.col("cluster"))


def cluster_of_interest(clusters: DataFrame, toi: str) -> DataFrame:
    """The cluster with most target rows, ties to the larger number.

    One row: ``cluster, num_toi, coi_size``.
    """
    sizes = clusters.groupBy("cluster").agg(
        F.sum(F.when(F.col("target") == toi, 1).otherwise(0)).alias("num_toi"), F.count("*").alias("coi_size")
    )
    return sizes.agg(F.max(F.struct("num_toi", "cluster", "coi_size")).alias("m")).select(
        "m.cluster", "m.num_toi", "m.coi_size"
    )


def target_slice(clustered: DataFrame, coi: int, toi: str) -> DataFrame:
    """Rows in the cluster of interest and with the target label."""
    return clustered.filter((F.col("cluster") == coi) & (F.col("target") == toi))


def non_target_slice(clustered: DataFrame, coi: int, toi: str) -> DataFrame:
    """Rows in another cluster and without the target label."""
    return clustered.filter((F.col("cluster") != coi) & (F.col("target") != toi))


def cluster_feature_counts(clustered: DataFrame) -> DataFrame:
    """``feature, cluster, k``: present samples per feature and cluster."""
    return (
        exploded(clustered, "cluster")
        .groupBy("feature", "cluster")
        .agg(F.count("*").alias("k"))
    )


def chi_square(clustered: DataFrame) -> DataFrame:
    """Association of every feature with the two clusters (F7): ``feature, chi2, p_value``.

    With S = sum over clusters of k^2 / cluster size, the statistic of the
    2 x k table is N^2 (S - n^2/N) / (n (N - n)), so absent cells are not
    needed. NULL for a feature in every sample.
    """
    clustered = clustered.filter(F.col("cluster").isNotNull())
    sizes = size_map(clustered)
    if not sizes:
        return clustered.sparkSession.createDataFrame([], "feature string, chi2 double, p_value double")
    seen = F.col("k").cast("double")
    sums = (
        cluster_feature_counts(clustered)
        .groupBy("feature")
        .agg(F.sum(seen).alias("n"), F.sum(seen * seen / size_of(sizes)).alias("S"))
    )
    n, everyone, s = F.col("n"), F.lit(float(sum(sizes.values()))), F.col("S")
    value = everyone * everyone * (s - n * n / everyone) / F.nullif(n * (everyone - n), F.lit(0.0))
    return sums.select("feature", value.alias("chi2")).withColumn("p_value", chi_square_tail(F.col("chi2")))


def chi_square_p(vectors: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Statistic and p-value per feature from Spark ML's test.

    ``vectors(features, cluster)``; one row per feature.
    """
    tested = ChiSquareTest.test(vectors.select("features", F.col("cluster").cast("double").alias("cluster")), "features", "cluster", True)
    names = names_literal(vocab)
    return tested.select(
        F.element_at(names, F.col("featureIndex") + 1).alias("feature"),
        F.col("statistic").alias("chi2"),
        F.col("pValue").alias("p_value"),
    )


def local_importance(clustered: DataFrame, clusters: Sequence[int] = CLUSTERS, statistic: str = "mean") -> DataFrame:
    """``feature, cluster, p_value`` for each feature and cluster (F8).

    Resampling compares the cluster with many equally large draws from all
    samples. For 0/1 features such a draw is binomial, so the share it
    estimates has a closed form: ``mean`` is the two-sided tail of the
    cluster's mean, ``spread`` the chance that a draw varies less than the
    cluster does. A feature in every sample has p = 1.
    """
    if statistic not in ("spread", "mean"):
        raise ValueError("statistic must be 'spread' or 'mean'")
    clustered = clustered.filter(F.col("cluster").isNotNull())
    tail = binomial_spread_p if statistic == "spread" else binomial_two_sided_p
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("cluster"), F.sum(F.when(F.col("cluster") == c, F.col("k")).otherwise(0)).alias("k"))
            for c in clusters
        ]
    )
    counts = (
        cluster_feature_counts(clustered)
        .groupBy("feature")
        .agg(F.sum("k").alias("n"), cells.alias("cells"))
        .select("feature", "n", F.explode("cells").alias("c"))
        .select("feature", "n", "c.cluster", "c.k")
    )
    sizes = size_map(clustered)
    share = F.col("n") / F.lit(float(sum(sizes.values())))
    present = counts.filter(F.col("cluster").isin(*sizes))
    draws = size_of(sizes) if sizes else F.lit(0)
    return present.select("feature", "cluster", tail(F.col("k"), draws, share).alias("p_value"))


def log_importance(importance: DataFrame, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """Adds ``log_importance``: -log p scaled to [0, 1] in each cluster.

    p is floored at one resample, the smallest share resampling can show.
    """
    raw = importance.withColumn("_raw", -F.log(F.greatest("p_value", F.lit(1.0 / bootstraps))))
    tops = raw.groupBy("cluster").agg(F.max("_raw").alias("_top"))
    return raw.join(F.broadcast(tops), "cluster").select(
        "feature",
        "cluster",
        "p_value",
        F.when(F.col("_top") == 0.0, 0.0).otherwise(F.col("_raw") / F.nullif("_top", F.lit(0.0))).alias("log_importance"),
    )


def wide_importance(importance: DataFrame, clusters: Sequence[int] = CLUSTERS) -> DataFrame:
    """One row per feature with a column per cluster, for export."""
    return importance.groupBy("feature").agg(
        *[F.max(F.when(F.col("cluster") == c, F.col("log_importance"))).alias(f"cluster{c}_importance") for c in clusters]
    )


def important_features(importance: DataFrame, coi: int, p_value: float = 0.001, target: bool = True) -> DataFrame:
    """Features with p <= ``p_value`` in the cluster of interest, or in any other."""
    chosen = F.col("cluster") == coi if target else F.col("cluster") != coi
    return importance.filter(chosen & (F.col("p_value") <= p_value)).select("feature").distinct()
