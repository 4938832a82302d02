"""Forest markers: groups of co-occurring features of the target's cluster.

Prune features, fit a forest, cluster samples by shared leaves, keep the
features that set the cluster of interest apart, mine rules there and in the
rest, and subtract the second from the first.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.operators import annotate, checks, clusters, folds, forest, presence, rules
from markerloom.operators.patterns import by_support, empty_itemsets, frequent_itemsets
from markerloom.session import written
from markerloom.sources import results, tsv

# Names of the result tables under the output folder.
TABLES = {
    "clusters": "RF_clusters",
    "target_itemsets": "Target_FPG",
    "non_target_itemsets": "nonTarget_FPG",
    "target_rules": "Target_FPG_rules",
    "non_target_rules": "nonTarget_FPG_rules",
    "markers": "filtered_rules",
    "groups": "biomarker_groups",
    "annotations": "orthog_gene_names",
    "medoids": "medoids",
    "composition": "cluster_composition",
    "global_association": "global_association",
    "metric_range": "rule_metric_range",
    "importance": "importance",
    "forest_importance": "important_features",
    "report": "forest_report",
    "params": "parameters",
}


@dataclass
class ForestMarkers:
    """Result tables; those of skipped stages are None."""

    params: DataFrame
    target_rules: DataFrame
    non_target_rules: DataFrame
    markers: DataFrame
    features: DataFrame
    groups: DataFrame
    clusters: DataFrame | None = None
    medoids: DataFrame | None = None
    composition: DataFrame | None = None
    global_association: DataFrame | None = None
    metric_range: DataFrame | None = None
    importance: DataFrame | None = None
    forest_importance: DataFrame | None = None
    report: DataFrame | None = None
    target_itemsets: DataFrame | None = None
    non_target_itemsets: DataFrame | None = None
    annotations: DataFrame | None = None
    forest: object | None = None
    vocabulary: list[str] | None = None
    classes: list[str] | None = None

    def save(self, out: str, force: bool = False, as_tsv: bool = False) -> None:
        """Every table as parquet, or as TSV with lists in text form (K1, K4)."""
        for f in fields(self):
            name, table = TABLES.get(f.name), getattr(self, f.name)
            if name is None or table is None:
                continue
            if as_tsv:
                results.export_tsv(table, f"{out}/{name}", force, list_text=True)
            else:
                results.save_table(table, f"{out}/{name}", force)


def _mined(rows: DataFrame, wanted: DataFrame, itemset_len: int, min_support: float, subsample: bool, what: str):
    """Itemsets of a slice over its important features, with the empty cases."""
    spark = rows.sparkSession
    names = presence.vocabulary(folds.feature_half(wanted) if subsample else wanted)
    if not names:
        warnings.warn(f"no important feature passed the p-value filter for {what}", stacklevel=3)
        return empty_itemsets(spark)
    baskets = written(presence.restrict_items(rows.select("sample_id", "items"), names), "slice")
    found = frequent_itemsets(baskets, min_support, itemset_len)
    if found.isEmpty():
        warnings.warn(f"no frequent itemset in {what}", stacklevel=3)
    return found


def find_markers(
    baskets: DataFrame,
    toi: str,
    *,
    catalogue: DataFrame | None = None,
    min_count: int | None = None,
    max_count: int | None = None,
    test_size: float = 0.2,
    seeds: tuple[int, int] | None = None,
    split_seeds: Sequence[int] = tuple(range(50)),
    model_seeds: Sequence[int] = tuple(range(50)),
    trees: int = 100,
    max_depth: int = forest.MAX_DEPTH,
    saved_forest: str | None = None,
    saved_clusters: DataFrame | None = None,
    medoid_candidates: int = 64,
    importance_statistic: str = "mean",
    p_value: float = 0.001,
    min_support: float = 0.6,
    min_confidence: float = 0.8,
    min_lift: float = 1.5,
    non_lift: float | None = None,
    min_conviction: float = 1.5,
    min_zhang: float = 0.5,
    min_leverage: float | None = None,
    max_biomk: int = 4,
    subsample: bool = False,
    saved_itemsets: tuple[DataFrame, DataFrame] | None = None,
    annotations: DataFrame | None = None,
    top_groups: int = 500,
    parallelism: int = 4,
) -> ForestMarkers:
    """``baskets(sample_id, label, items)`` to marker rules and groups.

    ``seeds`` skips the seed search, ``saved_forest`` the fit,
    ``saved_clusters(sample_id, cluster)`` the clustering, and
    ``saved_itemsets`` (target, non-target) the mining. ``catalogue`` is the
    feature order of a wide table.
    """
    checks.require_share(test_size)
    spark = baskets.sparkSession
    baskets = written(presence.fill_labels(baskets.select("sample_id", "label", "items")), "samples")
    checks.require_unique_ids(baskets)
    checks.require_label(baskets, toi)
    sizes = checks.class_sizes(baskets)
    n_samples = sum(sizes.values())

    low, high = presence.default_bounds(n_samples, min_count, max_count)
    vocab = presence.vocabulary(presence.prune_features(baskets, low, high, catalogue))
    checks.require_features(vocab)
    codes = list(sizes)
    coded = presence.encode_items(baskets, vocab).select(
        "sample_id",
        "label",
        "features",
        presence.vector_items("features", vocab).alias("items"),
        (F.array_position(presence.names_literal(codes), F.col("label")) - 1).cast("double").alias("encoded_class"),
    )
    vectors = written(coded, "vectors")

    if saved_forest is not None:
        model, report = forest.load_forest(saved_forest, vocab, codes), None
    else:
        if seeds is None:
            scores = forest.seed_scores(
                vectors.select("sample_id", "features", "encoded_class"),
                split_seeds,
                model_seeds,
                test_size,
                parallelism,
                trees=trees,
                max_depth=max_depth,
            )
            seeds = forest.best_seeds(scores)
        split = forest.with_split(vectors.select("sample_id", "features", "encoded_class"), test_size, seeds[0])
        model = forest.fit_forest(split.filter(~F.col("is_test")), seeds[1], trees, max_depth)
        labels = presence.names_literal(codes)
        report = forest.forest_report(model, split.filter("is_test")).withColumn(
            "class", F.element_at(labels, F.col("class") + 1)
        )

    medoids = None
    if saved_clusters is None:
        # Label and items ride along, so nothing is joined back.
        leaves = written(clusters.leaf_arrays(model.transform(vectors), "label", "items"), "leaves")
        medoids = clusters.refined_medoids(leaves, clusters.choose_medoids(leaves, medoid_candidates))
        assigned = clusters.assign_clusters(leaves, medoids, "label", "items")
    else:
        assigned = vectors.select("sample_id", "label", "items").join(saved_clusters.select("sample_id", "cluster"), "sample_id", "left")
    clustered = written(assigned.select("sample_id", F.col("label").alias("target"), "cluster", "items"), "clustered")
    coi = clusters.cluster_of_interest(clustered, toi).first()
    importance = written(
        clusters.log_importance(clusters.local_importance(clustered, statistic=importance_statistic)), "importance"
    )

    if saved_itemsets is None:
        target_rows = clusters.target_slice(clustered, coi.cluster, toi)
        other_rows = clusters.non_target_slice(clustered, coi.cluster, toi)
        target_items = _mined(
            target_rows, clusters.important_features(importance, coi.cluster, p_value), max_biomk + 1, min_support, subsample, "the target"
        )
        other_items = _mined(
            other_rows,
            clusters.important_features(importance, coi.cluster, p_value, target=False),
            max_biomk + 1,
            min_support,
            subsample,
            "the rest",
        )
    else:
        target_items, other_items = saved_itemsets
    others_lift = min_lift - 0.3 if non_lift is None else non_lift
    shared = {"min_conviction": min_conviction, "min_zhang": min_zhang, "min_leverage": min_leverage}

    def marker_table(itemsets: DataFrame, lift: float, name: str) -> DataFrame:
        found = rules.association_rules(itemsets, min_confidence)
        return written(rules.collapse_rules(rules.filter_rules(found, lift, **shared)), name)

    def ranges(itemsets: DataFrame, slice_name: str) -> DataFrame:
        bounds = rules.metric_range(rules.association_rules(itemsets, min_confidence))
        return bounds.select(F.lit(slice_name).alias("slice"), "*")

    target_rules = marker_table(target_items, min_lift, "target_rules")
    other_rules = marker_table(other_items, others_lift, "other_rules")
    params = results.parameters(
        spark,
        {
            "toi": toi,
            "min_thresh": low,
            "max_thresh": high,
            "max_biomk": max_biomk,
            "num_feat": len(vocab),
            "num_samples": n_samples,
            **{f"class {label}": n for label, n in sizes.items()},
            "test_size": test_size,
            "dataselect_seed": seeds[0] if seeds else None,
            "model_seed": seeds[1] if seeds else None,
            "coi": coi.cluster,
            "coi_size": coi.coi_size,
            "num_toi": coi.num_toi,
            "p_value": p_value,
            "min_support": min_support,
            "min_confidence": min_confidence,
            "min_lift": min_lift,
            "non_lift": others_lift,
            **shared,
        },
    )
    out = resume_from_rules(target_rules, other_rules, max_biomk=max_biomk, top_groups=top_groups, params=params)
    out.clusters = clustered.select("sample_id", "target", "cluster")
    out.composition = clusters.composition(clustered, codes)
    out.global_association = clusters.chi_square(clustered)
    out.metric_range = ranges(target_items, "target").unionByName(ranges(other_items, "non_target"))
    if medoids is not None:
        out.medoids = spark.createDataFrame(medoids, "sample_id string, leaves array<int>")
    out.importance = importance
    out.forest_importance = forest.top_features(forest.feature_importance(model, vocab, spark))
    out.report = report
    out.target_itemsets, out.non_target_itemsets = by_support(target_items), by_support(other_items)
    out.forest, out.vocabulary, out.classes = model, vocab, codes
    if annotations is not None:
        members = clusters.target_slice(out.clusters, coi.cluster, toi)
        chosen = annotate.restrict_annotations(annotations, members, out.features)
        out.annotations = annotate.vote_annotations(chosen, out.features)
    return out


def resume_from_rules(
    target_rules: DataFrame,
    non_target_rules: DataFrame,
    *,
    max_biomk: int = 4,
    top_groups: int = 500,
    params: DataFrame | None = None,
) -> ForestMarkers:
    """The last stage alone, from rule tables."""
    markers = written(rules.subtract_rules(target_rules, non_target_rules), "markers")
    return ForestMarkers(
        params=params if params is not None else results.parameters(markers.sparkSession, {"max_biomk": max_biomk}),
        target_rules=target_rules,
        non_target_rules=non_target_rules,
        markers=markers,
        features=rules.rule_features(markers),
        groups=rules.suggest_groups(markers, max_biomk, top_groups),
    )


def find_markers_in_tsv(
    spark: SparkSession,
    path: str,
    id_col: str,
    targets_col: str,
    toi: str,
    *,
    predictors: Sequence[str] | None = None,
    remove: Sequence[str] | None = None,
    annotation_path: str | None = None,
    out: str | None = None,
    force: bool = False,
    **options: object,
) -> ForestMarkers:
    """The job on a wide presence TSV, with an optional annotation TSV.

    With ``out`` the tables are saved there; a used folder is refused before
    any work unless ``force`` is given (K4).
    """
    if out is not None:
        results.require_free(spark, out, force)
    baskets, order = tsv.read_presence(spark, path, id_col, targets_col, include=predictors, exclude=remove)
    annotations = tsv.read_annotation(spark, annotation_path) if annotation_path else None
    found = find_markers(baskets, toi, catalogue=order, annotations=annotations, **options)
    if out is not None:
        found.save(out, force)
    return found
