"""Elastic nets under repeated nested cross-validation, with stability tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.operators import checks, metrics, outcomes, penalised, presence, stability
from markerloom.operators.penalised import NetSettings
from markerloom.session import written
from markerloom.sources import results, tsv


@dataclass
class NetResult:
    """Result tables of a net; those a net does not have are None."""

    fold_metrics: DataFrame
    predictions: DataFrame
    stability: DataFrame
    coef: DataFrame
    inner_scores: DataFrame
    overall: DataFrame
    metric_summary: DataFrame
    params: DataFrame
    sample_summary: DataFrame | None = None
    toi_stability: DataFrame | None = None
    class_map: DataFrame | None = None

    def save(self, out: str, force: bool = False, as_tsv: bool = False) -> None:
        """One table per result under ``out`` (K1, K2, K4)."""
        for f in fields(self):
            table = getattr(self, f.name)
            if table is None:
                continue
            if as_tsv:
                results.export_tsv(table, f"{out}/{f.name}", force)
            else:
                results.save_table(table, f"{out}/{f.name}", force)


def _names(baskets: DataFrame, features: Sequence[str] | None) -> list[str]:
    names = list(features) if features is not None else presence.vocabulary(presence.feature_counts(baskets))
    checks.require_features(names)
    return names


def _feature_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return tsv.catalogue(spark, names).select("feature")


def _sizes(prepared: penalised.Prepared, positives: bool) -> DataFrame:
    """Train and test sizes of every fit, from the fold arrays (M9)."""
    held = (
        prepared.table.select("y", F.posexplode("fold_of").alias("repeat", "held"))
        .groupBy("repeat", "held")
        .agg(F.count("*").alias("n_test"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("positives_test"))
    )
    whole = held.groupBy("repeat").agg(F.sum("n_test").alias("n"), F.sum("positives_test").alias("p"))
    sizes = held.join(whole, "repeat").select(
        (F.col("repeat") * prepared.settings.outer_splits + F.col("held")).cast("int").alias("fit_id"),
        (F.col("n") - F.col("n_test")).alias("n_train"),
        "n_test",
        (F.col("p") - F.col("positives_test")).alias("positives_train"),
        "positives_test",
    )
    return sizes if positives else sizes.drop("positives_train", "positives_test")


def _params(spark: SparkSession, settings: NetSettings, **more: object) -> DataFrame:
    return results.parameters(spark, {**vars(settings), "total_fits": settings.total_fits, **more})


def binary_net(
    baskets: DataFrame,
    toi: str,
    settings: NetSettings = NetSettings(),
    features: Sequence[str] | None = None,
    drop: Sequence[str] = (),
) -> NetResult:
    """Target of interest against the rest."""
    spark = baskets.sparkSession
    checks.require_unique_ids(baskets)
    kept = presence.drop_labels(presence.fill_labels(baskets), drop)
    positives, negatives = checks.require_binary(kept, toi)
    names = _names(kept, features)
    # Folds are stratified by the binary target.
    target = presence.binary_target(kept, toi).withColumn("label", F.col("y").cast("string"))
    prepared = penalised.prepare(target, names, settings, stratified=True)
    fits = penalised.fit_logistic(prepared, 2)
    predictions = fits.predictions.select(
        "sample_id", "y_true", "y_pred", F.element_at("probability", 2).alias("y_prob"), F.col("fit_id").alias("fold")
    )
    scored = metrics.binary_scores(predictions, ["fold"]).drop("accuracy")
    areas = metrics.roc_auc(predictions, ["fold"], score="y_prob").withColumnRenamed("auc", "AUC")
    fold_metrics = (
        _sizes(prepared, True)
        .join(fits.best, "fit_id")
        .withColumnRenamed("fit_id", "fold")
        .join(areas, "fold")
        .join(scored, "fold")
        .select(
            "fold", "n_train", "n_test", "positives_train", "positives_test", "best_C", "best_l1_ratio",
            "AUC", "balanced_accuracy", "MCC", "TP", "FP", "TN", "FN",
        )
    )
    fold_metrics = written(fold_metrics, "fold_metrics")
    summary = written(stability.sample_summary(predictions), "summary")
    one = summary.withColumn("_one", F.lit(1))
    overall = (
        metrics.binary_scores(one, ["_one"], pred="y_pred_mean")
        .join(metrics.roc_auc(one, ["_one"], score="y_prob_mean").withColumnRenamed("auc", "AUC"), "_one")
        .select("AUC", "balanced_accuracy", "MCC")
    )
    table = stability.binary_stability(fits.coef, _feature_table(spark, names), settings.total_fits)
    return NetResult(
        fold_metrics=fold_metrics,
        predictions=predictions,
        stability=stability.ranked(table),
        coef=fits.coef,
        inner_scores=fits.inner_scores,
        overall=overall,
        metric_summary=stability.metric_summary(fold_metrics, ["AUC", "balanced_accuracy", "MCC"]),
        params=_params(spark, settings, toi=toi, dropped=list(drop), n_positive=positives, n_negative=negatives, n_features=len(names)),
        sample_summary=summary,
    )


def multiclass_net(
    baskets: DataFrame,
    toi: str | None = None,
    settings: NetSettings = NetSettings(),
    features: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> NetResult:
    """Three or more labels, with an optional table for one of them."""
    spark = baskets.sparkSession
    checks.require_unique_ids(baskets)
    kept = presence.keep_labels(presence.fill_labels(baskets), keep)
    sizes = checks.class_sizes(kept)
    checks.require_multiclass(sizes)
    if toi is not None and toi not in sizes:
        raise ValueError(f"'{toi}' is not one of the labels: {list(sizes)}")
    names, labels = _names(kept, features), list(sizes)
    coded = kept.withColumn("y", F.array_position(presence.names_literal(labels), F.col("label")) - 1)
    prepared = penalised.prepare(coded, names, settings, stratified=True)
    fits = penalised.fit_logistic(prepared, len(labels))
    known = presence.names_literal(labels)
    coef = fits.coef.withColumn("class", F.element_at(known, F.col("class") + 1))
    probs = [F.element_at("probability", i + 1).alias(f"prob_{label}") for i, label in enumerate(labels)]
    base = fits.predictions.withColumnRenamed("fit_id", "fold")
    scored = metrics.multiclass_scores(base, ["fold"]).select("fold", "balanced_accuracy", F.col("macro_f1").alias("macro_F1"))
    by_class = F.map_from_arrays(F.sequence(F.lit(0), F.lit(len(labels) - 1)), F.col("probability"))
    areas = metrics.macro_auc(base.withColumn("prob", by_class), len(labels), ["fold"]).withColumnRenamed(
        "macro_auc", "macro_AUC_ovr"
    )
    fold_metrics = written(
        _sizes(prepared, False)
        .join(fits.best, "fit_id")
        .withColumnRenamed("fit_id", "fold")
        .join(scored, "fold")
        .join(areas, "fold")
        .select("fold", "n_train", "n_test", "balanced_accuracy", "macro_F1", "macro_AUC_ovr", "best_C", "best_l1_ratio"),
        "fold_metrics",
    )
    table = _feature_table(spark, names)
    any_class = stability.any_class_stability(coef, table, settings.total_fits)
    for_toi = None if toi is None else stability.ranked(stability.toi_stability(coef, table, settings.total_fits, toi))
    summary = stability.metric_summary(fold_metrics, ["balanced_accuracy", "macro_F1", "macro_AUC_ovr"])
    return NetResult(
        fold_metrics=fold_metrics,
        predictions=base.select("sample_id", "y_true", "y_pred", "fold", *probs),
        stability=stability.ranked(any_class),
        coef=coef,
        inner_scores=fits.inner_scores,
        overall=summary,
        metric_summary=summary,
        params=_params(
            spark, settings, toi=toi, n_features=len(names), **{f"class {label}": n for label, n in sizes.items()}
        ),
        toi_stability=for_toi,
        class_map=spark.createDataFrame(list(enumerate(labels)), "encoded_class int, label string"),
    )


def continuous_net(
    baskets: DataFrame,
    meta: DataFrame,
    id_col: str,
    outcome_col: str,
    settings: NetSettings = NetSettings(strengths=100, max_iter=30_000),
    features: Sequence[str] | None = None,
    log1p: bool = False,
) -> NetResult:
    """A numeric outcome from a second table."""
    spark = baskets.sparkSession
    checks.require_columns(meta, [id_col, outcome_col], "the metadata")
    checks.require_unique_ids(baskets)
    checks.require_unique_ids(meta.select(F.col(f"`{id_col}`").cast("string").alias("sample_id")).dropna())
    joined = written(outcomes.join_outcome(baskets.select("sample_id", "items"), meta, id_col, outcome_col, log1p), "joined")
    if joined.isEmpty():
        raise ValueError("no sample is in both tables; check the sample ids")
    checks.require_numeric(joined)
    names = _names(joined, features)
    prepared = penalised.prepare(joined.withColumn("y", F.col("outcome")), names, settings, stratified=False)
    fits = penalised.fit_linear(prepared)
    predictions = fits.predictions.select("sample_id", "y_true", "y_pred", F.col("fit_id").alias("fold"))
    fold_metrics = written(
        _sizes(prepared, False)
        .join(fits.best, "fit_id")
        .withColumnRenamed("fit_id", "fold")
        .join(metrics.regression_scores(predictions, ["fold"]), "fold")
        .select("fold", "n_train", "n_test", "best_alpha", "best_l1_ratio", "R2", "MAE", "RMSE"),
        "fold_metrics",
    )
    summary = written(stability.regression_summary(predictions), "summary")
    table = stability.regression_stability(fits.coef, _feature_table(spark, names), settings.total_fits)
    return NetResult(
        fold_metrics=fold_metrics,
        predictions=predictions,
        stability=stability.ranked(table),
        coef=fits.coef,
        inner_scores=fits.inner_scores,
        overall=metrics.regression_scores(summary, [], pred="y_pred_mean"),
        metric_summary=stability.metric_summary(fold_metrics, ["R2", "MAE", "RMSE"]),
        params=_params(spark, settings, outcome=outcome_col, log1p=log1p, n_samples=joined.count(), n_features=len(names)),
        sample_summary=summary,
    )


#: Fixed value: what the names of feature columns begin with.
PREFIX = "OG"


def _tsv_baskets(spark: SparkSession, path: str, id_col: str, label_col: str | None, prefix: str | None) -> tuple[DataFrame, list[str]]:
    """Baskets of a wide table and all its features, also those that no sample has."""
    baskets, order = tsv.read_presence(spark, path, id_col, label_col, prefix=prefix)
    return written(baskets, "baskets"), [r.feature for r in order.orderBy("position").collect()]


def _saved(found: NetResult, out: str | None, force: bool) -> NetResult:
    if out is not None:
        found.save(out, force)
    return found


def binary_net_in_tsv(
    spark: SparkSession,
    path: str,
    id_col: str,
    targets_col: str,
    toi: str,
    settings: NetSettings = NetSettings(),
    *,
    drop: Sequence[str] = (),
    prefix: str | None = PREFIX,
    out: str | None = None,
    force: bool = False,
) -> NetResult:
    """``binary_net`` on a wide presence TSV.

    Features are the columns whose names begin with ``prefix``; those that no
    sample has are in the stability table with 0. With ``out`` the tables are
    saved there.
    """
    baskets, names = _tsv_baskets(spark, path, id_col, targets_col, prefix)
    return _saved(binary_net(baskets, toi, settings, names, drop), out, force)


def multiclass_net_in_tsv(
    spark: SparkSession,
    path: str,
    id_col: str,
    targets_col: str,
    toi: str | None = None,
    settings: NetSettings = NetSettings(),
    *,
    keep: Sequence[str] = (),
    prefix: str | None = PREFIX,
    out: str | None = None,
    force: bool = False,
) -> NetResult:
    """``multiclass_net`` on a wide presence TSV."""
    baskets, names = _tsv_baskets(spark, path, id_col, targets_col, prefix)
    return _saved(multiclass_net(baskets, toi, settings, names, keep), out, force)


def continuous_net_in_tsv(
    spark: SparkSession,
    path: str,
    meta_path: str,
    id_col: str,
    outcome_col: str,
    settings: NetSettings = NetSettings(strengths=100, max_iter=30_000),
    *,
    log1p: bool = False,
    prefix: str | None = PREFIX,
    out: str | None = None,
    force: bool = False,
) -> NetResult:
    """``continuous_net`` on a wide presence TSV and a TSV with the outcome."""
    baskets, names = _tsv_baskets(spark, path, id_col, None, prefix)
    return _saved(continuous_net(baskets, tsv.read_tsv(spark, meta_path), id_col, outcome_col, settings, names, log1p), out, force)
