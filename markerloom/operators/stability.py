"""Marker stability, prediction summaries and parameter choice.

``coef`` tables hold one row per fit (and class) and feature; rows with a zero
coefficient may be left out. Fits that selected nothing still count in
``total_fits``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero_filled(features: DataFrame, sums: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Every feature gets a row, with 0 counts when it was never selected."""
    return features.select("feature").join(sums, "feature", "left").fillna(0, list(counts))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole).cast("double"), F.lit(0.0))


def binary_stability(coef: DataFrame, features: DataFrame, total_fits: int) -> DataFrame:
    """Selection rate, mean coefficients and sign rates per feature."""
    c = F.col("coef")
    sums = coef.groupBy("feature").agg(
        F.sum(F.when(c != 0, 1).otherwise(0)).alias("n_selected"),
        F.sum(F.when(c > 0, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(c < 0, 1).otherwise(0)).alias("_neg"),
        F.sum(c).alias("_sum"),
        F.sum(F.abs(c)).alias("_abs"),
    )
    whole = _zero_filled(features, sums, ["n_selected", "_pos", "_neg"]).fillna(0.0, ["_sum", "_abs"])
    total = F.lit(float(total_fits))
    return whole.select(
        F.col("feature").alias("Orthogroup"),
        "n_selected",
        (F.col("n_selected") / total).alias("selection_rate"),
        (F.col("_sum") / total).alias("mean_coef"),
        (F.col("_abs") / total).alias("mean_abs_coef"),
        # Unselected fits add zero, so the plain sum is the sum over selected fits.
        _share("_sum", "n_selected").alias("mean_coef_selected"),
        _share("_pos", "n_selected").alias("pos_rate_selected"),
        _share("_neg", "n_selected").alias("neg_rate_selected"),
    )


def any_class_stability(coef: DataFrame, features: DataFrame, total_fits: int) -> DataFrame:
    """How often a feature has a non-zero coefficient for any class."""
    chosen = (
        coef.filter(F.col("coef") != 0)
        .select("fit_id", "feature")
        .distinct()
        .groupBy("feature")
        .agg(F.count("*").alias("n_selected_any"))
    )
    return _zero_filled(features, chosen, ["n_selected_any"]).select(
        F.col("feature").alias("Orthogroup"),
        "n_selected_any",
        (F.col("n_selected_any") / F.lit(float(total_fits))).alias("selection_rate_any"),
    )


def toi_stability(coef: DataFrame, features: DataFrame, total_fits: int, toi: str) -> DataFrame:
    """Stability and direction for the target-of-interest class."""
    chosen = (
        coef.filter((F.col("class") == toi) & (F.col("coef") != 0))
        .groupBy("feature")
        .agg(F.count("*").alias("n_selected_toi"), F.avg("coef").alias("mean_coef_toi_selectedFits"))
    )
    mean = F.col("mean_coef_toi_selectedFits")
    return _zero_filled(features, chosen, ["n_selected_toi"]).select(
        F.col("feature").alias("Orthogroup"),
        "n_selected_toi",
        (F.col("n_selected_toi") / F.lit(float(total_fits))).alias("selection_rate_toi"),
        mean,
        F.when(mean > 0, "enriched_in_TOI").when(mean < 0, "depleted_in_TOI").otherwise("NA").alias("direction_in_TOI"),
    )


def regression_stability(coef: DataFrame, features: DataFrame, total_fits: int) -> DataFrame:
    """Selection count and rate."""
    return binary_stability(coef, features, total_fits).select("Orthogroup", "n_selected", "selection_rate")


def ranked(stability: DataFrame, top: int | None = None) -> DataFrame:
    """Most stable first, ties by name (T2); ``top`` rows for reports."""
    rate = next(c for c in stability.columns if c.startswith("selection_rate"))
    count = next(c for c in stability.columns if c.startswith("n_selected"))
    ordered = stability.orderBy(F.desc(rate), F.desc(count), "Orthogroup")
    return ordered if top is None else ordered.limit(top)


def sample_summary(predictions: DataFrame) -> DataFrame:
    """Mean and spread of a sample's held-out probabilities."""
    return (
        predictions.groupBy("sample_id")
        .agg(
            F.avg("y_true").alias("y_true"),
            F.avg("y_prob").alias("y_prob_mean"),
            F.stddev_samp("y_prob").alias("y_prob_sd"),
            F.count("y_prob").alias("n_predictions"),
        )
        .withColumn("y_pred_mean", F.when(F.col("y_prob_mean") >= 0.5, 1).otherwise(0))
    )


def regression_summary(predictions: DataFrame) -> DataFrame:
    """Mean and spread of a sample's held-out predictions."""
    return predictions.groupBy("sample_id").agg(
        F.avg("y_true").alias("y_true"),
        F.avg("y_pred").alias("y_pred_mean"),
        F.stddev_samp("y_pred").alias("y_pred_sd"),
        F.count("y_pred").alias("n_predictions"),
    )


def metric_summary(fold_metrics: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample SD and number of valid folds per metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (
        fold_metrics.select(F.explode(rows).alias("r"))
        .groupBy(F.col("r.metric").alias("metric"))
        .agg(
            F.avg("r.value").alias("mean"),
            F.stddev_samp("r.value").alias("sd"),
            F.count("r.value").alias("n_folds"),
        )
    )


def choose_hyper(scores: DataFrame, strength: str = "C", best: str = "max", prefer: str = "small") -> DataFrame:
    """Best grid point per fit from the inner scores (V7).

    The mean over inner folds decides; ties go to the smaller l1 ratio, then to
    the smaller (or larger) strength. Input: ``fit_id, <strength>, l1_ratio,
    inner_fold, score``.
    """
    means = scores.groupBy("fit_id", strength, "l1_ratio").agg(F.avg("score").alias("mean_score"))
    signed = F.col("mean_score") if best == "max" else -F.col("mean_score")
    lean = -F.col(strength) if prefer == "small" else F.col(strength)
    winner = F.max(
        F.struct(signed.alias("_score"), (-F.col("l1_ratio")).alias("_l1"), lean.alias("_lean"), strength, "l1_ratio", "mean_score")
    )
    return (
        means.groupBy("fit_id")
        .agg(winner.alias("w"))
        .select(
            "fit_id",
            F.col(f"w.{strength}").alias(f"best_{strength}"),
            F.col("w.l1_ratio").alias("best_l1_ratio"),
            F.col("w.mean_score").alias("mean_score"),
        )
    )


def choose_seeds(scores: DataFrame) -> DataFrame:
    """Walk the seed grid in order and keep a pair that is nowhere worse.

    A pair is accepted when accuracy, F1 and precision all reach the current
    best. That is not a maximum of any order, so the (small, one row per fit)
    table is folded in sequence. Input: ``split_seed, model_seed, accuracy,
    macro_f1, macro_precision``.
    """
    start = (
        "named_struct('accuracy', 0D, 'macro_f1', 0D, 'macro_precision', 0D, 'split_seed', 0, 'model_seed', 0)"
    )
    step = (
        "(best, x) -> if(x.accuracy >= best.accuracy and x.macro_f1 >= best.macro_f1 "
        "and x.macro_precision >= best.macro_precision, "
        "named_struct('accuracy', x.accuracy, 'macro_f1', x.macro_f1, 'macro_precision', x.macro_precision, "
        "'split_seed', x.split_seed, 'model_seed', x.model_seed), best)"
    )
    typed = scores.select(
        F.col("split_seed").cast("int"),
        F.col("model_seed").cast("int"),
        *[F.col(c).cast("double") for c in ("accuracy", "macro_f1", "macro_precision")],
    )
    walk = typed.agg(
        F.array_sort(
            F.collect_list(F.struct("split_seed", "model_seed", "accuracy", "macro_f1", "macro_precision"))
        ).alias("walk")
    )
    return walk.select(F.expr(f"aggregate(walk, {start}, {step})").alias("best")).select("best.*")
