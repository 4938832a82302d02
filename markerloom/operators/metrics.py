"""Scores of predictions as plain aggregates (M1-M8).

Every function takes the grouping keys (for example the fit number) and works
for all fits at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.operators.ranking import sum_below
from markerloom.session import written


def _per(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands in when there is only one group."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def _ratio(top: Column, bottom: Column, empty: Column) -> Column:
    return F.when(bottom == 0, empty).otherwise(top / F.nullif(bottom, F.lit(0).cast("double")))


def roc_auc(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties count half; NULL with a single class.

    Counts per distinct score are written once, because bounds, bucket totals
    and running sums all read them.
    """
    df, keys = _per(df, keys)
    points = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("_neg"),
    )
    points = written(points, "points")
    ranked = sum_below(points, keys, score, "_neg", "_below")
    won = F.sum((F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))).cast("double"))
    area = ranked.groupBy(*keys).agg(won.alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    return area.select(
        *[k for k in keys if k != "_all"], _ratio(F.col("_won"), pairs, F.lit(None).cast("double")).alias("auc")
    )


def binary_scores(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy and MCC (M2, M3, M5)."""

    def cell(t: int, p: int) -> Column:
        return F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), 1).otherwise(0))

    counts = df.groupBy(*keys).agg(
        cell(1, 1).alias("TP"), cell(0, 1).alias("FP"), cell(0, 0).alias("TN"), cell(1, 0).alias("FN")
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    none = F.lit(None).cast("double")
    recalls = F.array_compact(F.array(_ratio(tp, tp + fn, none), _ratio(tn, tn + fp, none)))
    balanced = F.aggregate(recalls, F.lit(0.0), lambda total, r: total + r) / F.size(recalls)
    factors = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.select(
        *keys,
        "TP",
        "FP",
        "TN",
        "FN",
        ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        _ratio(tp * tn - fp * fn, F.sqrt(factors), F.lit(0.0)).alias("MCC"),
    )


def class_report(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class; an empty denominator gives 0 (M4)."""
    counts = df.groupBy(*keys, truth, pred).agg(F.count("*").alias("_n"))
    hit = F.when(F.col(truth) == F.col(pred), F.col("_n")).otherwise(0)
    roles = F.array(
        F.struct(F.col(truth).alias("class"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.cast("bigint").alias("h")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )
    sums = (
        counts.select(*keys, F.explode(roles).alias("r"))
        .groupBy(*keys, F.col("r.class").alias("class"))
        .agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.h").alias("hits"))
    )
    tp, t, p = (F.col(c).cast("double") for c in ("hits", "support", "predicted"))
    zero = F.lit(0.0)
    return sums.select(
        *keys,
        "class",
        _ratio(tp, p, zero).alias("precision"),
        _ratio(tp, t, zero).alias("recall"),
        _ratio(2 * tp, t + p, zero).alias("f1"),
        "support",
        "hits",
    )


def multiclass_scores(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and macro precision (M3, M4)."""
    report = class_report(df, keys, truth, pred)
    return report.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("support").cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"),
    )


def macro_auc(
    df: DataFrame, n_classes: int, keys: Sequence[str] = (), truth: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Mean one-vs-rest AUC; NULL unless the group holds every class (M6).

    ``prob`` is a map from class to probability.
    """
    df, keys = _per(df, keys)
    long = df.select(*keys, F.col(truth).alias("_t"), F.explode_outer(prob).alias("class", "score"))
    long = long.filter(F.col("class").isNotNull()).withColumn("y_true", F.when(F.col("_t") == F.col("class"), 1).otherwise(0))
    per_class = roc_auc(long, [*keys, "class"])
    # A class without positives has a NULL area, so it does not count here.
    whole = F.when(F.count("auc") == n_classes, F.avg("auc"))
    return per_class.groupBy(*keys).agg(whole.alias("macro_auc")).drop("_all")


def log_loss(df: DataFrame, keys: Sequence[str] = (), p_true: str = "p_true", floor: float = 2.220446049250313e-16) -> DataFrame:
    """Mean negative log of the probability given to the true class (M7)."""
    clipped = F.least(F.greatest(F.col(p_true), F.lit(floor)), F.lit(1.0 - floor))
    return df.groupBy(*keys).agg((-F.avg(F.log(clipped))).alias("log_loss"))


def regression_scores(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """R2, MAE and RMSE (M8); a constant truth gives R2 0, or 1 if hit exactly."""
    miss = F.col(truth) - F.col(pred)
    sums = df.groupBy(*keys).agg(
        F.sum(miss * miss).alias("_sse"),
        (F.var_pop(truth) * F.count("*")).alias("_sst"),
        F.avg(F.abs(miss)).alias("_mae"),
        F.count("*").alias("_n"),
    )
    flat = F.when(F.col("_sse") == 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(
        *keys,
        F.when(F.col("_sst") == 0.0, flat).otherwise(1.0 - F.col("_sse") / F.nullif("_sst", F.lit(0.0))).alias("R2"),
        F.col("_mae").alias("MAE"),
        F.sqrt(F.col("_sse") / F.col("_n")).alias("RMSE"),
    )
