"""Elastic-net models under repeated nested cross-validation.

Vectors are assembled once, with each sample's outer and inner fold of every
repeat in two short arrays, so a training set is a mark on one written table
and never a join. Means and SDs of all fits come from one pass as well. All
fits then walk down their penalties together (``paths``); a linear net with few
features is solved from sums of products instead (``moments``), to the same
optimum. ``logistic_fit`` and ``linear_fit`` are single fits by Spark ML.

Scaling: 0/1 columns are divided by their training SD and not centred. An
unpenalised intercept absorbs the shift, so the coefficients are those of
standardised columns while the vectors stay sparse.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from markerloom.operators import moments, paths
from markerloom.operators.folds import repeated_folds
from markerloom.operators.presence import encode_items, names_literal
from markerloom.session import written

# The full l1 grid, the range of the C grid and the alpha span.
FULL_L1_RATIOS = (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)
C_RANGE = (-4.0, 4.0)
ALPHA_SPAN = 1e-3

COARSE_L1_RATIOS = (0.1, 0.5, 0.95)
COARSE_STRENGTHS = 5
# The quasi-Newton steps of a linear fit stop on the relative change of the loss.
LINEAR_TOLERANCE = 1e-10


def c_grid(count: int) -> list[float]:
    """``count`` log-spaced inverse penalties over the full range (V4)."""
    low, high = C_RANGE
    if count == 1:
        return [1.0]
    return [10.0 ** (low + (high - low) * i / (count - 1)) for i in range(count)]


def alpha_path(alpha_max: float, count: int) -> list[float]:
    """``count`` log-spaced penalties from ``alpha_max`` down (V6)."""
    if count == 1:
        return [alpha_max]
    return [alpha_max * ALPHA_SPAN ** (i / (count - 1)) for i in range(count)]


@dataclass(frozen=True)
class NetSettings:
    """Outer and inner folds and the grid; the defaults are the full search.

    A continuous outcome takes ``strengths=100`` alphas. ``coarse()`` is a
    quick look instead.
    """

    outer_splits: int = 5
    outer_repeats: int = 20
    inner_cv: int = 5
    seed: int = 42
    strengths: int = 20
    l1_ratios: Sequence[float] = FULL_L1_RATIOS
    max_iter: int = 20_000
    tol: float = 1e-6

    @classmethod
    def coarse(cls, **more: object) -> NetSettings:
        """Few strengths and l1 ratios, named so that nobody takes it for the full search."""
        return cls(**{"strengths": COARSE_STRENGTHS, "l1_ratios": COARSE_L1_RATIOS, **more})

    @property
    def total_fits(self) -> int:
        return self.outer_splits * self.outer_repeats


@dataclass
class Prepared:
    """One written table for all fits, and what the fits share."""

    table: DataFrame  # sample_id, y, features, fold_of, inner_of
    vocab: list[str]
    settings: NetSettings

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @property
    def fits(self) -> range:
        return range(1, self.settings.total_fits + 1)


def fold_arrays(folds: DataFrame) -> DataFrame:
    """Fold tables to one row per sample: ``fold_of[repeat]``, ``inner_of[repeat]``."""
    ordered = F.array_sort(F.collect_list(F.struct("repeat", "fold", "inner_fold")))
    return folds.groupBy("sample_id").agg(ordered.alias("f")).select(
        "sample_id", F.col("f.fold").alias("fold_of"), F.col("f.inner_fold").alias("inner_of")
    )


def prepare(baskets: DataFrame, vocab: Sequence[str], settings: NetSettings, stratified: bool) -> Prepared:
    """``baskets(sample_id, label, items, y)`` to the shared training table."""
    folds = repeated_folds(
        baskets, settings.outer_splits, settings.outer_repeats, settings.seed, stratified, settings.inner_cv
    )
    vectors = encode_items(baskets, vocab).select("sample_id", F.col("y").cast("double").alias("y"), "features")
    table = written(vectors.join(fold_arrays(folds), "sample_id"), "vectors")
    return Prepared(table.persist(StorageLevel.MEMORY_AND_DISK), list(vocab), settings)


def held_out_stats(prepared: Prepared) -> DataFrame:
    """Count and outcome sum per (repeat, held-out fold, feature) in one pass.

    ``code`` -1 stands for all rows. Partial sums are bounded by repeats x
    folds x features, so the shuffle does not grow with the samples.
    """
    codes = F.concat(F.array(F.lit(-1)), F.unwrap_udt("features").getField("indices"))
    return (
        prepared.table.select("y", codes.alias("codes"), F.posexplode("fold_of").alias("repeat", "fold"))
        .select("y", "repeat", "fold", F.explode("codes").alias("code"))
        .groupBy("repeat", "fold", "code")
        .agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"))
    )


def training_stats(prepared: Prepared) -> DataFrame:
    """Per fit and feature: training count, mean, SD and score against the outcome.

    Training sums are the repeat's total minus the held-out fold.
    """
    held = written(held_out_stats(prepared), "stats")
    splits = prepared.settings.outer_splits
    whole = held.groupBy("repeat", "code").agg(F.sum("n").alias("all_n"), F.sum("sum_y").alias("all_y"))
    # A feature may be absent from a held-out fold; its training sums are then the totals.
    cells = whole.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits)))).join(
        held, ["repeat", "fold", "code"], "left"
    )
    sums = cells.select(
        (F.col("repeat") * splits + F.col("fold")).alias("fit_id"),
        "code",
        (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"),
        (F.col("all_y") - F.coalesce("sum_y", F.lit(0.0))).alias("sum_y"),
    )
    rows = sums.filter("code = -1").select("fit_id", F.col("n").alias("n_train"), F.col("sum_y").alias("total_y"))
    share = F.col("n") / F.col("n_train").cast("double")
    sd = F.sqrt(share * (F.lit(1.0) - share))
    # One row per fit on this side: bounded by the number of fits.
    return sums.filter("code >= 0").join(F.broadcast(rows), "fit_id").select(
        "fit_id",
        "code",
        "n_train",
        share.alias("mean"),
        sd.alias("sd"),
        F.when(sd == 0.0, 0.0)
        .otherwise((F.col("sum_y") - share * F.col("total_y")) / F.nullif(sd, F.lit(0.0)))
        .alias("score_y"),
    )


def _scale_table(stats: pd.DataFrame, fits: int, size: int) -> np.ndarray:
    """1/SD per fit and feature; 0 for a constant feature, which is then never selected."""
    scale, known = np.zeros((fits, size)), stats[stats["sd"] > 0]
    scale[known["fit_id"] - 1, known["code"]] = 1.0 / known["sd"]
    return scale


def balanced_weights(counts: dict[int, int]) -> dict[int, float]:
    """n / (k * n_c) for each class (V4)."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def logistic_fit(
    train: DataFrame, c: float, l1: float, total: float, settings: NetSettings, family: str
) -> LogisticRegressionModel:
    """One penalised logistic fit on ``x, y, weight`` (V4, V5).

    The penalised likelihood C * sum(w * loss) + penalty, divided by C * sum(w),
    is Spark's objective with regParam = 1 / (C * sum(w)); ``total`` is sum(w).
    """
    model = LogisticRegression(
        featuresCol="x",
        labelCol="y",
        weightCol="weight",
        predictionCol="prediction",
        probabilityCol="probability",
        family=family,
        regParam=1.0 / (c * total),
        elasticNetParam=l1,
        standardization=False,
        maxIter=settings.max_iter,
        tol=settings.tol,
    )
    return model.fit(train)


def linear_fit(train: DataFrame, alpha: float, l1: float, sd_y: float, settings: NetSettings):
    """One penalised linear fit on ``x, y`` (V6).

    The target objective is sum of squares / (2n) + alpha * (l1 |b| + (1-l1)/2 b^2).
    Spark divides its squared part by the outcome's SD, hence the conversion.
    The solver is named: left to itself Spark takes another one up to 4,096
    features, and the two divide by different SDs. This one divides by the
    sample SD, at any width.
    """
    penalty = alpha * (l1 + sd_y * (1.0 - l1))
    model = LinearRegression(
        featuresCol="x",
        labelCol="y",
        predictionCol="prediction",
        regParam=penalty,
        elasticNetParam=alpha * l1 / penalty if penalty > 0 else 0.0,
        standardization=False,
        solver="l-bfgs",
        maxIter=settings.max_iter,
        tol=min(settings.tol, LINEAR_TOLERANCE),
    )
    return model.fit(train)


def _cells(prepared: Prepared, *keys: str) -> DataFrame:
    """Rows and outcome sums per (repeat, outer fold, inner fold), all fits in one aggregate."""
    zipped = F.arrays_zip("fold_of", "inner_of")
    return (
        prepared.table.select("y", F.posexplode(zipped).alias("repeat", "f"))
        .groupBy("repeat", F.col("f.fold_of").alias("fold"), F.col("f.inner_of").alias("inner_fold"), *keys)
        .agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    )


def _class_counts(prepared: Prepared) -> dict[tuple[int, int], dict[int, int]]:
    """Training rows per class for (fit, inner fold left out); 0 leaves none out."""
    splits = prepared.settings.outer_splits
    out: dict[tuple[int, int], dict[int, int]] = {}
    for row in _cells(prepared, "y").collect():
        for fold in range(1, splits + 1):
            if fold == row.fold:
                continue
            for g in range(prepared.settings.inner_cv + 1):
                if g != row.inner_fold:
                    train = out.setdefault((row.repeat * splits + fold, g), {})
                    train[int(row.y)] = train.get(int(row.y), 0) + row.n
    return out


def _outcome_cells(prepared: Prepared) -> tuple[np.ndarray, float]:
    """Training rows for (fit, inner fold left out; 0 leaves none out), and the SD of the outcome over all rows."""
    settings = prepared.settings
    total = np.zeros((settings.total_fits, settings.inner_cv + 1))
    whole = np.zeros(3)
    for row in _cells(prepared).collect():
        whole += (row.n, row.s, row.q)
        for fold in range(1, settings.outer_splits + 1):
            if fold != row.fold:
                for g in range(settings.inner_cv + 1):
                    total[row.repeat * settings.outer_splits + fold - 1, g] += row.n * (g != row.inner_fold)
    n, s, q = whole
    return total, math.sqrt(max(q - s * s / n, 0.0) / n)


@dataclass
class NetFits:
    """What all fits produced, as tables."""

    coef: DataFrame  # fit_id, class, feature, coef (non-zero rows)
    predictions: DataFrame  # fit_id, sample_id, y, ...
    inner_scores: DataFrame  # fit_id, <strength>, l1_ratio, inner_fold, score
    best: DataFrame  # fit_id, best_<strength>, best_l1_ratio, mean_score


def _grid(prepared: Prepared, family: str, strengths: np.ndarray, total: np.ndarray, weight: np.ndarray, stats: pd.DataFrame, spread: float = 1.0) -> paths.Grid:
    """``strengths (fit, g, l1, step)`` are penalties of the mean loss."""
    settings = prepared.settings
    return paths.Grid(
        family, settings.outer_splits, settings.inner_cv, np.array(sorted(settings.l1_ratios)), strengths, total,
        _scale_table(stats, settings.total_fits, len(prepared.vocab)), weight, spread,
        max(settings.tol, 1e-9), settings.max_iter,
    )


def _as_fits(prepared: Prepared, grid: paths.Grid, solved: paths.Solved, strength: str, values: np.ndarray, first_class: int) -> tuple[NetFits, DataFrame]:
    """Result tables, and the held-out linear predictors. ``values (fit, l1, step)`` are the strengths by name."""
    spark, ratios = prepared.spark, grid.l1_ratios
    fit, g, k, step = (a.ravel() for a in np.indices(solved.score.shape))
    inside = g > 0
    fit, g, k, step = fit[inside], g[inside], k[inside], step[inside]
    scores = pd.DataFrame({
        "fit_id": fit + 1, strength: values[fit, k, step], "l1_ratio": ratios[k], "inner_fold": g,
        "score": solved.score[fit, g, k, step], "converged": solved.converged[fit, g, k, step],
    })
    which = np.array(solved.best)
    best = pd.DataFrame({
        "fit_id": np.arange(1, grid.fits + 1), f"best_{strength}": values[np.arange(grid.fits), which[:, 0], which[:, 1]],
        "best_l1_ratio": ratios[which[:, 0]], "mean_score": solved.mean_score,
        "converged": solved.converged[np.arange(grid.fits), 0, which[:, 0], which[:, 1]],
    })
    at, lane, code = np.nonzero(solved.coef[..., :-1])
    names = np.array(prepared.vocab, dtype=object)
    coef = pd.DataFrame({"class": lane + first_class, "feature": names[code], "coef": solved.coef[at, lane, code], "fit_id": at + 1})
    raw = solved.coef * np.concatenate([grid.scale, np.ones((grid.fits, 1))], axis=1)[:, None, :]
    eta = paths.predict_held_out(prepared.table, raw, prepared.settings.outer_splits)
    scored = _null_scores(spark.createDataFrame(scores, f"fit_id int, {strength} double, l1_ratio double, inner_fold int, score double, converged boolean"), "score")
    chosen = spark.createDataFrame(best, f"fit_id int, best_{strength} double, best_l1_ratio double, mean_score double, converged boolean")
    return NetFits(spark.createDataFrame(coef, "class int, feature string, coef double, fit_id int"), eta, scored, _null_scores(chosen, "mean_score")), eta


def _null_scores(table: DataFrame, name: str) -> DataFrame:
    """A score that is not defined is null, as everywhere else."""
    return table.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def fit_logistic(prepared: Prepared, n_classes: int) -> NetFits:
    """Inner search, refit and held-out prediction for every outer fit (V4, V5, V7-V9).

    All grid points of all fits share scans, so their number grows with the
    strengths and not with the fits. Two classes are scored by the area under
    the curve, more by the mean log-likelihood.
    """
    settings = prepared.settings
    family = paths.BINARY if n_classes == 2 else paths.MULTICLASS
    counts = _class_counts(prepared)
    fits, sets = settings.total_fits, settings.inner_cv + 1
    weight, total = np.zeros((fits, n_classes)), np.zeros((fits, sets))
    for fit in range(fits):
        own = balanced_weights(counts[fit + 1, 0])
        weight[fit, list(own)] = list(own.values())
        total[fit] = [sum(own[c] * n for c, n in counts.get((fit + 1, g), {}).items()) for g in range(sets)]
    strengths = np.array(c_grid(settings.strengths))
    many = len(settings.l1_ratios)
    penalty = np.broadcast_to(1.0 / (strengths * np.maximum(total, 1e-300)[..., None])[:, :, None, :], (fits, sets, many, len(strengths)))
    grid = _grid(prepared, family, penalty, total, weight, training_stats(prepared).select("fit_id", "code", "sd").toPandas())
    solved = paths.solve_paths(prepared.table, grid, larger_is_better=True)
    values = np.broadcast_to(strengths, (fits, many, len(strengths)))
    found, eta = _as_fits(prepared, grid, solved, "C", values, 1 if n_classes == 2 else 0)
    if n_classes == 2:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta")[0]))
        probability = F.array(F.lit(1.0) - p, p)
        chosen = F.when(p >= 0.5, 1).otherwise(0)
    else:
        raised = F.transform("eta", lambda x: F.exp(x - F.array_max("eta")))
        whole = F.aggregate(raised, F.lit(0.0), lambda total, x: total + x)
        probability = F.transform(raised, lambda x: x / whole)
        chosen = (F.array_position("eta", F.array_max("eta")) - 1).cast("int")
    found.predictions = written(
        eta.select("sample_id", F.col("y_true").cast("int").alias("y_true"), chosen.alias("y_pred"), probability.alias("probability"), "fit_id"), "predictions"
    )
    return found


def fit_linear(prepared: Prepared) -> NetFits:
    """The same for a continuous outcome, scored by mean squared error (V6-V9).

    Up to ``moments.MOMENT_FEATURES`` features the grid is solved from sums of
    products, in one scan; beyond that those sums would be larger than the rows,
    and the paths are walked with screened working sets. Both go to the same
    optimum and give the same columns.
    """
    if len(prepared.vocab) <= moments.MOMENT_FEATURES:
        return _fit_linear_moments(prepared)
    return _fit_linear_paths(prepared)


def _fit_linear_moments(prepared: Prepared) -> NetFits:
    settings, vocab = prepared.settings, prepared.vocab
    cells = written(moments.moment_cells(prepared.table, len(vocab)), "moments")
    solved = written(
        moments.solve_fits(
            cells, len(vocab), settings.outer_splits, settings.inner_cv, settings.l1_ratios, settings.strengths, ALPHA_SPAN, settings.max_iter
        ),
        "solved",
    )
    refits = solved.filter("kind = 'coef'")
    scale = _scale_table(training_stats(prepared).select("fit_id", "code", "sd").toPandas(), settings.total_fits, len(vocab))
    raw, held = np.zeros((settings.total_fits, 1, len(vocab) + 1)), refits.select("fit_id", "code", "coef").toPandas()
    # Code -1 is the intercept, in the last place.
    raw[held["fit_id"] - 1, 0, held["code"]] = held["coef"]
    raw[:, 0, :-1] *= scale
    names = names_literal(vocab)
    return NetFits(
        refits.filter("code >= 0").select(
            "fit_id", F.lit(0).alias("class"), F.element_at(names, F.col("code") + 1).alias("feature"), "coef"
        ),
        _linear_predictions(paths.predict_held_out(prepared.table, raw, settings.outer_splits)),
        solved.filter("kind = 'score'").select("fit_id", "alpha", "l1_ratio", "inner_fold", "score", "converged"),
        refits.filter("code < 0").select(
            "fit_id", F.col("alpha").alias("best_alpha"), F.col("l1_ratio").alias("best_l1_ratio"), F.col("score").alias("mean_score"), "converged"
        ),
    )


def _linear_predictions(eta: DataFrame) -> DataFrame:
    return written(eta.select("sample_id", "y_true", F.col("eta")[0].alias("y_pred"), "fit_id"), "predictions")


def _fit_linear_paths(prepared: Prepared) -> NetFits:
    settings = prepared.settings
    stats = training_stats(prepared).toPandas()
    tops = (stats["score_y"].abs() / stats["n_train"]).groupby(stats["fit_id"]).max().reindex(range(1, settings.total_fits + 1), fill_value=0.0).to_numpy()
    ratios = np.array(sorted(settings.l1_ratios))
    steps = np.array(alpha_path(1.0, settings.strengths))
    alphas = np.maximum(tops, 1e-300)[:, None, None] / ratios[:, None] * steps
    total, spread = _outcome_cells(prepared)
    penalty = np.broadcast_to(alphas[:, None], (settings.total_fits, settings.inner_cv + 1, *alphas.shape[1:]))
    grid = _grid(prepared, paths.LINEAR, penalty, np.maximum(total, 1.0), np.ones((settings.total_fits, 1)), stats, max(spread, 1e-300))
    solved = paths.solve_paths(prepared.table, grid, larger_is_better=False)
    found, eta = _as_fits(prepared, grid, solved, "alpha", alphas, 0)
    found.predictions = _linear_predictions(eta)
    return found
