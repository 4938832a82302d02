"""Random forest: fit, scores, seed search, importance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.operators.folds import holdout_split
from markerloom.operators.metrics import class_report, multiclass_scores
from markerloom.operators.stability import choose_seeds
from markerloom.session import written

active_session = SparkSession.getActiveSession

# Spark's depth limit; the forest this replaces has none.
MAX_DEPTH = 30


def as_presence(vectors: DataFrame, column: str = "features") -> DataFrame:
    """Marks every position of a 0/1 vector column as a category with the values 0 and 1.

    For plain numbers Spark takes split points from a sample of the rows, and a
    feature that is constant in the sample can never be split on. Categories
    need no split points, so every row counts.
    """
    first = vectors.select(column).head()
    size = first[0].size if first else 0
    attributes = {"nominal": [{"idx": i, "vals": ["0", "1"]} for i in range(size)]}
    return vectors.withMetadata(column, {"ml_attr": {"attrs": attributes, "num_attrs": size}})


def fit_forest(
    vectors: DataFrame, seed: int = 0, trees: int = 100, max_depth: int = MAX_DEPTH, min_instances: int = 1
) -> RandomForestClassificationModel:
    """Gini forest with sqrt features per split and bootstrap rows (F2).

    ``vectors(features, encoded_class)``; all features are 0/1 categories, so
    two bins are exact. A deep forest with ``min_instances=1`` grows with the
    rows and lives on the driver; raise it for very many samples.
    """
    forest = RandomForestClassifier(
        labelCol="encoded_class",
        featuresCol="features",
        predictionCol="y_pred",
        leafCol="leaf",
        numTrees=trees,
        maxDepth=max_depth,
        maxBins=2,
        minInstancesPerNode=min_instances,
        impurity="gini",
        featureSubsetStrategy="sqrt",
        bootstrap=True,
        seed=seed,
        maxMemoryInMB=1024,
    )
    return forest.fit(as_presence(vectors))


def predict(model: RandomForestClassificationModel, vectors: DataFrame) -> DataFrame:
    """``sample_id, y_true, y_pred`` as class codes."""
    return model.transform(vectors).select(
        "sample_id", F.col("encoded_class").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")
    )


def forest_report(model: RandomForestClassificationModel, test: DataFrame) -> DataFrame:
    """Per-class report on held-out rows."""
    return class_report(predict(model, test))


def with_split(vectors: DataFrame, test_size: float, seed: int) -> DataFrame:
    """Vectors with their stratified train/test mark, written once and read per fit."""
    marks = holdout_split(vectors.select("sample_id", F.col("encoded_class").cast("string").alias("label")), test_size, seed)
    joined = vectors.join(marks.select("sample_id", "is_test"), "sample_id")
    # A fixed row order per task keeps the bootstrap draws repeatable.
    return written(joined.sortWithinPartitions("sample_id"), "split")


def seed_scores(
    vectors: DataFrame,
    split_seeds: Iterable[int] = range(50),
    model_seeds: Sequence[int] = tuple(range(50)),
    test_size: float = 0.2,
    parallelism: int = 4,
    **forest: int,
) -> DataFrame:
    """Scores of one fit per (split seed, model seed) pair.

    Fits are independent and each is distributed; a small pool keeps the
    cluster busy between them. The default is the full search of 2,500 fits.
    """

    def score(split: DataFrame, i: int, j: int) -> tuple:
        model = fit_forest(split.filter(~F.col("is_test")), seed=j, **forest)
        row = multiclass_scores(predict(model, split.filter("is_test"))).first()
        return i, j, row.accuracy, row.macro_f1, row.macro_precision

    rows: list[tuple] = []
    with ThreadPoolExecutor(parallelism) as pool:
        for i in split_seeds:
            split = with_split(vectors, test_size, i)
            rows += pool.map(lambda j, split=split, i=i: score(split, i, j), model_seeds)
    return vectors.sparkSession.createDataFrame(
        rows, "split_seed int, model_seed int, accuracy double, macro_f1 double, macro_precision double"
    )


def best_seeds(scores: DataFrame) -> tuple[int, int]:
    best = choose_seeds(scores).first()
    return best.split_seed, best.model_seed


def feature_importance(model: RandomForestClassificationModel, vocab: Sequence[str], spark) -> DataFrame:
    """``feature, importance``; features the forest never used have 0."""
    weights = model.featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(vocab, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, n: int = 50) -> DataFrame:
    """The n most important features, ties by name."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def save_forest(
    model: RandomForestClassificationModel, path: str, vocab: Sequence[str], classes: Sequence[str], force: bool = False
) -> None:
    """The model, and beside it the features and classes its positions stand for (K3)."""
    (model.write().overwrite() if force else model.write()).save(f"{path.rstrip('/')}/model")
    named = [("feature", i, name) for i, name in enumerate(vocab)] + [("class", i, name) for i, name in enumerate(classes)]
    table = active_session().createDataFrame(named, "kind string, position int, name string")
    table.coalesce(1).write.mode("overwrite" if force else "errorifexists").parquet(f"{path.rstrip('/')}/names")


def load_forest(path: str, vocab: Sequence[str], classes: Sequence[str]) -> RandomForestClassificationModel:
    """A saved forest; features or classes other than those it was fitted on are an error (K3)."""
    rows = active_session().read.parquet(f"{path.rstrip('/')}/names").orderBy("position").collect()
    for kind, given in (("feature", list(vocab)), ("class", list(classes))):
        known = [row.name for row in rows if row.kind == kind]
        if known != given:
            differ = sorted(set(known) ^ set(given))[:5]
            raise ValueError(f"the saved forest was fitted on other {kind} names, for example {differ or 'in another order'}")
    return RandomForestClassificationModel.load(f"{path.rstrip('/')}/model")
