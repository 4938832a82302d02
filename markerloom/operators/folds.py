"""Folds and splits by hashed rank.

The order inside a class is that of md5("seed:repeat:sample"), so folds are
repeatable on any cluster size and can be recomputed by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.operators.presence import class_sizes
from markerloom.operators.ranking import exact_rank, hash_bucket


def shuffle_key(seed: Column | int, *parts: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in parts]))


def _dealt(samples: DataFrame, keys: list[str], digest: Column, stratified: bool) -> DataFrame:
    """Rank inside ``keys`` by (label, digest), counted across labels."""
    groups = ["label"] if stratified else []
    marked = samples.withColumn("_digest", digest).withColumn("_bucket", hash_bucket(F.col("_digest")))
    ranked = exact_rank(marked, keys, [*groups, "_bucket"], ["_digest", "sample_id"], "_rank")
    return ranked.drop("_digest", "_bucket")


def repeated_folds(
    samples: DataFrame,
    splits: int = 5,
    repeats: int = 20,
    seed: int = 42,
    stratified: bool = True,
    inner: int = 5,
) -> DataFrame:
    """``repeat, fold, inner_fold, fit_id`` for every sample and repeat (V1-V3).

    ``fold`` is where the sample is held out. ``inner_fold`` splits the rows
    for model selection: successive ranks of one outer fold go to successive
    inner folds, starting one further for each outer fold, so the union of the
    training folds stays balanced.
    """
    columns = ["sample_id", "label"] if stratified else ["sample_id"]
    each = samples.select(*columns, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    dealt = _dealt(each, ["repeat"], shuffle_key(seed, F.col("repeat"), F.col("sample_id")), stratified)
    zero = F.col("_rank") - 1
    return dealt.select(
        *columns,
        "repeat",
        (zero % splits + 1).cast("int").alias("fold"),
        ((F.floor(zero / splits) + zero % splits) % inner + 1).cast("int").alias("inner_fold"),
        ((F.col("repeat") - 1) * splits + zero % splits + 1).cast("int").alias("fit_id"),
    )


def holdout_split(samples: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified train/test mark per sample (F1): ``sample_id, label, is_test``."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    base = samples.select("sample_id", "label")
    marked = base.withColumn("_digest", shuffle_key(seed, F.col("sample_id")))
    marked = marked.withColumn("_bucket", hash_bucket(F.col("_digest")))
    ranked = exact_rank(marked, ["label"], ["_bucket"], ["_digest", "sample_id"], "_rank")
    # Half-to-even, per class; the class list is checked, so it can be a literal.
    taken = {label: round(n * test_size) for label, n in class_sizes(base).items()}
    if not taken:
        return base.withColumn("is_test", F.lit(False))
    limits = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair])
    return ranked.select("sample_id", "label", (F.col("_rank") <= F.element_at(limits, F.col("label"))).alias("is_test"))


def feature_half(features: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """Random share of the features."""
    marked = features.select("feature").withColumn("_digest", shuffle_key(seed, F.col("feature")))
    marked = marked.withColumn("_bucket", hash_bucket(F.col("_digest")))
    ranked = exact_rank(marked, [], ["_bucket"], ["_digest", "feature"], "_rank")
    return ranked.filter(F.col("_rank") <= round(features.count() * fraction)).select("feature")


def fold_sizes(folds: DataFrame, toi: str | None = None) -> DataFrame:
    """Train and test sizes per fit, with positives when a label is named (M9)."""
    positive = F.lit(0) if toi is None else F.when(F.col("label") == toi, 1).otherwise(0)
    held = folds.groupBy("repeat", "fold", "fit_id").agg(
        F.count("*").alias("n_test"), F.sum(positive).alias("positives_test")
    )
    whole = held.groupBy("repeat").agg(
        F.sum("n_test").alias("_n"), F.sum("positives_test").alias("_p")
    )
    sizes = held.join(whole, "repeat").select(
        "repeat",
        "fold",
        "fit_id",
        (F.col("_n") - F.col("n_test")).alias("n_train"),
        "n_test",
        (F.col("_p") - F.col("positives_test")).alias("positives_train"),
        "positives_test",
    )
    return sizes if toi is not None else sizes.drop("positives_train", "positives_test")
