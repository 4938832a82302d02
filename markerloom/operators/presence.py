"""Presence data: from cells to baskets, and feature pruning.

The working form is one row per sample: ``sample_id, label, items`` where
``items`` holds the present features (an empty array for an empty sample). The
label rides along, so counting features or slicing samples never needs a
shuffle by sample; ``to_long`` gives the ``(sample_id, feature)`` form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.functions.cells import is_present

# A vocabulary is shipped to every task (and a model's coefficients to the
# driver), so its length is checked; it never grows with the samples.
VOCABULARY_LIMIT = 1 << 20
CLASS_LIMIT = 10_000

# What a NULL label is called: a class of its own, like any other text.
MISSING_LABEL = "missing"
_APART = "\x1f"


def names_literal(names: Sequence[str]) -> Column:
    """A list of names as one constant: one joined text that the optimizer splits once.

    An array literal makes one expression per name, which takes seconds for
    thousands of names.
    """
    if not names:
        return F.array().cast(T.ArrayType(T.StringType()))
    if any(_APART in name for name in names):
        return F.lit(list(names))
    return F.split(F.lit(_APART.join(names)), _APART)


def fill_labels(samples: DataFrame) -> DataFrame:
    """NULL labels become ``MISSING_LABEL``. Every job does this first."""
    return samples.withColumn("label", F.coalesce("label", F.lit(MISSING_LABEL)))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unpivot_cells(wide: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Wide cells to ``sample_id, feature, value``, zeros included."""
    return wide.select(_quoted(id_col).cast("string").alias("sample_id"), *[_quoted(c) for c in features]).unpivot(
        "sample_id", [_quoted(c) for c in features], "feature", "value"
    )


def baskets_from_wide(
    wide: DataFrame, id_col: str, features: Sequence[str], label_col: str | None = None
) -> DataFrame:
    """Wide table of text cells to baskets, inside the row."""
    present = [F.when(is_present(_quoted(name).cast("string")), F.lit(name)) for name in features]
    columns = [_quoted(id_col).cast("string").alias("sample_id")]
    if label_col is not None:
        columns.append(_quoted(label_col).cast("string").alias("label"))
    return wide.select(*columns, F.array_compact(F.array(*present)).alias("items"))


def baskets_from_long(samples: DataFrame, presence: DataFrame) -> DataFrame:
    """``presence(sample_id, feature)`` to baskets; every sample is kept.

    Repeats are removed by a partial aggregate first, so a sample that owns a
    third of the raw rows still ends as at most one row per feature.
    """
    items = (
        presence.select("sample_id", "feature")
        .distinct()
        .groupBy("sample_id")
        .agg(F.array_sort(F.collect_list("feature")).alias("items"))
    )
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return samples.join(items, "sample_id", "left").withColumn("items", F.coalesce("items", empty))


def exploded(baskets: DataFrame, *columns: str | Column) -> DataFrame:
    """One ``feature`` row per item, with the given columns.

    A plain explode makes the optimizer add ``size(items) > 0`` below it, with
    the whole expression behind ``items`` (tokenising, say) copied into the
    filter. The outer form avoids the second evaluation.
    """
    rows = baskets.select(*columns, F.explode_outer("items").alias("feature"))
    return rows.filter(F.col("feature").isNotNull())


def to_long(baskets: DataFrame) -> DataFrame:
    """Baskets to ``sample_id, feature`` rows; a narrow step."""
    return exploded(baskets, "sample_id")


def feature_counts(baskets: DataFrame) -> DataFrame:
    """How many samples hold each feature (G1)."""
    return exploded(baskets).groupBy("feature").agg(F.count("*").alias("n"))


def class_counts(samples: DataFrame) -> DataFrame:
    """Samples per label."""
    return samples.groupBy("label").agg(F.count("*").alias("n"))


def select_features(
    features: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """Predictor choice on a table with a ``feature`` column."""
    if include is not None and exclude is not None:
        raise ValueError("give include or exclude, not both")
    if include is not None:
        features = features.filter(F.col("feature").isin(*include))
    if exclude is not None:
        features = features.filter(~F.col("feature").isin(*exclude))
    if prefix is not None:
        features = features.filter(F.col("feature").startswith(prefix))
    return features


def drop_labels(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Leave out the samples of some classes; a sample without a label stays."""
    return samples.filter(F.col("label").isNull() | ~F.col("label").isin(*labels)) if labels else samples


def keep_labels(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Keep only the samples of some classes."""
    return samples.filter(F.col("label").isin(*labels)) if labels else samples


def binary_target(samples: DataFrame, toi: str) -> DataFrame:
    """Target of interest to 1, everything else to 0 (P5)."""
    return samples.withColumn("y", F.when(F.col("label") == toi, 1).otherwise(0))


def label_codes(samples: DataFrame) -> DataFrame:
    """Sorted labels numbered from 0 (P6); one row per class. NULL labels count as ``MISSING_LABEL``."""
    labels = list(class_sizes(fill_labels(samples)))
    return samples.sparkSession.createDataFrame(list(enumerate(labels)), "encoded_class int, label string")


def class_sizes(samples: DataFrame) -> dict[str, int]:
    """Label counts on the driver, sorted by label; the number of classes is checked."""
    rows = class_counts(samples).limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError("the label column has too many different values for a class label")
    return {row.label: row.n for row in sorted(rows, key=lambda row: (row.label is not None, row.label or ""))}


def encode_labels(samples: DataFrame) -> DataFrame:
    """Attach ``encoded_class`` to every sample.

    The checked label list is a literal, so no join on the label is needed and
    a label that holds most rows causes no skew. NULL labels count as
    ``MISSING_LABEL``.
    """
    samples = fill_labels(samples)
    labels = names_literal(list(class_sizes(samples)))
    return samples.withColumn("encoded_class", (F.array_position(labels, F.col("label")) - 1).cast("int"))


def feature_profile(baskets: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Count and set signature per feature in one partial aggregate.

    Two features with the same samples have the same count and the same XOR of
    two independent 64-bit hashes of the sample ids (128 bits together). The
    state per feature is three longs, however frequent the feature is.
    ``catalogue(feature, position)`` gives a wide table's column order and its
    all-absent columns; without it the order is by name.
    """
    profile = (
        exploded(
            baskets, F.xxhash64("sample_id").alias("h1"), F.xxhash64(F.lit("second"), "sample_id").alias("h2")
        )
        .groupBy("feature")
        .agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    )
    if catalogue is None:
        return profile.withColumn("position", F.lit(0))
    return catalogue.select("feature", "position").join(profile, "feature", "left").fillna(0, ["n", "x1", "x2"])


def drop_duplicate_features(profile: DataFrame) -> DataFrame:
    """One feature per distinct presence vector, the first column wins."""
    first = F.min(F.struct("position", "feature")).alias("first")
    return profile.groupBy("n", "x1", "x2").agg(first).select(F.col("first.feature").alias("feature"), "n")


def default_bounds(n_samples: int, low: int | None = None, high: int | None = None) -> tuple[int, int]:
    """Prevalence bounds; None means 5 % and 95 %, and 0 is a real bound.

    Python's round is half-to-even, which is the rule wanted here.
    """
    return (
        round(n_samples * 0.05) if low is None else low,
        round(n_samples * 0.95) if high is None else high,
    )


def prune_features(
    baskets: DataFrame,
    low: int | None = None,
    high: int | None = None,
    catalogue: DataFrame | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """Deduplicated features within the prevalence bounds: ``feature, n``.

    Equal vectors have equal counts, so the bounds are applied before the
    duplicate step without changing the result.
    """
    if low is None or high is None:
        n_samples = baskets.count() if n_samples is None else n_samples
    low, high = default_bounds(n_samples or 0, low, high)
    profile = feature_profile(baskets, catalogue)
    return drop_duplicate_features(profile.filter(F.col("n").between(low, high)))


def vocabulary(features: DataFrame) -> list[str]:
    """Kept feature names, sorted, on the driver; the length is checked."""
    names = [row.feature for row in features.select("feature").limit(VOCABULARY_LIMIT + 1).collect()]
    if len(names) > VOCABULARY_LIMIT:
        raise ValueError(f"more than {VOCABULARY_LIMIT} features are left; tighten the prevalence bounds")
    return sorted(names)


def encode_items(baskets: DataFrame, vocab: Sequence[str], column: str = "features") -> DataFrame:
    """Add a sparse 0/1 vector over ``vocab`` (P11: what is absent is 0).

    Each task looks items up in a broadcast dictionary, so restricting a
    basket to the kept features costs one probe per item and no shuffle.
    """
    if not vocab:
        raise ValueError("no feature is left")
    model = CountVectorizerModel.from_vocabulary(list(vocab), inputCol="items", outputCol=column)
    model.setBinary(True)
    return model.transform(baskets)


def item_codes(baskets: DataFrame, vocab: Sequence[str], column: str = "codes") -> DataFrame:
    """Add the ascending positions in ``vocab`` of a basket's kept items."""
    encoded = encode_items(baskets, vocab, "_vector")
    return encoded.withColumn(column, F.unwrap_udt("_vector").getField("indices")).drop("_vector")


def vector_items(column: str, vocab: Sequence[str]) -> Column:
    """Names of the non-zero positions of a 0/1 vector over ``vocab``."""
    names = names_literal(vocab)
    return F.transform(F.unwrap_udt(column).getField("indices"), lambda code: F.element_at(names, code + 1))


def restrict_items(baskets: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Baskets holding only features of ``vocab``."""
    if not vocab:
        return baskets.withColumn("items", F.array().cast(T.ArrayType(T.StringType())))
    encoded = encode_items(baskets, vocab, "_vector")
    return encoded.withColumn("items", vector_items("_vector", vocab)).drop("_vector")
