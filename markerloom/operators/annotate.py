"""Names for final features by majority of their annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The gene-id prefix of an entry, the separator of entries, the
# text for features without any entry, and when the runner-up is named too.
GENE_ID = r"\w+_\d+ "
SEPARATOR = ", "
NO_ANNOTATION = "no annotations"
CLEAR_SHARE = 0.8
FEW_ENTRIES = 10


def unpivot_annotation(wide: DataFrame, feature_col: str, sample_cols: Sequence[str]) -> DataFrame:
    """Wide annotation table to ``feature, sample_id, entry`` without empty cells (A3)."""
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in sample_cols]
    long = wide.select(F.col(f"`{feature_col}`").alias("feature"), *cells).unpivot(
        "feature", [F.col(f"`{c}`") for c in sample_cols], "sample_id", "entry"
    )
    return long.filter(F.col("entry").isNotNull())


def restrict_annotations(annotations: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Only the given samples and features."""
    return annotations.join(samples.select("sample_id").distinct(), "sample_id", "left_semi").join(
        features.select("feature").distinct(), "feature", "left_semi"
    )


def product_counts(annotations: DataFrame) -> DataFrame:
    """How often each product is named per feature."""
    entries = annotations.select("feature", F.explode(F.split("entry", SEPARATOR)).alias("entry"))
    return (
        entries.select("feature", F.regexp_replace("entry", GENE_ID, "").alias("product"))
        .groupBy("feature", "product")
        .agg(F.count("*").alias("n"))
    )


def vote_annotations(annotations: DataFrame, features: DataFrame) -> DataFrame:
    """Most common product per feature, with the runner-up when it is close."""
    counts = product_counts(annotations)
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "product")
    # The rank <= 2 filter is pushed below the shuffle as a per-group limit.
    best = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 2)
    pairs = best.groupBy("feature").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("product"))).alias("top"),
        F.max(F.when(F.col("_rank") == 1, F.col("n"))).alias("top_n"),
        F.max(F.when(F.col("_rank") == 2, F.col("product"))).alias("second"),
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    unclear = (F.col("top_n") / F.col("total").cast("double") < CLEAR_SHARE) & (F.col("total") > FEW_ENTRIES)
    named = F.when(unclear, F.concat_ws(SEPARATOR, "top", "second")).otherwise(F.col("top"))
    voted = pairs.join(totals, "feature").select("feature", named.alias("name"))
    return (
        features.select("feature")
        .distinct()
        .join(voted, "feature", "left")
        .select(F.col("feature").alias("Orthogroup"), F.coalesce("name", F.lit(NO_ANNOTATION)).alias("Annotation(s)"))
    )
