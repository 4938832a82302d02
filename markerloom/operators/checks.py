"""Input checks that run before any heavy job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators.presence import class_counts, class_sizes

__all__ = [
    "class_sizes",
    "guard_counts",
    "require_binary",
    "require_columns",
    "require_features",
    "require_label",
    "require_multiclass",
    "require_numeric",
    "require_share",
    "require_unique_ids",
]

MIN_PER_CLASS = 5
MIN_CLASSES = 3
BAD_IDS_SHOWN = 10


def require_columns(df: DataFrame | Sequence[str], columns: Sequence[str], what: str = "the input") -> None:
    known = df.columns if isinstance(df, DataFrame) else df
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"columns not found in {what}: {', '.join(missing)}")


def require_label(samples: DataFrame, toi: str | None) -> None:
    """The target of interest is needed and has to occur (also where it was optional before)."""
    if toi is None:
        raise ValueError("a target of interest is required")
    if samples.filter(F.col("label") == toi).limit(1).isEmpty():
        raise ValueError(f"'{toi}' is not one of the labels")


def require_share(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")


def require_unique_ids(samples: DataFrame) -> None:
    """Every job joins by sample id, so a repeated or missing id is an error that names some."""
    counts = samples.groupBy("sample_id").agg(F.count("*").alias("n"))
    bad = counts.filter((F.col("n") > 1) | F.col("sample_id").isNull()).limit(BAD_IDS_SHOWN).collect()
    if bad:
        raise ValueError(f"sample ids must be present and differ; look at {sorted(str(row.sample_id) for row in bad)}")


def require_features(names: Sequence[str]) -> None:
    if not names:
        raise ValueError("no feature column found")


def guard_counts(samples: DataFrame, toi: str) -> DataFrame:
    """One row saying whether the data can carry a fit."""
    counts = class_counts(samples)
    one = F.when(F.col("label") == toi, F.col("n")).otherwise(0)
    sums = counts.agg(
        F.sum(one).alias("positives"),
        F.sum(F.col("n") - one).alias("negatives"),
        F.count("*").alias("n_classes"),
    )
    return sums.select(
        "positives",
        "negatives",
        "n_classes",
        ((F.col("positives") >= MIN_PER_CLASS) & (F.col("negatives") >= MIN_PER_CLASS)).alias("binary_ok"),
        (F.col("n_classes") >= MIN_CLASSES).alias("multiclass_ok"),
    )


def require_binary(samples: DataFrame, toi: str) -> tuple[int, int]:
    row = guard_counts(samples, toi).first()
    positives, negatives = int(row.positives or 0), int(row.negatives or 0)
    if not row.binary_ok:
        raise ValueError(
            f"'{toi}' has {positives} samples and all other labels {negatives}; each side needs at least {MIN_PER_CLASS}"
        )
    return positives, negatives


def require_multiclass(sizes: dict[str, int]) -> None:
    if len(sizes) < MIN_CLASSES:
        raise ValueError(f"this net is for {MIN_CLASSES} labels or more; the samples carry {', '.join(map(repr, sizes)) or 'none'}")


def require_numeric(outcomes: DataFrame) -> None:
    """``outcomes(sample_id, outcome)``: a NULL outcome is an error that names some ids."""
    bad = [row.sample_id for row in outcomes.filter(F.col("outcome").isNull()).limit(BAD_IDS_SHOWN).collect()]
    if bad:
        raise ValueError(f"the outcome is missing or not numeric, for example for samples {bad}")
