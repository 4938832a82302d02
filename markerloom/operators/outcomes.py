"""Continuous outcomes and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(text: Column) -> Column:
    """Text to double; NULL when it is not a finite number."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def join_outcome(samples: DataFrame, meta: DataFrame, id_col: str, outcome_col: str, log1p: bool = False) -> DataFrame:
    """Inner join on the sample id with the outcome as a double."""
    value = numeric(F.col(f"`{outcome_col}`").cast("string"))
    outcomes = meta.select(
        F.col(f"`{id_col}`").cast("string").alias("sample_id"), (F.log1p(value) if log1p else value).alias("outcome")
    )
    return samples.join(outcomes, "sample_id")


def standardisation(counts: DataFrame, n_rows: Column | int) -> DataFrame:
    """Mean and population SD of 0/1 features from their counts.

    ``counts(feature, n)``; for 0/1 data mean = n/N and SD = sqrt(p (1-p)).
    """
    total = F.lit(float(n_rows)) if isinstance(n_rows, int) else n_rows.cast("double")
    p = F.col("n") / total
    return counts.withColumn("mean", p).withColumn("sd", F.sqrt(p * (F.lit(1.0) - p)))


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    """Standardised value; a constant feature becomes 0."""
    return F.when(sd == 0.0, F.lit(0.0)).otherwise((value - mean) / F.nullif(sd, F.lit(0.0)))
