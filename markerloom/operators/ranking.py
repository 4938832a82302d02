"""Exact ranks and running sums without one task per group.

``row_number() over (partition by class)`` puts a whole class in one task. Here
rows are first split by an order-preserving bucket; ranks are taken inside
(keys, bucket) and shifted by the totals of the lower buckets, which come from
a small aggregate. The result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerloom.session import written


def _offsets(sized: DataFrame, keys: Sequence[str], buckets: Sequence[str], totals: Sequence[str]) -> DataFrame:
    below = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    shifted = [F.coalesce(F.sum(t).over(below), F.lit(0)).alias(f"{t}_below") for t in totals]
    return sized.select(*keys, *buckets, *shifted)


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
) -> DataFrame:
    """1-based row number inside ``keys`` ordered by (buckets, order).

    ``buckets`` must be a coarsening of the order: sorting by (buckets, order)
    has to be the wanted sort.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    sized = df.groupBy(*keys, *buckets).agg(F.count("*").alias("_n"))
    offsets = _offsets(sized, keys, buckets, ["_n"])
    within = Window.partitionBy(*keys, *buckets).orderBy(*order)
    ranked = df.withColumn("_within", F.row_number().over(within)).join(offsets, [*keys, *buckets])
    return ranked.withColumn(name, F.col("_within") + F.col("_n_below")).drop("_within", "_n_below", "_all")


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5 text: an order-preserving bucket."""
    return F.substring(digest, 1, digits)


def sum_below(
    df: DataFrame, keys: Sequence[str], value: str, total: str, name: str, cuts: int = 32
) -> DataFrame:
    """For each row, the sum of ``total`` over rows of the same keys with a smaller ``value``.

    ``value`` must be distinct inside ``keys``. Buckets are cut at approximate
    quantiles and halved further by position inside their range, so a skewed
    score still spreads; quantile error only shifts the bucket sizes.
    """
    shares = [i / cuts for i in range(cuts + 1)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("_cuts"))
    # Written, so that the planner knows its size: it is broadcast when small,
    # and one group with most rows is then never gathered in one task.
    placed = df.join(written(bounds, "bounds"), list(keys))
    # Index of the last cut at or below the value; values outside are clamped.
    slot = F.greatest(F.size(F.filter("_cuts", lambda c: c <= F.col(value))), F.lit(1))
    low = F.element_at("_cuts", slot)
    high = F.element_at("_cuts", F.least(slot + 1, F.lit(cuts + 1)))
    part = F.when(high > low, F.floor((F.col(value) - low) / (high - low) * cuts)).otherwise(0)
    placed = placed.withColumn("_slot", slot).withColumn("_part", F.least(F.greatest(part, F.lit(0)), F.lit(cuts)))
    placed = placed.drop("_cuts")
    buckets = ["_slot", "_part"]
    sized = placed.groupBy(*keys, *buckets).agg(F.sum(total).alias("_t"))
    within = Window.partitionBy(*keys, *buckets).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum(total).over(within), F.lit(0)))
    joined = inside.join(_offsets(sized, keys, buckets, ["_t"]), [*keys, *buckets])
    return joined.withColumn(name, F.col("_inside") + F.col("_t_below")).drop("_inside", "_t_below", *buckets)
