"""Frequent itemsets up to a given length.

Spark ML's FPGrowth has no length bound, so sets are grown level by level. A
basket is coded once as the ascending codes of its frequent items, identical
baskets are merged with a weight, and every level is then a narrow pass: walk
each basket down the surviving prefixes, append a candidate item that the
basket holds, count. Only partial counts are shuffled, never the occurrences.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.operators.presence import item_codes, names_literal
from markerloom.session import written

ITEMSET_SCHEMA = "itemset array<string>, length int, freq bigint, support double"


def empty_itemsets(spark) -> DataFrame:
    return spark.createDataFrame([], ITEMSET_SCHEMA)


def _extensions(level: DataFrame) -> DataFrame:
    """``parent, item, node, next``: the items a set may be extended by.

    Only larger siblings (sets with the same parent) can follow. They are
    gathered as one array per parent, bounded by the number of frequent items.
    """
    siblings = level.groupBy("parent").agg(F.array_sort(F.collect_list("item")).alias("siblings"))
    return (
        level.join(siblings, "parent")
        .select("parent", "item", "node", F.filter("siblings", lambda other: other > F.col("item")).alias("next"))
        .filter(F.size("next") > 0)
    )


def frequent_itemsets(
    baskets: DataFrame,
    min_support: float = 0.6,
    max_len: int = 5,
    n_samples: int | None = None,
) -> DataFrame:
    """Itemsets with support >= ``min_support`` and at most ``max_len`` items.

    Empty baskets count in the denominator. Returns ``itemset`` (sorted),
    ``length``, ``freq`` and ``support``.
    """
    spark = baskets.sparkSession
    # One pass for both counts: a NULL item in every basket counts the samples.
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col("items"))
    counts = written(
        baskets.select(F.explode_outer(marked).alias("feature")).groupBy("feature").agg(F.count("*").alias("n")), "counts"
    )
    if n_samples is None:
        whole = counts.filter(F.col("feature").isNull()).first()
        n_samples = whole.n if whole else 0
    if n_samples == 0:
        return empty_itemsets(spark)
    min_count = max(math.ceil(min_support * n_samples), 1)

    # At most (mean basket size / min_support) items can pass, whatever n is.
    singles = counts.filter(F.col("feature").isNotNull() & (F.col("n") >= min_count)).collect()
    if not singles:
        return empty_itemsets(spark)
    # Rare items first: prefixes then have the fewest occurrences.
    singles.sort(key=lambda row: (row.n, row.feature))
    names = [row.feature for row in singles]

    coded = item_codes(baskets.select("items"), names).filter(F.size("codes") > 0).select("codes")
    # Merged baskets are few bytes but much work each: spread them again.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = written(coded.groupBy("codes").agg(F.count("*").alias("weight")).repartition(tasks), "baskets")

    # Sets are nodes of a prefix tree: (parent node, last item). Keys stay two
    # numbers however long the set is.
    root = -1
    level = spark.createDataFrame(
        [(root, code, code, [code], row.n) for code, row in enumerate(singles)],
        "parent bigint, item int, node bigint, codes array<int>, freq bigint",
    )
    levels = [level]
    walk = coded.select("codes", "weight", F.lit(root).cast("bigint").alias("parent"), F.explode("codes").alias("item"))
    for _ in range(1, max_len):
        steps = written(_extensions(level), "extensions")
        if steps.isEmpty():
            break
        walk = walk.join(steps, ["parent", "item"]).select(
            "codes",
            "weight",
            F.col("node").alias("parent"),
            # The outer form keeps the intersection from being computed twice
            # (once more in an inferred "not empty" filter).
            F.explode_outer(F.array_intersect("next", "codes")).alias("item"),
        ).filter(F.col("item").isNotNull())
        # Written, so that the next level goes on from here and repeats no join.
        walk = written(walk, "walk")
        counted = walk.groupBy("parent", "item").agg(F.sum("weight").alias("freq")).filter(F.col("freq") >= min_count)
        above = level.select(F.col("node").alias("parent"), F.col("codes").alias("stem"))
        level = written(
            counted.join(above, "parent").select(
                "parent",
                "item",
                F.monotonically_increasing_id().alias("node"),
                F.concat("stem", F.array("item")).alias("codes"),
                "freq",
            ),
            "itemsets",
        )
        levels.append(level)

    found = levels[0].select("codes", "freq")
    for later in levels[1:]:
        found = found.unionByName(later.select("codes", "freq"))
    lookup = names_literal(names)
    return found.select(
        F.array_sort(F.transform("codes", lambda code: F.element_at(lookup, code + 1))).alias("itemset"),
        F.size("codes").alias("length"),
        "freq",
        (F.col("freq") / F.lit(float(n_samples))).alias("support"),
    )


def by_support(itemsets: DataFrame) -> DataFrame:
    """Most frequent sets first; ties by the set itself."""
    return itemsets.orderBy(F.desc("support"), "itemset")
