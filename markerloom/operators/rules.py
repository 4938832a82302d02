"""Association rules and marker groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.functions.cells import round_even
from markerloom.functions.sets import drop_one_subsets, proper_splits, set_union

METRICS = ("support", "confidence", "lift", "leverage", "conviction", "zhangs_metric")
MARKER_SCHEMA = "orthogroups array<string>, num_orthogroups int, " + ", ".join(f"{m} double" for m in METRICS)


def empty_markers(spark) -> DataFrame:
    """The typed empty table returned when nothing can be mined."""
    return spark.createDataFrame([], MARKER_SCHEMA)


def association_rules(itemsets: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """All splits of every itemset with their six metrics.

    The confidence filter needs only the antecedent's support, so it runs
    before the consequent is looked up.
    """
    supports = itemsets.select("itemset", "support")
    splits = (
        itemsets.filter(F.size("itemset") > 1)
        .select(F.col("support"), F.explode_outer(proper_splits(F.col("itemset"))).alias("split"))
        .select("split.antecedent", "split.consequent", "support")
    )
    left = supports.select(F.col("itemset").alias("antecedent"), F.col("support").alias("support_a"))
    right = supports.select(F.col("itemset").alias("consequent"), F.col("support").alias("support_c"))
    confident = (
        splits.join(left, "antecedent")
        .withColumn("confidence", F.col("support") / F.col("support_a"))
        .filter(F.col("confidence") >= min_confidence)
    )
    return with_metrics(confident.join(right, "consequent"))


def with_metrics(rules: DataFrame) -> DataFrame:
    """Rule metrics from the three supports."""
    s, a, c = F.col("support"), F.col("support_a"), F.col("support_c")
    confidence = s / a
    leverage = s - a * c
    one = F.lit(1.0)
    conviction = F.when(confidence >= 1.0, F.lit(float("inf"))).otherwise(
        (one - c) / F.nullif(one - confidence, F.lit(0.0))
    )
    bound = F.greatest(s * (one - a), a * (c - s))
    zhang = F.when(bound == 0.0, F.lit(0.0)).otherwise(leverage / F.nullif(bound, F.lit(0.0)))
    return rules.select(
        F.col("antecedent").alias("antecedents"),
        F.col("consequent").alias("consequents"),
        s.alias("support"),
        confidence.alias("confidence"),
        (confidence / c).alias("lift"),
        leverage.alias("leverage"),
        conviction.alias("conviction"),
        zhang.alias("zhangs_metric"),
    )


def filter_rules(
    rules: DataFrame,
    min_lift: float = 1.5,
    min_conviction: float = 1.5,
    min_zhang: float = 0.5,
    min_leverage: float | None = None,
) -> DataFrame:
    """Thresholds on unrounded metrics (R4); leverage only when asked for."""
    kept = rules.filter(
        (F.col("lift") >= min_lift) & (F.col("conviction") >= min_conviction) & (F.col("zhangs_metric") >= min_zhang)
    )
    return kept if min_leverage is None else kept.filter(F.col("leverage") >= min_leverage)


def collapse_rules(rules: DataFrame) -> DataFrame:
    """Rounded marker rules, one row per (set, support, lift).

    Of equal rows the one with the highest confidence stays, then the one with
    the first antecedent; a min over a struct needs no sort and combines early.
    """
    rounded = rules.select(
        set_union(F.col("antecedents"), F.col("consequents")).alias("orthogroups"),
        "antecedents",
        *[round_even(F.col(metric)).alias(metric) for metric in METRICS],
    )
    carried = ("confidence", "leverage", "conviction", "zhangs_metric")
    first = F.min(F.struct((-F.col("confidence")).alias("_order"), "antecedents", *carried)).alias("first")
    return (
        rounded.groupBy("orthogroups", "support", "lift")
        .agg(first)
        .select(
            "orthogroups",
            F.size("orthogroups").alias("num_orthogroups"),
            "support",
            "first.confidence",
            "lift",
            "first.leverage",
            "first.conviction",
            "first.zhangs_metric",
        )
    )


def metric_range(rules: DataFrame) -> DataFrame:
    """Smallest and largest value of each metric (G13): one row per metric."""
    bounds = rules.agg(
        *[F.min(m).alias(f"min_{m}") for m in METRICS], *[F.max(m).alias(f"max_{m}") for m in METRICS]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"min_{m}").alias("min_value"), F.col(f"max_{m}").alias("max_value"))
            for m in METRICS
        ]
    )
    return bounds.select(F.explode(rows).alias("r")).select("r.*")


def rule_features(markers: DataFrame) -> DataFrame:
    """Distinct features over all marker rules."""
    return markers.select(F.explode("orthogroups").alias("feature")).distinct()


def subtract_rules(target: DataFrame, non_target: DataFrame) -> DataFrame:
    """Target rules without any feature of a non-target rule.

    Rules with the same set stand or fall together, so the anti-join is on the
    set and needs no rule number.
    """
    spoiled = (
        target.select("orthogroups")
        .distinct()
        .select("orthogroups", F.explode("orthogroups").alias("feature"))
        .join(rule_features(non_target), "feature", "left_semi")
        .select("orthogroups")
        .distinct()
    )
    return target.join(spoiled, "orthogroups", "left_anti")


def suggest_groups(markers: DataFrame, max_biomk: int = 4, top: int | None = 500) -> DataFrame:
    """How often each set of ``max_biomk`` features lies in a longest rule.

    A rule of max_biomk + 1 features has exactly max_biomk + 1 such subsets.
    """
    groups = (
        markers.filter(F.col("num_orthogroups") == max_biomk + 1)
        .select(F.explode(drop_one_subsets(F.col("orthogroups"))).alias("features"))
        .groupBy("features")
        .agg(F.count("*").alias("co_occurance"))
        .select(F.concat_ws(", ", "features").alias("group"), "co_occurance")
    )
    return groups if top is None else groups.orderBy(F.desc("co_occurance"), "group").limit(top)


def marker_rules(
    baskets: DataFrame,
    min_support: float = 0.6,
    max_len: int = 5,
    min_confidence: float = 0.8,
    **thresholds: float | None,
) -> DataFrame:
    """Baskets to filtered, collapsed marker rules."""
    from markerloom.operators.patterns import frequent_itemsets

    itemsets = frequent_itemsets(baskets, min_support, max_len)
    return collapse_rules(filter_rules(association_rules(itemsets, min_confidence), **thresholds))
