"""Itemset, rule and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markerloom.catalog.common import BRANDS, WORDS, Registry, listed, rounded
from markerloom.operators import annotate, patterns, rules
from markerloom.sources import tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles


def itemset_ctes(where: str, support: float, max_len: int, prefix: str = "") -> str:
    """``<prefix>itemsets(items, freq, support)``: each level grows from the frequent itemsets of the one before, keyed by joined text."""
    p = prefix
    parts = [
        f"{p}n AS MATERIALIZED (SELECT count(*) AS total, ceil({support}::DOUBLE * count(*)) AS needed FROM samples WHERE {where})",
        f"""{p}held1 AS MATERIALIZED (SELECT p.sample_id, p.feature AS key, p.feature AS last
            FROM presence p JOIN samples s ON p.sample_id = s.sample_id WHERE {where})""",
    ]
    for k in range(1, max_len + 1):
        parts.append(
            f"{p}level{k} AS MATERIALIZED (SELECT key, count(*) AS freq FROM {p}held{k} GROUP BY key HAVING count(*) >= (SELECT needed FROM {p}n))"
        )
        if k < max_len:
            parts.append(f"{p}often{k} AS MATERIALIZED (SELECT * FROM {p}held{k} WHERE key IN (SELECT key FROM {p}level{k}))")
            parts.append(
                f"""{p}held{k + 1} AS (SELECT h.sample_id, h.key || ',' || o.feature AS key, o.feature AS last
            FROM {p}often{k} h JOIN (SELECT sample_id, last AS feature FROM {p}often1) o ON o.sample_id = h.sample_id AND o.feature > h.last)"""
            )
    union = " UNION ALL ".join(f"SELECT key, freq FROM {p}level{k}" for k in range(1, max_len + 1))
    parts.append(
        f"""{p}itemsets AS MATERIALIZED (SELECT key, string_split(key, ',') AS items, freq, freq / total::DOUBLE AS support
            FROM ({union}), {p}n)"""
    )
    return ",\n".join(parts)


def rule_ctes(prefix: str = "") -> str:
    """All splits with their metrics: ``<prefix>rules``."""
    p = prefix
    return f"""
{p}splits AS MATERIALIZED (
  SELECT items, support,
         [x FOR x, i IN items IF (mask >> (i - 1)) & 1 = 1] AS antecedents,
         [x FOR x, i IN items IF (mask >> (i - 1)) & 1 = 0] AS consequents,
         array_to_string(antecedents, ',') AS antecedent, array_to_string(consequents, ',') AS consequent
  FROM (SELECT items, support, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM {p}itemsets WHERE len(items) > 1)),
{p}begun AS MATERIALIZED (SELECT s.*, a.support AS sa FROM {p}splits s JOIN {p}itemsets a ON s.antecedent = a.key),
{p}supported AS MATERIALIZED (
  SELECT s.items, s.antecedents, s.consequents, s.support, s.sa, c.support AS sc, s.support / s.sa AS confidence
  FROM {p}begun s JOIN {p}itemsets c ON s.consequent = c.key),
{p}rules AS (
  SELECT items, antecedents, consequents, support, confidence, confidence / sc AS lift, support - sa * sc AS leverage,
         CASE WHEN confidence >= 1 THEN 'infinity'::DOUBLE ELSE (1 - sc) / (1 - confidence) END AS conviction,
         CASE WHEN greatest(support * (1 - sa), sa * (sc - support)) = 0 THEN 0
              ELSE (support - sa * sc) / greatest(support * (1 - sa), sa * (sc - support)) END AS zhangs_metric
  FROM {p}supported)"""


def marker_ctes(condition: str, prefix: str = "") -> str:
    """Filtered, rounded and collapsed rules: ``<prefix>markers``."""
    p = prefix
    r = ", ".join(f"round_even({m}, 4) AS {m}" for m in rules.METRICS)
    return f"""
{p}kept AS (SELECT items AS orthogroups, antecedents, {r} FROM {p}rules WHERE {condition}),
{p}markers AS (
  SELECT orthogroups, len(orthogroups)::INTEGER AS num_orthogroups, support, confidence, lift, leverage, conviction, zhangs_metric
  FROM {p}kept QUALIFY row_number() OVER (PARTITION BY orthogroups, support, lift ORDER BY confidence DESC, antecedents) = 1)"""


METRIC_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in rules.METRICS)
MARKER_SQL = (
    "SELECT array_to_string(orthogroups, ',') AS orthogroups, num_orthogroups, support, confidence, lift, leverage, "
    "conviction, zhangs_metric FROM "
)

ALL = "TRUE"
BRAND_ITEMSETS = f"WITH {BRANDS}, {itemset_ctes(ALL, 0.5, 3)}"
BRAND_RULES = f"{BRAND_ITEMSETS}, {rule_ctes()}"
ENGLISH = "label = 'en'"
OTHERS = "label <> 'en'"
ENGLISH_ITEMSETS = f"WITH {WORDS}, {itemset_ctes(ENGLISH, 0.7, 5)}"
WORD_CONDITION = "confidence >= 0.8 AND lift >= 1.02 AND conviction >= 1.1 AND zhangs_metric >= 0.1"
WORD_THRESHOLDS = {"min_lift": 1.02, "min_conviction": 1.1, "min_zhang": 0.1}


def brand_itemsets(spark, sf, max_len=3):
    return patterns.frequent_itemsets(tables.brand_baskets(spark, sf), 0.5, max_len)


def english_itemsets(spark, sf, max_len=5):
    return patterns.frequent_itemsets(tables.document_baskets(spark, sf).filter(F.col("label") == "en"), 0.7, max_len)


def shown_itemsets(itemsets):
    return itemsets.select(
        listed("itemset").alias("itemset"), "length", "freq", rounded("support")
    )


ITEMSET_SQL = "SELECT array_to_string(items, ',') AS itemset, len(items)::INTEGER AS length, freq, round(support, 6) AS support FROM itemsets"


@registry.add("itemsets_brands", f"{BRAND_ITEMSETS} {ITEMSET_SQL}")
def _itemsets_brands(spark, sf):
    return shown_itemsets(brand_itemsets(spark, sf))


@registry.add("itemsets_words", f"{ENGLISH_ITEMSETS} {ITEMSET_SQL}")
def _itemsets_words(spark, sf):
    return shown_itemsets(english_itemsets(spark, sf))


@registry.add("itemsets_ranked", f"{ENGLISH_ITEMSETS}, shown AS ({ITEMSET_SQL}) SELECT * FROM shown ORDER BY freq DESC, itemset LIMIT 20")
def _itemsets_ranked(spark, sf):
    # Commas sort below letters, so the order by array and by joined text agree.
    return shown_itemsets(patterns.by_support(english_itemsets(spark, sf)).limit(20))


def shown_rules(found):
    return found.select(
        listed("antecedents").alias("antecedents"),
        listed("consequents").alias("consequents"),
        *[rounded(m) for m in rules.METRICS],
    )


RULE_SQL = (
    "SELECT array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents, "
    f"{METRIC_SQL} FROM rules"
)


@registry.add("rules_all", f"{BRAND_RULES} {RULE_SQL}")
def _rules_all(spark, sf):
    return shown_rules(rules.association_rules(brand_itemsets(spark, sf), 0.0))


@registry.add("rules_confident", f"{BRAND_RULES} {RULE_SQL} WHERE confidence >= 0.8")
def _rules_confident(spark, sf):
    return shown_rules(rules.association_rules(brand_itemsets(spark, sf), 0.8))


@registry.add(
    "rules_filtered",
    f"{BRAND_RULES} {RULE_SQL} WHERE confidence >= 0.8 AND lift >= 1.02 AND conviction >= 1.1 AND zhangs_metric >= 0.1 AND leverage >= 0.01",
)
def _rules_filtered(spark, sf):
    found = rules.association_rules(brand_itemsets(spark, sf), 0.8)
    return shown_rules(rules.filter_rules(found, 1.02, 1.1, 0.1, 0.01))


def shown_markers(markers):
    return markers.select(listed("orthogroups").alias("orthogroups"), "num_orthogroups", *rules.METRICS)


@registry.add("rules_collapsed", f"{BRAND_RULES}, {marker_ctes('confidence >= 0.8 AND lift >= 1.02')} {MARKER_SQL} markers")
def _rules_collapsed(spark, sf):
    found = rules.association_rules(brand_itemsets(spark, sf), 0.8)
    return shown_markers(rules.collapse_rules(rules.filter_rules(found, 1.02, 0.0, -1.0)))


@registry.add(
    "rules_metric_range",
    BRAND_RULES
    + " UNION ALL ".join(
        f" SELECT '{m}' AS metric, round(min({m}), 6) AS min_value, round(max({m}), 6) AS max_value FROM rules" for m in rules.METRICS
    ),
)
def _metric_range(spark, sf):
    bounds = rules.metric_range(rules.association_rules(brand_itemsets(spark, sf), 0.0))
    return bounds.select("metric", rounded("min_value"), rounded("max_value"))


WORD_RULES = f"{ENGLISH_ITEMSETS}, {rule_ctes()}, {marker_ctes(WORD_CONDITION)}"
OTHER_RULES = (
    f"{itemset_ctes(OTHERS, 0.3, 2, 'non_')}, {rule_ctes('non_')}, "
    f"{marker_ctes('confidence >= 0.8 AND lift >= 1.0 AND conviction >= 1.0 AND zhangs_metric >= 0', 'non_')}"
)
SUBTRACTED = f"""{WORD_RULES}, {OTHER_RULES},
non_items AS (SELECT DISTINCT unnest(orthogroups) AS feature FROM non_markers),
final AS (SELECT m.* FROM markers m WHERE NOT EXISTS (SELECT 1 FROM non_items WHERE list_contains(m.orthogroups, feature)))"""


def word_markers(spark, sf):
    found = rules.association_rules(english_itemsets(spark, sf), 0.8)
    return rules.collapse_rules(rules.filter_rules(found, **WORD_THRESHOLDS))


def other_markers(spark, sf):
    others = tables.document_baskets(spark, sf).filter(F.col("label") != "en")
    return rules.marker_rules(others, 0.3, 2, 0.8, min_lift=1.0, min_conviction=1.0, min_zhang=0.0)


@registry.add("rules_words", f"{WORD_RULES} {MARKER_SQL} markers")
def _rules_words(spark, sf):
    return shown_markers(word_markers(spark, sf))


@registry.add("rules_features", f"{WORD_RULES} SELECT DISTINCT unnest(orthogroups) AS feature FROM markers")
def _rule_features(spark, sf):
    return rules.rule_features(word_markers(spark, sf))


@registry.add("rules_subtracted", f"{SUBTRACTED} {MARKER_SQL} final")
def _subtracted(spark, sf):
    return shown_markers(rules.subtract_rules(word_markers(spark, sf), other_markers(spark, sf)))


@registry.add(
    "groups_suggested",
    f"""{WORD_RULES},
    subsets AS (SELECT [x FOR x IN orthogroups IF x <> dropped] AS features
                FROM (SELECT orthogroups, unnest(orthogroups) AS dropped FROM markers WHERE num_orthogroups = 5))
    SELECT array_to_string(features, ', ') AS "group", count(*) AS co_occurance FROM subsets GROUP BY features
    ORDER BY co_occurance DESC, "group" LIMIT 500""",
)
def _groups(spark, sf):
    return rules.suggest_groups(word_markers(spark, sf), 4)


# ---- annotation -------------------------------------------------------------
# Brands as features, suppliers as samples; each cell lists the supplied parts
# as "<id>_<n> <type>" entries.


def brand_annotations(spark, sf):
    lines = tables.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = tables.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    entry = F.concat(F.lit("part_"), F.col("p_partkey"), F.lit(" "), F.col("p_type"))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("feature"), F.col("l_suppkey").cast("string").alias("sample_id"))
        .agg(F.concat_ws(annotate.SEPARATOR, F.array_sort(F.collect_list(entry))).alias("entry"))
    )


SUPPLIED = """supplied AS (
  SELECT p_brand AS feature, CAST(l_suppkey AS VARCHAR) AS sample_id, p_type AS product, l_partkey
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey)"""

VOTE = """counts AS (SELECT feature, product, count(*) AS n FROM chosen GROUP BY feature, product),
order_ AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, product) AS r, sum(n) OVER (PARTITION BY feature) AS total FROM counts)
SELECT b.feature AS "Orthogroup",
  coalesce(a.product || CASE WHEN a.n / a.total::DOUBLE < 0.8 AND a.total > 10 THEN ', ' || c.product ELSE '' END, 'no annotations') AS "Annotation(s)"
FROM (SELECT DISTINCT p_brand AS feature FROM part) b
LEFT JOIN (SELECT * FROM order_ WHERE r = 1) a ON a.feature = b.feature
LEFT JOIN (SELECT * FROM order_ WHERE r = 2) c ON c.feature = b.feature"""


def brands(spark, sf):
    return tables.table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()


@registry.add("annotation_counts", f"WITH {SUPPLIED} SELECT feature, product, count(*) AS n FROM supplied GROUP BY feature, product")
def _product_counts(spark, sf):
    return annotate.product_counts(brand_annotations(spark, sf))


@registry.add("annotation_vote", f"WITH {SUPPLIED}, chosen AS (SELECT * FROM supplied), {VOTE}")
def _vote(spark, sf):
    return annotate.vote_annotations(brand_annotations(spark, sf), brands(spark, sf))


@registry.add(
    "annotation_restricted",
    f"""WITH {SUPPLIED}, chosen AS (
      SELECT * FROM supplied WHERE sample_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)), {VOTE}""",
)
def _restricted(spark, sf):
    indebted = tables.table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0)
    chosen = annotate.restrict_annotations(
        brand_annotations(spark, sf),
        indebted.select(F.col("s_suppkey").cast("string").alias("sample_id")),
        brands(spark, sf),
    )
    return annotate.vote_annotations(chosen, brands(spark, sf))
