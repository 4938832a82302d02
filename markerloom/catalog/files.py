"""Source and sink queries: tables written as TSV in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markerloom.catalog.common import BRANDS, Registry, listed, rounded
from markerloom.catalog.mining import (
    BRAND_ITEMSETS,
    BRAND_RULES,
    ITEMSET_SQL,
    MARKER_SQL,
    SUPPLIED,
    brand_annotations,
    brand_itemsets,
    marker_ctes,
    shown_itemsets,
    shown_markers,
)
from markerloom.catalog.presence import IS_ONE, RAW, raw_cells
from markerloom.operators import outcomes, rules
from markerloom.session import scratch_path
from markerloom.sources import results, tables, tsv

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles


@registry.add(
    "file_presence",
    f"""WITH {RAW}
    SELECT r.sample AS sample_id, r.target AS label,
           coalesce(string_agg(c.feature, ',' ORDER BY c.feature), '') AS items
    FROM raw r LEFT JOIN (SELECT * FROM cells WHERE {IS_ONE}) c ON r.sample = c.sample_id
    GROUP BY r.sample, r.target""",
)
def _presence(spark, sf):
    path = scratch_path(spark, "presence_tsv")
    results.export_tsv(raw_cells(spark, sf), path)
    baskets, _ = tsv.read_presence(spark, path, "sample", "target", prefix=tsv.FEATURE_PREFIX)
    return baskets.select("sample_id", "label", listed(F.array_sort("items")).alias("items"))


@registry.add(
    "file_meta",
    f"""WITH {BRANDS}
    SELECT s.sample_id, count(p.feature) AS n_items, round(c_acctbal, 2) AS outcome
    FROM samples s JOIN customer ON s.sample_id = CAST(c_custkey AS VARCHAR)
    LEFT JOIN presence p ON p.sample_id = s.sample_id GROUP BY s.sample_id, c_acctbal""",
)
def _meta(spark, sf):
    path = scratch_path(spark, "meta_tsv")
    results.export_tsv(tables.balances(spark, sf), path)
    joined = outcomes.join_outcome(tables.brand_baskets(spark, sf), tsv.read_tsv(spark, path), "sample", "balance")
    return joined.select("sample_id", F.size("items").cast("bigint").alias("n_items"), rounded("outcome", digits=2))


@registry.add(
    "file_annotation",
    f"""WITH {SUPPLIED} SELECT feature, sample_id,
    string_agg('part_' || l_partkey || ' ' || product, ', ' ORDER BY 'part_' || l_partkey || ' ' || product) AS entry
    FROM supplied GROUP BY feature, sample_id""",
)
def _annotation(spark, sf):
    path = scratch_path(spark, "annotation_tsv")
    suppliers = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("s")).distinct().dropna()
    names = sorted(row.s for row in suppliers.collect())
    results.export_wide_tsv(brand_annotations(spark, sf), path, "feature", "sample_id", "entry", names, tsv.ANNOTATED_FEATURE)
    return tsv.read_annotation(spark, path)


@registry.add("file_itemsets", f"{BRAND_ITEMSETS} {ITEMSET_SQL}")
def _itemsets(spark, sf):
    path = scratch_path(spark, "patterns_tsv")
    found = brand_itemsets(spark, sf)
    results.export_tsv(found.select("support", F.col("itemset").alias("itemsets")), path, list_text=True)
    return shown_itemsets(tsv.import_itemsets(spark, path, tables.customer_samples(spark, sf).count()))


@registry.add("file_rules", f"{BRAND_RULES}, {marker_ctes('confidence >= 0.8 AND lift >= 1.02')} {MARKER_SQL} markers")
def _rules(spark, sf):
    path = scratch_path(spark, "rules_tsv")
    found = rules.association_rules(brand_itemsets(spark, sf), 0.8)
    results.export_tsv(rules.collapse_rules(rules.filter_rules(found, 1.02, 0.0, -1.0)), path, list_text=True)
    return shown_markers(tsv.import_rules(spark, path))
