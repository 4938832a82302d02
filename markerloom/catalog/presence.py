"""Presence, label and outcome queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from markerloom.catalog.common import BRANDS, WORDS, Registry, listed, rounded
from markerloom.functions.cells import to01
from markerloom.operators import checks, folds, outcomes, presence
from markerloom.sources import tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

# Orders as a raw wide table: text cells of every kind the cleaner meets.
RAW_FEATURES = ("OG_status", "OG_price", "OG_priority", "OG_late", "OG_size")


def raw_cells(spark, sf):
    price = F.col("o_totalprice")
    return tables.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample"),
        F.col("o_orderpriority").alias("target"),
        F.col("o_orderstatus").alias("OG_status"),
        F.when(price > 100000, "TRUE").otherwise("false").alias("OG_price"),
        F.substring("o_orderpriority", 1, 1).alias("OG_priority"),
        F.when(F.year("o_orderdate") >= 1995, "T").alias("OG_late"),
        F.when(price > 200000, "1.0").otherwise("True").alias("OG_size"),
    )


RAW = """
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample, o_orderpriority AS target, o_orderstatus AS OG_status,
         CASE WHEN o_totalprice > 100000 THEN 'TRUE' ELSE 'false' END AS OG_price,
         o_orderpriority[1:1] AS OG_priority,
         CASE WHEN year(o_orderdate) >= 1995 THEN 'T' END AS OG_late,
         CASE WHEN o_totalprice > 200000 THEN '1.0' ELSE 'True' END AS OG_size
  FROM orders),
cells AS (
  SELECT sample AS sample_id, 'OG_status' AS feature, OG_status AS value FROM raw UNION ALL
  SELECT sample, 'OG_price', OG_price FROM raw UNION ALL
  SELECT sample, 'OG_priority', OG_priority FROM raw UNION ALL
  SELECT sample, 'OG_late', OG_late FROM raw UNION ALL
  SELECT sample, 'OG_size', OG_size FROM raw)
"""

IS_ONE = "value IN ('1', 'TRUE', 'T', 'True', 'true')"


@registry.add("presence_unpivot", f"WITH {RAW} SELECT sample_id, feature, value FROM cells")
def _unpivot(spark, sf):
    return presence.unpivot_cells(raw_cells(spark, sf), "sample", RAW_FEATURES)


@registry.add(
    "presence_clean01",
    f"WITH {RAW} SELECT sample_id, feature, CASE WHEN {IS_ONE} THEN 1 ELSE 0 END AS value FROM cells",
)
def _clean(spark, sf):
    cells = presence.unpivot_cells(raw_cells(spark, sf), "sample", RAW_FEATURES)
    return cells.withColumn("value", to01(F.col("value")))


@registry.add(
    "presence_from_wide",
    f"""WITH {RAW}
    SELECT r.sample AS sample_id, r.target AS label,
           coalesce(string_agg(c.feature, ',' ORDER BY c.feature), '') AS items
    FROM raw r LEFT JOIN (SELECT * FROM cells WHERE {IS_ONE}) c ON r.sample = c.sample_id
    GROUP BY r.sample, r.target""",
)
def _from_wide(spark, sf):
    baskets = presence.baskets_from_wide(raw_cells(spark, sf), "sample", RAW_FEATURES, "target")
    return baskets.select("sample_id", "label", listed(F.array_sort("items")).alias("items"))


@registry.add("presence_long", f"WITH {WORDS} SELECT sample_id, feature FROM presence")
def _long(spark, sf):
    return presence.to_long(tables.document_baskets(spark, sf))


@registry.add(
    "presence_transactions",
    f"""WITH {BRANDS}
    SELECT s.sample_id, s.label, coalesce(string_agg(p.feature, ',' ORDER BY p.feature), '') AS items
    FROM samples s LEFT JOIN presence p ON s.sample_id = p.sample_id GROUP BY s.sample_id, s.label""",
)
def _transactions(spark, sf):
    return tables.brand_baskets(spark, sf).select("sample_id", "label", listed("items").alias("items"))


@registry.add("presence_prevalence", f"WITH {WORDS} SELECT feature, count(*) AS n FROM presence GROUP BY feature")
def _prevalence(spark, sf):
    return presence.feature_counts(tables.document_baskets(spark, sf))


PRUNED = """
bounds AS (SELECT round_even(count(*) * 0.05::DOUBLE, 0) AS low, round_even(count(*) * 0.95::DOUBLE, 0) AS high FROM samples),
sets AS (SELECT feature, count(*) AS n, md5(string_agg(sample_id, ',' ORDER BY sample_id)) AS members
         FROM presence GROUP BY feature),
kept AS (SELECT min(feature) AS feature, n FROM sets, bounds WHERE n BETWEEN low AND high GROUP BY members, n)
"""


@registry.add("presence_pruned", f"WITH {WORDS}, {PRUNED} SELECT feature, n FROM kept")
def _pruned(spark, sf):
    return presence.prune_features(tables.document_baskets(spark, sf))


def doubled_brands(spark, sf):
    """Every brand twice under two names, so that duplicates exist."""
    baskets = tables.brand_baskets(spark, sf)
    alias = F.transform("items", lambda item: F.concat(F.lit("alias of "), item))
    return baskets.withColumn("items", F.concat("items", alias))


@registry.add(
    "presence_dedup",
    f"""WITH {BRANDS},
    doubled AS (SELECT * FROM presence UNION ALL SELECT sample_id, 'alias of ' || feature FROM presence),
    sets AS (SELECT feature, count(*) AS n, md5(string_agg(sample_id, ',' ORDER BY sample_id)) AS members
             FROM doubled GROUP BY feature)
    SELECT min(feature) AS feature, n FROM sets GROUP BY members, n""",
)
def _dedup(spark, sf):
    return presence.drop_duplicate_features(presence.feature_profile(doubled_brands(spark, sf)))


COUNTED = f"WITH {WORDS}, counted AS (SELECT feature, count(*) AS n FROM presence GROUP BY feature)"


@registry.add("presence_selected", f"{COUNTED} SELECT feature, n FROM counted WHERE feature IN ('the', 'und', 'que', 'les', 'absent')")
def _selected(spark, sf):
    counts = presence.feature_counts(tables.document_baskets(spark, sf))
    return presence.select_features(counts, include=["the", "und", "que", "les", "absent"])


@registry.add("presence_excluded", f"{COUNTED} SELECT feature, n FROM counted WHERE feature NOT IN ('the', 'und')")
def _excluded(spark, sf):
    return presence.select_features(presence.feature_counts(tables.document_baskets(spark, sf)), exclude=["the", "und"])


@registry.add("presence_prefixed", f"{COUNTED} SELECT feature, n FROM counted WHERE starts_with(feature, 'th')")
def _prefixed(spark, sf):
    return presence.select_features(presence.feature_counts(tables.document_baskets(spark, sf)), prefix="th")


@registry.add(
    "presence_restricted",
    f"""WITH {WORDS}, {PRUNED}
    SELECT s.sample_id, count(k.feature) AS n_kept, coalesce(md5(string_agg(k.feature, ',' ORDER BY k.feature)), md5('')) AS kept_md5
    FROM samples s LEFT JOIN presence p ON s.sample_id = p.sample_id LEFT JOIN kept k ON p.feature = k.feature
    GROUP BY s.sample_id""",
)
def _restricted(spark, sf):
    baskets = tables.document_baskets(spark, sf)
    kept = presence.restrict_items(baskets, presence.vocabulary(presence.prune_features(baskets)))
    return kept.select(
        "sample_id", F.size("items").cast("bigint").alias("n_kept"), F.md5(listed(F.array_sort("items"))).alias("kept_md5")
    )


@registry.add(
    "presence_zero_filled",
    f"""WITH {BRANDS}, features AS (SELECT DISTINCT feature FROM presence)
    SELECT s.sample_id, f.feature, CASE WHEN p.feature IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
    FROM samples s CROSS JOIN features f
    LEFT JOIN presence p ON p.sample_id = s.sample_id AND p.feature = f.feature""",
)
def _zero_filled(spark, sf):
    baskets = tables.brand_baskets(spark, sf)
    vocab = presence.vocabulary(presence.feature_counts(baskets))
    names = presence.names_literal(vocab)
    vectors = presence.encode_items(baskets, vocab)
    return vectors.select("sample_id", F.posexplode(vector_to_array("features")).alias("code", "value")).select(
        "sample_id", F.element_at(names, F.col("code") + 1).alias("feature"), "value"
    )


@registry.add(
    "standardised_features",
    f"""WITH {WORDS}, n AS (SELECT count(*)::DOUBLE AS total FROM samples),
    c AS (SELECT feature, count(*) AS n FROM presence GROUP BY feature)
    SELECT feature, round(c.n / total, 6) AS mean, round(sqrt(c.n / total * (1 - c.n / total)), 6) AS sd FROM c, n""",
)
def _standardised(spark, sf):
    baskets = tables.document_baskets(spark, sf)
    return outcomes.standardisation(presence.feature_counts(baskets), baskets.count()).select(
        "feature", rounded("mean"), rounded("sd")
    )


@registry.add(
    "standardised_cells",
    f"""WITH {BRANDS}, n AS (SELECT count(*)::DOUBLE AS total FROM samples),
    c AS (SELECT feature, count(*) / total AS mean, sqrt(count(*) / total * (1 - count(*) / total)) AS sd
          FROM presence, n GROUP BY feature, total)
    SELECT s.sample_id, c.feature,
           round(CASE WHEN sd = 0 THEN 0 ELSE ((CASE WHEN p.feature IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE - mean) / sd END, 6) AS z
    FROM samples s CROSS JOIN c LEFT JOIN presence p ON p.sample_id = s.sample_id AND p.feature = c.feature""",
)
def _standardised_cells(spark, sf):
    baskets = tables.brand_baskets(spark, sf)
    stats = outcomes.standardisation(presence.feature_counts(baskets), baskets.count())
    cells = _zero_filled(spark, sf).join(stats, "feature")
    return cells.select("sample_id", "feature", rounded(outcomes.z_score(F.col("value"), F.col("mean"), F.col("sd")), "z"))


@registry.add(
    "feature_half",
    f"""WITH {WORDS}, f AS (SELECT DISTINCT feature FROM presence),
    r AS (SELECT feature, row_number() OVER (ORDER BY md5('42:' || feature), feature) AS rank, count(*) OVER () AS n FROM f)
    SELECT feature FROM r WHERE rank <= round_even(n * 0.5::DOUBLE, 0)""",
)
def _half(spark, sf):
    return folds.feature_half(presence.feature_counts(tables.document_baskets(spark, sf)))


# ---- labels -----------------------------------------------------------------

CUSTOMERS = "samples AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS label FROM customer)"


@registry.add("labels_dropped", f"WITH {CUSTOMERS} SELECT * FROM samples WHERE label NOT IN ('MACHINERY', 'FURNITURE')")
def _dropped(spark, sf):
    return presence.drop_labels(tables.customer_samples(spark, sf), ["MACHINERY", "FURNITURE"])


@registry.add("labels_kept", f"WITH {CUSTOMERS} SELECT * FROM samples WHERE label IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD')")
def _kept(spark, sf):
    return presence.keep_labels(tables.customer_samples(spark, sf), ["BUILDING", "AUTOMOBILE", "HOUSEHOLD"])


@registry.add("labels_binary", f"WITH {CUSTOMERS} SELECT *, CASE WHEN label = 'BUILDING' THEN 1 ELSE 0 END AS y FROM samples")
def _binary(spark, sf):
    return presence.binary_target(tables.customer_samples(spark, sf), "BUILDING")


CODES = "codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS encoded_class FROM (SELECT DISTINCT label FROM samples))"


@registry.add("labels_map", f"WITH {CUSTOMERS}, {CODES} SELECT encoded_class, label FROM codes")
def _map(spark, sf):
    return presence.label_codes(tables.customer_samples(spark, sf))


@registry.add("labels_encoded", f"WITH {CUSTOMERS}, {CODES} SELECT label, sample_id, encoded_class FROM samples JOIN codes USING (label)")
def _encoded(spark, sf):
    return presence.encode_labels(tables.customer_samples(spark, sf))


@registry.add("labels_counts", f"WITH {CUSTOMERS} SELECT label, count(*) AS n FROM samples GROUP BY label")
def _counts(spark, sf):
    return presence.class_counts(tables.customer_samples(spark, sf))


@registry.add(
    "labels_guard",
    f"""WITH {CUSTOMERS}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY label),
    s AS (SELECT CAST(sum(CASE WHEN label = 'BUILDING' THEN n ELSE 0 END) AS BIGINT) AS positives,
                 CAST(sum(CASE WHEN label = 'BUILDING' THEN 0 ELSE n END) AS BIGINT) AS negatives, count(*) AS n_classes FROM c)
    SELECT *, positives >= 5 AND negatives >= 5 AS binary_ok, n_classes >= 3 AS multiclass_ok FROM s""",
)
def _guard(spark, sf):
    return checks.guard_counts(tables.customer_samples(spark, sf), "BUILDING")


# ---- outcomes ---------------------------------------------------------------


@registry.add(
    "outcome_joined",
    f"""WITH {BRANDS}
    SELECT s.sample_id, count(p.feature) AS n_items, round(c_acctbal, 2) AS outcome
    FROM samples s JOIN customer ON s.sample_id = CAST(c_custkey AS VARCHAR)
    LEFT JOIN presence p ON p.sample_id = s.sample_id GROUP BY s.sample_id, c_acctbal""",
)
def _joined(spark, sf):
    joined = outcomes.join_outcome(tables.brand_baskets(spark, sf), tables.balances(spark, sf), "sample", "balance")
    return joined.select("sample_id", F.size("items").cast("bigint").alias("n_items"), rounded("outcome", digits=2))


@registry.add(
    "outcome_numeric",
    """SELECT o_orderkey, round(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS DOUBLE), 2) AS outcome
    FROM orders""",
)
def _numeric(spark, sf):
    orders = tables.table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).otherwise(F.col("o_orderpriority"))
    return orders.select("o_orderkey", rounded(outcomes.numeric(text), "outcome", 2))


@registry.add(
    "outcome_log1p",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END AS outcome
    FROM customer""",
)
def _log1p(spark, sf):
    joined = outcomes.join_outcome(
        tables.customer_samples(spark, sf), tables.balances(spark, sf), "sample", "balance", log1p=True
    )
    return joined.select("sample_id", rounded("outcome"))
