"""Leaf-proximity, cluster and importance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markerloom.catalog.common import BRANDS, Registry, listed, rounded
from markerloom.operators import clusters
from markerloom.operators.presence import feature_counts, vocabulary
from markerloom.session import written
from markerloom.sources import tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

# A leaf table SQL can repeat: tree t splits on brand t and then on the next
# brand, so a leaf tells which of the two a customer bought.

CANDIDATES = 16
TOI = "BUILDING"


def brand_leaves(spark, sf):
    """``sample_id, target, items, leaves`` and the labelled baskets they come from."""
    baskets = written(tables.brand_baskets(spark, sf), "baskets")
    names = vocabulary(feature_counts(baskets))
    leaf = [
        F.when(F.array_contains("items", a), 2).otherwise(0) + F.when(F.array_contains("items", b), 1).otherwise(0)
        for a, b in zip(names, names[1:] + names[:1])
    ]
    kept = baskets.select("sample_id", F.col("label").alias("target"), "items", F.array(*leaf).alias("leaves"))
    return kept, baskets


LEAVES = f"""{BRANDS},
names AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT feature FROM presence)),
leaf_rows AS MATERIALIZED (
  SELECT s.sample_id, a.tree::INTEGER AS tree,
         ((CASE WHEN pa.feature IS NULL THEN 0 ELSE 2 END) + (CASE WHEN pb.feature IS NULL THEN 0 ELSE 1 END))::INTEGER AS leaf, a.trees
  FROM samples s CROSS JOIN names a JOIN names b ON b.tree = (a.tree + 1) % a.trees
  LEFT JOIN presence pa ON pa.sample_id = s.sample_id AND pa.feature = a.feature
  LEFT JOIN presence pb ON pb.sample_id = s.sample_id AND pb.feature = b.feature),
picked AS (SELECT sample_id AS candidate_id FROM samples ORDER BY md5('42:' || sample_id), sample_id LIMIT {CANDIDATES}),
shared AS (
  SELECT r.sample_id, c.candidate_id, sum((r.leaf = q.leaf)::INT) AS shared, any_value(r.trees) AS trees
  FROM leaf_rows r CROSS JOIN picked c JOIN leaf_rows q ON q.sample_id = c.candidate_id AND q.tree = r.tree
  GROUP BY r.sample_id, c.candidate_id),
costs AS (
  SELECT a.candidate_id AS first_id, b.candidate_id AS second_id, sum(a.trees - greatest(a.shared, b.shared)) / any_value(a.trees)::DOUBLE AS cost
  FROM shared a JOIN shared b ON a.sample_id = b.sample_id AND a.candidate_id < b.candidate_id GROUP BY a.candidate_id, b.candidate_id),
m0 AS MATERIALIZED (SELECT first_id, second_id FROM costs ORDER BY round(cost, 6), first_id, second_id LIMIT 1)"""

#: Rounds written out in SQL; a pair that no round betters stays, so more change nothing.
ROUNDS = 12


def _near(medoids: str) -> str:
    """Trees in which each sample shares the leaf of either medoid."""
    return f"""(SELECT r.sample_id, any_value(r.trees) AS trees, sum((r.leaf = a.leaf)::INT) AS one, sum((r.leaf = b.leaf)::INT) AS two
  FROM {medoids} JOIN leaf_rows a ON a.sample_id = first_id JOIN leaf_rows b ON b.sample_id = second_id AND b.tree = a.tree
  JOIN leaf_rows r ON r.tree = a.tree GROUP BY r.sample_id)"""


def _round(k: int) -> str:
    """From ``m<k>`` to ``m<k + 1>``: the best member of each cluster, if that lowers the cost."""
    return f"""
a{k} AS MATERIALIZED (SELECT sample_id, CASE WHEN two > one THEN 1 ELSE 0 END AS cluster, trees - greatest(one, two) AS away FROM {_near(f"m{k}")}),
n{k} AS (SELECT cluster, tree, leaf, count(*) AS members FROM a{k} JOIN leaf_rows USING (sample_id) GROUP BY ALL),
s{k} AS (SELECT cluster, sample_id, sum(members) AS near FROM a{k} JOIN leaf_rows USING (sample_id) JOIN n{k} USING (cluster, tree, leaf) GROUP BY ALL),
b{k} AS (SELECT cluster, sample_id FROM s{k} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY near DESC, sample_id) = 1),
p{k} AS MATERIALIZED (
  SELECT coalesce((SELECT sample_id FROM b{k} WHERE cluster = 0), first_id) AS first_id,
         coalesce((SELECT sample_id FROM b{k} WHERE cluster = 1), second_id) AS second_id FROM m{k}),
t{k} AS (SELECT (SELECT sum(trees - greatest(one, two)) FROM {_near(f"p{k}")}) < (SELECT sum(away) FROM a{k}) AS lower),
m{k + 1} AS MATERIALIZED (
  SELECT CASE WHEN lower THEN p{k}.first_id ELSE m{k}.first_id END AS first_id,
         CASE WHEN lower THEN p{k}.second_id ELSE m{k}.second_id END AS second_id FROM m{k}, p{k}, t{k})"""


CANDIDATE_LEAVES = LEAVES
LEAVES = f"""{LEAVES},{",".join(map(_round, range(ROUNDS)))},
assigned AS (SELECT sample_id, CASE WHEN two > one THEN 1 ELSE 0 END AS cluster FROM {_near(f"m{ROUNDS}")}),
clustered AS (SELECT s.sample_id, s.label AS target, a.cluster FROM samples s LEFT JOIN assigned a ON a.sample_id = s.sample_id)"""


def brand_clusters(spark, sf):
    """``sample_id, target, cluster, items``: medoids from all samples, begun at the best pair of a few."""
    leaves, _ = brand_leaves(spark, sf)
    medoids = clusters.refined_medoids(leaves, clusters.choose_medoids(leaves, CANDIDATES))
    return written(clusters.assign_clusters(leaves, medoids, "target", "items"), "clustered")


@registry.add(
    "cluster_coleaf_counts",
    f"WITH {CANDIDATE_LEAVES} SELECT sample_id, candidate_id, shared::BIGINT AS shared FROM shared WHERE shared > 0",
)
def _coleaf(spark, sf):
    leaves, _ = brand_leaves(spark, sf)
    picked = clusters.leaf_rows(clusters.candidate_medoids(leaves, CANDIDATES)).withColumnRenamed("sample_id", "candidate_id")
    return clusters.co_leaf_counts(clusters.leaf_rows(leaves), picked)


@registry.add("cluster_medoid_costs", f"WITH {CANDIDATE_LEAVES} SELECT first_id, second_id, round(cost, 6) AS cost FROM costs")
def _medoid_costs(spark, sf):
    leaves, _ = brand_leaves(spark, sf)
    picked = sorted((r.sample_id, list(r.leaves)) for r in clusters.candidate_medoids(leaves, CANDIDATES).collect())
    ids = F.array(*[F.lit(sample_id) for sample_id, _ in picked])
    return clusters.pair_costs(leaves, picked).select(
        F.element_at(ids, F.col("first") + 1).alias("first_id"), F.element_at(ids, F.col("second") + 1).alias("second_id"), rounded("cost")
    )


@registry.add("cluster_labels", f"WITH {LEAVES} SELECT sample_id, target, cluster FROM clustered")
def _labels(spark, sf):
    return brand_clusters(spark, sf).select("sample_id", "target", "cluster")


@registry.add(
    "cluster_composition",
    f"""WITH {LEAVES} SELECT c.cluster, t.target, count(m.sample_id) AS size
    FROM (SELECT DISTINCT cluster FROM clustered) c CROSS JOIN (SELECT DISTINCT target FROM clustered) t
    LEFT JOIN clustered m ON m.cluster = c.cluster AND m.target = t.target GROUP BY c.cluster, t.target""",
)
def _composition(spark, sf):
    clustered = brand_clusters(spark, sf)
    targets = [row.label for row in tables.customer_samples(spark, sf).select("label").distinct().collect()]
    return clusters.composition(clustered, targets)


@registry.add("cluster_sizes", f"WITH {LEAVES} SELECT cluster, count(*) AS size FROM clustered GROUP BY cluster")
def _sizes(spark, sf):
    return clusters.cluster_sizes(brand_clusters(spark, sf))


COI = f"""{LEAVES}, coi AS (
  SELECT cluster, sum((target = '{TOI}')::INT)::BIGINT AS num_toi, count(*) AS coi_size FROM clustered GROUP BY cluster
  ORDER BY num_toi DESC, cluster DESC LIMIT 1)"""


@registry.add("cluster_of_interest", f"WITH {COI} SELECT cluster, num_toi, coi_size FROM coi")
def _coi(spark, sf):
    return clusters.cluster_of_interest(brand_clusters(spark, sf), TOI)


@registry.add(
    "cluster_slices",
    f"""WITH {COI} SELECT 'target' AS slice, c.sample_id FROM clustered c, coi WHERE c.cluster = coi.cluster AND target = '{TOI}'
    UNION ALL SELECT 'non_target', c.sample_id FROM clustered c, coi WHERE c.cluster <> coi.cluster AND target <> '{TOI}'""",
)
def _slices(spark, sf):
    clustered = brand_clusters(spark, sf)
    coi = clusters.cluster_of_interest(clustered, TOI).first().cluster
    target = clusters.target_slice(clustered, coi, TOI).select(F.lit("target").alias("slice"), "sample_id")
    return target.unionByName(clusters.non_target_slice(clustered, coi, TOI).select(F.lit("non_target").alias("slice"), "sample_id"))


FEATURES = """sizes AS (SELECT cluster, count(*) AS m FROM clustered GROUP BY cluster),
per_feature AS (SELECT f.feature, z.cluster, z.m, count(p.feature) AS k
  FROM (SELECT DISTINCT feature FROM presence) f CROSS JOIN sizes z JOIN clustered c ON c.cluster = z.cluster
  LEFT JOIN presence p ON p.sample_id = c.sample_id AND p.feature = f.feature GROUP BY f.feature, z.cluster, z.m),
background AS (SELECT feature, sum(k) AS n, sum(m) AS total FROM per_feature GROUP BY feature)"""


@registry.add(
    "cluster_chi_square",
    f"""WITH {LEAVES}, {FEATURES}, cells AS (
      SELECT p.feature, k AS seen, n * m / total::DOUBLE AS expected FROM per_feature p JOIN background b ON b.feature = p.feature
      UNION ALL SELECT p.feature, m - k, (total - n) * m / total::DOUBLE FROM per_feature p JOIN background b ON b.feature = p.feature)
    SELECT feature, round(sum((seen - expected) ** 2 / expected), 6) AS chi2 FROM cells GROUP BY feature""",
)
def _chi_square(spark, sf):
    return clusters.chi_square(brand_clusters(spark, sf)).select("feature", rounded("chi2"))


def importance_ctes(rule: str) -> str:
    return f"""{LEAVES}, {FEATURES},
draws AS (SELECT p.feature, p.cluster, p.k, p.m, n / total::DOUBLE AS share, unnest(range(0, m + 1)) AS d
          FROM per_feature p JOIN background b ON b.feature = p.feature),
mass AS (SELECT *, exp(lgamma(m + 1) - lgamma(d + 1) - lgamma(m - d + 1) + d * ln(share) + (m - d) * ln(1 - share)) AS chance FROM draws),
importance AS (SELECT feature, cluster, {rule} AS p_value FROM mass GROUP BY feature, cluster)"""


SPREAD = importance_ctes("least(1.0::DOUBLE, sum(CASE WHEN d * (m - d) < k * (m - k) THEN chance ELSE 0 END))")
MEAN = importance_ctes(
    "least(1.0::DOUBLE, 2 * least(sum(CASE WHEN d <= k THEN chance ELSE 0 END), sum(CASE WHEN d >= k THEN chance ELSE 0 END)))"
)


@registry.add("importance_spread", f"WITH {SPREAD} SELECT feature, cluster, round(p_value, 6) AS p_value FROM importance")
def _spread(spark, sf):
    return clusters.local_importance(brand_clusters(spark, sf), statistic="spread").select(
        "feature", "cluster", rounded("p_value")
    )


@registry.add("importance_mean", f"WITH {MEAN} SELECT feature, cluster, round(p_value, 6) AS p_value FROM importance")
def _mean(spark, sf):
    return clusters.local_importance(brand_clusters(spark, sf)).select("feature", "cluster", rounded("p_value"))


LOGGED = """, logged AS (SELECT feature, cluster, p_value, -ln(greatest(p_value, 0.001::DOUBLE)) AS raw FROM importance)"""


@registry.add(
    "importance_log",
    f"""WITH {MEAN}{LOGGED} SELECT feature, cluster, round(p_value, 6) AS p_value,
    round(CASE WHEN max(raw) OVER w = 0 THEN 0 ELSE raw / max(raw) OVER w END, 6) AS log_importance FROM logged WINDOW w AS (PARTITION BY cluster)""",
)
def _log(spark, sf):
    table = clusters.log_importance(clusters.local_importance(brand_clusters(spark, sf)))
    return table.select("feature", "cluster", rounded("p_value"), rounded("log_importance"))


@registry.add(
    "importance_wide",
    f"""WITH {MEAN}{LOGGED}, scaled AS (SELECT feature, cluster, CASE WHEN max(raw) OVER w = 0 THEN 0 ELSE raw / max(raw) OVER w END AS v
      FROM logged WINDOW w AS (PARTITION BY cluster))
    SELECT feature, round(max(CASE WHEN cluster = 0 THEN v END), 6) AS cluster0_importance,
      round(max(CASE WHEN cluster = 1 THEN v END), 6) AS cluster1_importance FROM scaled GROUP BY feature""",
)
def _wide(spark, sf):
    table = clusters.wide_importance(clusters.log_importance(clusters.local_importance(brand_clusters(spark, sf))))
    return table.select("feature", rounded("cluster0_importance"), rounded("cluster1_importance"))


@registry.add(
    "importance_filtered",
    f"""WITH {MEAN}, coi AS (
      SELECT cluster, sum((target = '{TOI}')::INT) AS num_toi FROM clustered GROUP BY cluster ORDER BY num_toi DESC, cluster DESC LIMIT 1)
    SELECT DISTINCT CASE WHEN i.cluster = coi.cluster THEN 'target' ELSE 'non_target' END AS slice, feature
    FROM importance i, coi WHERE p_value <= 0.01""",
)
def _filtered(spark, sf):
    clustered = brand_clusters(spark, sf)
    coi = clusters.cluster_of_interest(clustered, TOI).first().cluster
    table = clusters.local_importance(clustered)
    target = clusters.important_features(table, coi, 0.01).select(F.lit("target").alias("slice"), "feature")
    other = clusters.important_features(table, coi, 0.01, target=False)
    return target.unionByName(other.select(F.lit("non_target").alias("slice"), "feature"))


@registry.add(
    "cluster_transactions",
    f"""WITH {COI} SELECT c.sample_id, coalesce(string_agg(p.feature, ',' ORDER BY p.feature), '') AS items
    FROM clustered c JOIN coi ON c.cluster = coi.cluster AND c.target = '{TOI}' LEFT JOIN presence p ON p.sample_id = c.sample_id
    GROUP BY c.sample_id""",
)
def _transactions(spark, sf):
    clustered = brand_clusters(spark, sf)
    coi = clusters.cluster_of_interest(clustered, TOI).first().cluster
    return clusters.target_slice(clustered, coi, TOI).select("sample_id", listed("items").alias("items"))
