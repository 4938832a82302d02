import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from markerloom.operators import annotate, clusters, presence


@pytest.fixture(scope="module")
def leaf_data():
    rng = random.Random(4)
    return {f"s{i:02}": [rng.randrange(3) if i % 2 else rng.randrange(2) + 2 for _ in range(12)] for i in range(40)}


@pytest.fixture
def leaves(spark, leaf_data):
    return spark.createDataFrame(list(leaf_data.items()), "sample_id string, leaves array<int>")


def shared(a, b):
    return sum(x == y for x, y in zip(a, b))


def test_medoids_are_the_exact_best_pair(leaves, leaf_data):
    got = clusters.choose_medoids(leaves, 64)
    cost = {
        (a, b): sum(12 - max(shared(v, leaf_data[a]), shared(v, leaf_data[b])) for v in leaf_data.values())
        for a, b in combinations(sorted(leaf_data), 2)
    }
    assert cost[got[0][0], got[1][0]] == min(cost.values())


def test_refined_medoids_are_the_best_of_their_clusters(leaves, leaf_data):
    start = clusters.choose_medoids(leaves, 4)
    got = clusters.refined_medoids(leaves, start)
    assert clusters._cost(leaves, got) <= clusters._cost(leaves, start)
    near = {n: int(shared(v, got[1][1]) > shared(v, got[0][1])) for n, v in leaf_data.items()}
    sums = {n: sum(shared(v, leaf_data[m]) for m in leaf_data if near[m] == near[n]) for n, v in leaf_data.items()}
    best = [min((n for n in leaf_data if near[n] == c), key=lambda n: (-sums[n], n)) for c in (0, 1)]
    assert clusters.best_members(leaves, got) == [(n, leaf_data[n]) for n in best]
    assert clusters._cost(leaves, [(n, leaf_data[n]) for n in best]) >= clusters._cost(leaves, got)


def test_assignment_and_pair_counts_agree(leaves, leaf_data):
    medoids = clusters.choose_medoids(leaves, 16)
    got = {r.sample_id: r.cluster for r in clusters.assign_clusters(leaves, medoids).collect()}
    for name, leaf in leaf_data.items():
        assert got[name] == int(shared(leaf, medoids[1][1]) > shared(leaf, medoids[0][1]))
    picked = clusters.leaf_rows(clusters.candidate_medoids(leaves, 5)).withColumnRenamed("sample_id", "candidate_id")
    for r in clusters.co_leaf_counts(clusters.leaf_rows(leaves), picked).collect():
        assert r.shared == shared(leaf_data[r.sample_id], leaf_data[r.candidate_id])


def clustered_table(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        c = int(i % 3 == 0)
        items = [f for f, p in (("mark", 0.9 if c else 0.1), ("noise", 0.5), ("everywhere", 1.0)) if rng.random() < p]
        rows.append((f"s{i}", "toi" if c else "rest", c, items))
    return spark.createDataFrame(rows, "sample_id string, target string, cluster int, items array<string>")


def test_chi_square_matches_spark_ml(spark):
    table = clustered_table(spark)
    mine = {r.feature: r.chi2 for r in clusters.chi_square(table).collect()}
    vectors = presence.encode_items(table, ["mark", "noise"])
    for r in clusters.chi_square_p(vectors, ["mark", "noise"]).collect():
        assert mine[r.feature] == pytest.approx(r.chi2)
    assert mine["everywhere"] is None


@pytest.mark.parametrize("statistic", ["spread", "mean"])
def test_local_importance_finds_the_mark(spark, statistic):
    table = clusters.log_importance(clusters.local_importance(clustered_table(spark), statistic=statistic))
    got = {(r.feature, r.cluster): r for r in table.collect()}
    assert got["mark", 1].p_value < 0.001 < got["noise", 1].p_value
    assert got["mark", 1].log_importance == 1.0
    chosen = [r.feature for r in clusters.important_features(table, 1).collect()]
    assert chosen == ["mark"]
    wide = clusters.wide_importance(table)
    assert wide.columns == ["feature", "cluster0_importance", "cluster1_importance"] and wide.count() == 3


def test_cluster_of_interest_ties_go_to_the_larger(spark):
    df = spark.createDataFrame([("a", "t", 0), ("b", "t", 1), ("c", "u", 0)], "sample_id string, target string, cluster int")
    row = clusters.cluster_of_interest(df, "t").first()
    assert (row.cluster, row.num_toi, row.coi_size) == (1, 1, 1)
    cells = {(r.cluster, r.target): r["size"] for r in clusters.composition(df, ["t", "u"]).collect()}
    assert cells == {(0, "t"): 1, (0, "u"): 1, (1, "t"): 1, (1, "u"): 0}
    assert clusters.target_slice(df, 1, "t").count() == 1 and clusters.non_target_slice(df, 1, "t").count() == 1


def test_annotation_vote(spark):
    wide = spark.createDataFrame(
        [
            ("f", "g_1 kinase, g_2 kinase", "g_3 ligase", "g_9 other"),
            ("g", ", ".join(f"g_{i} pump" for i in range(7)), ", ".join(f"g_{i} pore" for i in range(5)), None),
            ("h", None, None, "g_4 toxin"),
        ],
        "Orthogroup string, s1 string, s2 string, s3 string",
    )
    long = annotate.unpivot_annotation(wide, "Orthogroup", ["s1", "s2", "s3"])
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    features = spark.createDataFrame([("f",), ("g",), ("h",)], "feature string")
    chosen = annotate.restrict_annotations(long, samples, features)
    got = {r.Orthogroup: r["Annotation(s)"] for r in annotate.vote_annotations(chosen, features).collect()}
    # f: clear by few entries; g: 7 of 12 is unclear; h: nothing in the chosen samples.
    assert got == {"f": "kinase", "g": "pump, pore", "h": "no annotations"}
