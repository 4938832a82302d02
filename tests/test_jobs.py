import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from markerloom.operators import forest
from markerloom.plans import find_markers, resume_from_rules
from markerloom.plans.forest_markers import find_markers_in_tsv
from markerloom.sources import results, tsv

LOOSE = {"min_support": 0.5, "min_lift": 1.3}
QUICK = {"seeds": (0, 0), "trees": 30, "max_depth": 8}


def planted_rows(shuffled=False):
    """200 samples, 3 labels, 40 noise features, 5 tags of the target, and 3
    features that co-occur in two thirds of the target's samples only."""
    rng = random.Random(11)
    labels = ["level_1", "level_2", "level_2", "level_3"] * 50
    rows = []
    for i, label in enumerate(labels):
        items = [f"OG{j:03}" for j in range(40) if rng.random() < 0.3]
        inside = label == "level_2"
        items += [f"OGtag_{j}" for j in range(5) if rng.random() < (0.95 if inside else 0.05)]
        if rng.random() < (0.66 if inside else 0.03):
            items += [name for name in ("OGmark_a", "OGmark_b", "OGmark_c") if rng.random() < 0.98]
        rows.append([f"s{i:03}", label, items])
    if shuffled:
        mixed = [r[1] for r in rows]
        rng.shuffle(mixed)
        for row, label in zip(rows, mixed):
            row[1] = label
    return [tuple(r) for r in rows]


SCHEMA = "sample_id string, label string, items array<string>"


@pytest.fixture(scope="module")
def found(spark):
    return find_markers(spark.createDataFrame(planted_rows(), SCHEMA), "level_2", max_biomk=2, **LOOSE, **QUICK)


def test_planted_group_comes_out(found):
    groups = {tuple(r.orthogroups) for r in found.markers.collect()}
    assert any(set(g) <= {"OGmark_a", "OGmark_b", "OGmark_c"} and len(g) >= 2 for g in groups)
    assert all("mark" in r.feature or "tag" in r.feature for r in found.features.collect())
    params = {r.key: r.value for r in found.params.collect()}
    assert params["toi"] == "level_2" and int(params["num_toi"]) > 50 and params["min_thresh"] == "10"
    assert found.clusters.count() == 200
    top = [r.feature for r in found.forest_importance.limit(3).collect()]
    assert all(name.startswith("OGtag") for name in top)


def test_planted_group_passes_the_default_rule_thresholds(spark):
    from markerloom.operators import rules

    rng = random.Random(3)
    group = ["OGa", "OGb", "OGc"]
    rows = [(f"s{i}", "x", (group if i % 100 < 63 else []) + [f"n{j}" for j in range(20) if rng.random() < 0.5]) for i in range(200)]
    table = rules.marker_rules(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r.orthogroups) for r in table.collect()} == {("OGa", "OGb"), ("OGa", "OGc"), ("OGb", "OGc"), ("OGa", "OGb", "OGc")}


def test_shuffled_labels_give_no_rules_at_default_thresholds(spark):
    out = find_markers(spark.createDataFrame(planted_rows(True), SCHEMA), "level_2", **QUICK)
    assert out.groups.isEmpty()


def test_saved_tables_resume(found, spark, tmp_path):
    out = str(tmp_path / "out")
    found.save(out)
    with pytest.raises(AnalysisException):
        found.save(out)
    found.save(out, force=True)
    again = resume_from_rules(
        results.load_table(spark, f"{out}/Target_FPG_rules"), results.load_table(spark, f"{out}/nonTarget_FPG_rules"), max_biomk=2
    )
    assert again.markers.exceptAll(found.markers).isEmpty() and found.markers.exceptAll(again.markers).isEmpty()
    text = str(tmp_path / "text")
    found.save(text, as_tsv=True)
    imported = tsv.import_rules(spark, f"{text}/Target_FPG_rules")
    assert imported.select("orthogroups").exceptAll(found.target_rules.select("orthogroups")).isEmpty()
    assert imported.count() == found.target_rules.count()
    with pytest.raises(ValueError, match="columns not found"):
        tsv.import_rules(spark, f"{text}/RF_clusters")


def test_saved_forest_and_itemsets_resume(found, spark, tmp_path):
    path = str(tmp_path / "forest")
    forest.save_forest(found.forest, path, found.vocabulary, found.classes)
    with pytest.raises(Exception):
        forest.save_forest(found.forest, path, found.vocabulary, found.classes)
    again = find_markers(
        spark.createDataFrame(planted_rows(), SCHEMA),
        "level_2",
        saved_forest=path,
        saved_itemsets=(found.target_itemsets, found.non_target_itemsets),
        max_biomk=2,
        **LOOSE,
    )
    assert again.clusters.exceptAll(found.clusters).isEmpty()
    assert again.markers.exceptAll(found.markers).isEmpty()
    assert again.medoids.collect() == found.medoids.collect()


def test_saved_clusters_resume(found, spark, tmp_path):
    path = str(tmp_path / "forest")
    forest.save_forest(found.forest, path, found.vocabulary, found.classes)
    table = spark.createDataFrame(planted_rows(), SCHEMA)
    # The label itself as a saved clustering.
    saved = table.selectExpr("sample_id", "cast(label = 'level_2' as int) as cluster")
    again = find_markers(table, "level_2", saved_forest=path, saved_clusters=saved, max_biomk=2, **LOOSE)
    cells = {(r.cluster, r.target): r["size"] for r in again.composition.collect()}
    assert cells[1, "level_2"] == 100 and cells[0, "level_2"] == 0
    assert again.medoids is None and not again.markers.isEmpty()
    assert {r["slice"] for r in again.metric_range.collect()} == {"target", "non_target"}
    top = again.global_association.orderBy(F.desc("chi2")).first()
    assert top.feature.startswith("OGtag")


def test_wide_tsv_with_annotation(spark, tmp_path):
    names = sorted({i for _, _, items in planted_rows() for i in items})
    table = tmp_path / "wide.tsv"
    lines = ["\t".join(["sample", *names, "target"])]
    for sample, label, items in planted_rows():
        lines.append("\t".join([sample, *["1" if n in items else "0" for n in names], label]))
    table.write_text("\n".join(lines) + "\n")
    notes = tmp_path / "notes.tsv"
    samples = [r[0] for r in planted_rows()]
    notes.write_text(
        "\t".join(["Orthogroup", *samples]) + "\n" + "\n".join("\t".join([n, *[f"x_1 protein {n}"] * len(samples)]) for n in names) + "\n"
    )
    out = find_markers_in_tsv(
        spark, str(table), "sample", "target", "level_2", annotation_path=str(notes), remove=["OG000"],
        max_biomk=2, out=str(tmp_path / "run"), **LOOSE, **QUICK,
    )
    got = {r.Orthogroup: r["Annotation(s)"] for r in out.annotations.collect()}
    assert got and all(v == f"protein {k}" for k, v in got.items())
    assert results.load_table(spark, str(tmp_path / "run" / "filtered_rules")).count() == out.markers.count()
    with pytest.raises(FileExistsError):
        find_markers_in_tsv(spark, str(table), "sample", "target", "level_2", out=str(tmp_path / "run"))
    with pytest.raises(ValueError, match="not one of the labels"):
        find_markers_in_tsv(spark, str(table), "sample", "target", "level_9")


def test_seed_search_scores_every_pair(spark):
    rows = planted_rows()[:80]
    from markerloom.operators import presence

    table = spark.createDataFrame(rows, SCHEMA)
    vectors = presence.encode_items(presence.binary_target(table, "level_2"), ["OGmark_a", "OGmark_b", "OG001"])
    vectors = vectors.select("sample_id", "features", F.col("y").cast("double").alias("encoded_class"))
    scores = forest.seed_scores(vectors, range(2), (0, 1), trees=5, max_depth=3)
    assert scores.count() == 4 and set(forest.best_seeds(scores)) <= {0, 1}


def test_forest_splits_on_rare_features(spark):
    """Features of five rows each in more rows than a split sample would hold."""
    import pyspark.sql.functions as F
    from pyspark.ml.linalg import SparseVector

    rows = [(f"s{i:06}", SparseVector(6, {i // 5: 1.0} if i < 30 else {}), 1.0 if i < 30 else 0.0) for i in range(15_000)]
    table = spark.createDataFrame(rows, ["sample_id", "features", "encoded_class"]).repartition(4, "sample_id")
    model = forest.fit_forest(table, 1, trees=60, max_depth=12)
    used = model.featureImportances.toArray()
    assert (used > 0).all()
    assert forest.predict(model, table).filter((F.col("y_true") == 1) & (F.col("y_pred") == 1)).count() == 30
