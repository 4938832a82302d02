import pytest
from pyspark.sql import functions as F

from markerloom.catalog import files
from markerloom.functions import round_even, to01
from markerloom.operators import checks, presence
from markerloom.sources import results, tsv


def test_tokens(spark):
    texts = ["1", "TRUE", "T", "True", "true", "0", "FALSE", "F", "False", "false", None, "1.0", "x", " 1"]
    df = spark.createDataFrame([(t,) for t in texts], "cell string")
    assert [r[0] for r in df.select(to01(F.col("cell"))).collect()] == [1] * 5 + [0] * 9


def test_missing_cell_does_not_empty_its_column(spark):
    wide = spark.createDataFrame([("a", "1"), ("b", None), ("c", "0")], "sample string, OG1 string")
    got = presence.baskets_from_wide(wide, "sample", ["OG1"])
    assert {r.sample_id: r["items"] for r in got.collect()} == {"a": ["OG1"], "b": [], "c": []}


def test_dropping_a_class_does_not_shift_values(spark):
    wide = spark.createDataFrame(
        [("s1", "low", "0"), ("s2", "mid", "0"), ("s3", "low", "1"), ("s4", "high", "1")],
        "sample string, target string, OG1 string",
    )
    kept = presence.drop_labels(presence.baskets_from_wide(wide, "sample", ["OG1"], "target"), ["mid"])
    assert {r.sample_id: len(r["items"]) for r in kept.collect()} == {"s1": 0, "s3": 1, "s4": 1}


def test_empty_samples_stay(spark):
    samples = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, label string")
    long = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "e")], "sample_id string, feature string")
    got = {r.sample_id: r["items"] for r in presence.baskets_from_long(samples, long).collect()}
    assert got == {"a": ["e", "f"], "b": []}


@pytest.fixture
def pruned_table(baskets):
    rows = {}
    for i in range(20):
        items = ["all"]
        if i < 6:
            items += ["twin_b", "twin_a"]
        if i < 2:
            items.append("min")
        if i == 19:
            items.append("one")
        rows[(f"s{i:02}", "x")] = items
    return baskets(rows)


def test_prune_keeps_inclusive_bounds_and_first_twin(pruned_table, spark):
    kept = {r.feature: r.n for r in presence.prune_features(pruned_table, 2, 19).collect()}
    assert kept == {"twin_a": 6, "min": 2}
    order = tsv.catalogue(spark, ["twin_b", "twin_a", "min", "one", "all"])
    kept = {r.feature for r in presence.prune_features(pruned_table, 2, 19, order).collect()}
    assert kept == {"twin_b", "min"}


def test_zero_bound_is_honoured(pruned_table, spark):
    order = tsv.catalogue(spark, ["one", "never", "never_too"])
    kept = {r.feature: r.n for r in presence.prune_features(pruned_table, 0, 20, order).collect()}
    assert kept == {"one": 1, "never": 0}
    assert presence.default_bounds(50) == (2, 48)  # 2.5 and 47.5 round to even
    assert presence.default_bounds(50, 0, 0) == (0, 0)


def test_restrict_and_encode(pruned_table):
    got = presence.restrict_items(pruned_table, ["twin_a", "min"])
    assert {r.sample_id: sorted(r["items"]) for r in got.collect()}["s00"] == ["min", "twin_a"]
    sizes = {r.sample_id: r.v.size for r in presence.encode_items(pruned_table, ["min", "twin_a"], "v").collect()}
    assert set(sizes.values()) == {2}


def test_round_even_and_infinity(spark):
    row = spark.range(1).select(
        round_even(F.lit(0.00025), 4).alias("a"), round_even(F.lit(float("inf")), 4).alias("b")
    ).first()
    assert row.a == pytest.approx(0.0002) and row.b == float("inf")


def test_guards(baskets):
    few = baskets({(f"s{i}", "a" if i < 4 else "b"): [] for i in range(12)})
    with pytest.raises(ValueError, match="4 samples and all other labels 8"):
        checks.require_binary(few, "a")
    with pytest.raises(ValueError, match="3 labels or more"):
        checks.require_multiclass(checks.class_sizes(few))
    with pytest.raises(ValueError, match="required"):
        checks.require_label(few, None)
    with pytest.raises(ValueError, match="not one of the labels"):
        checks.require_label(few, "zzz")
    with pytest.raises(ValueError, match="between 0 and 1"):
        checks.require_share(1.0)


def test_numeric_outcome_names_bad_ids(spark):
    from markerloom.operators.outcomes import join_outcome

    samples = spark.createDataFrame([(f"s{i}",) for i in range(15)], "sample_id string")
    meta = spark.createDataFrame([(f"s{i}", "1.5" if i < 3 else "high") for i in range(15)], "id string, scc string")
    joined = join_outcome(samples, meta, "id", "scc")
    with pytest.raises(ValueError) as error:
        checks.require_numeric(joined)
    assert str(error.value).count("'s") == 10


def test_predictor_choice():
    columns = ["sample", "OG1", "OG2", "other", "target"]
    assert tsv.feature_columns(columns, "sample", "target") == (["OG1", "OG2", "other"], [])
    assert tsv.feature_columns(columns, "sample", "target", prefix="OG")[0] == ["OG1", "OG2"]
    assert tsv.feature_columns(columns, "sample", "target", exclude=["OG1", "zz"]) == (["OG2", "other"], ["zz"])
    with pytest.raises(ValueError, match="zz"):
        tsv.feature_columns(columns, "sample", "target", include=["OG1", "zz"])


def test_missing_labels_and_repeated_ids(spark, baskets):
    rows = spark.createDataFrame([("a", None, ["x"]), ("b", "l", ["x"]), ("c", "m", [])], "sample_id string, label string, items array<string>")
    assert sorted(r.sample_id for r in presence.drop_labels(rows, ["l"]).collect()) == ["a", "c"]
    codes = {r.sample_id: r.encoded_class for r in presence.encode_labels(rows).collect()}
    assert codes == {"a": 2, "b": 0, "c": 1}
    assert {r.label for r in presence.label_codes(rows).collect()} == {"l", "m", presence.MISSING_LABEL}
    checks.require_unique_ids(rows)
    with pytest.raises(ValueError, match="'a'"):
        checks.require_unique_ids(rows.union(rows.limit(1)))


def test_unknown_excluded_names_are_told(spark, tmp_path):
    path = str(tmp_path / "wide.tsv")
    with open(path, "w") as f:
        f.write("sample\ttarget\tOG1\tOG2\ns1\ta\t1\t0\n")
    with pytest.warns(UserWarning, match="OG9"):
        got, _ = tsv.read_presence(spark, path, "sample", "target", exclude=["OG2", "OG9"])
    assert [r["items"] for r in got.collect()] == [["OG1"]]


def test_wide_tables_are_read_by_place(spark, tmp_path):
    import time

    wide = tmp_path / "wide.tsv"
    columns = [f"OG{i:06}" for i in range(50_000)]
    with open(wide, "w") as f:
        f.write("\t".join(["sample", *columns, "target"]) + "\n")
        for s in range(100):
            f.write("\t".join([f"s{s}", *("1" if (i + s) % 50 == 0 else "0" for i in range(50_000)), "a" if s % 2 else ""]) + "\n")
    start = time.perf_counter()
    got, order = tsv.read_presence(spark, str(wide), "sample", "target", prefix="OG")
    counts = presence.feature_counts(got).collect()
    assert time.perf_counter() - start < 30
    assert len(counts) == 50_000 and all(r.n == 2 for r in counts) and len(order.columns) == 2
    assert got.filter("label is null").count() == 50


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text('"sample"\t"OG a"\tOG2\n"s ""1"""\t"1"\t0\ns2\t\tTRUE\n')
    got, _ = tsv.read_presence(spark, str(path), "sample")
    assert {r.sample_id: r["items"] for r in got.collect()} == {'s "1"': ["OG a"], "s2": ["OG2"]}


def test_wide_tsv_of_very_many_columns(spark, tmp_path):
    names = sorted(f"s{i}" for i in range(30_000))
    held = {("f", "s0"): "part_1 A", ("f", "s9999"): 'the "B", C ', ("g", "s17"): "part_2", ("g", "s18"): "", (None, "s5"): "D", ("h", "other"): "E"}
    cells = spark.createDataFrame([(*key, entry) for key, entry in held.items()], "feature string, sample_id string, entry string")
    path = str(tmp_path / "wide")
    results.export_wide_tsv(cells, path, "feature", "sample_id", "entry", names, "Orthogroup")
    assert {len(r.value.split("\t")) for r in spark.read.text(path).collect()} == {30_001}
    got = {(r.feature, r.sample_id): r.entry for r in tsv.read_annotation(spark, path).collect()}
    assert got == {k: v for k, v in held.items() if v and k[1] != "other"}
    results.export_wide_tsv(cells.limit(0), str(tmp_path / "empty"), "feature", "sample_id", "entry", names, "Orthogroup")
    assert tsv.read_annotation(spark, str(tmp_path / "empty")).isEmpty()
    with pytest.raises(Exception, match="already exists"):
        results.export_wide_tsv(cells, path, "feature", "sample_id", "entry", names, "Orthogroup")


def test_annotation_file_with_a_column_per_supplier(spark, tmp_path):
    # 20,000 suppliers, one of them twice; each supplies one part. A pivot makes a column of the plan for each.
    n = 20_000
    spark.range(n).union(spark.range(1)).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(n).select(F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    brand = F.concat(F.lit("Brand#"), (F.col("id") % 3).cast("string")).alias("p_brand")
    spark.range(n).select(F.col("id").alias("p_partkey"), brand, F.lit("TIN").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    got = files.QUERIES["file_annotation"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((f"Brand#{i % 3}", str(i), f"part_{i} TIN") for i in range(n))
