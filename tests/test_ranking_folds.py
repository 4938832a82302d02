import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from markerloom.operators import folds
from markerloom.operators.ranking import exact_rank, hash_bucket, sum_below


def labelled(spark, n=997):
    # One label holds most rows.
    return spark.createDataFrame(
        [(f"s{i}", "big" if i % 3 else ("mid" if i % 2 else "low")) for i in range(n)], "sample_id string, label string"
    )


def test_rank_equals_plain_window(spark):
    df = labelled(spark).withColumn("d", F.md5("sample_id")).withColumn("b", hash_bucket(F.col("d"), 1))
    mine = exact_rank(df, ["label"], ["b"], ["d", "sample_id"])
    plain = df.withColumn("plain", F.row_number().over(Window.partitionBy("label").orderBy("d", "sample_id")))
    joined = mine.join(plain.select("sample_id", "plain"), "sample_id")
    assert joined.count() == 997 and joined.filter("rank <> plain").isEmpty()


def test_sum_below_on_skewed_values(spark):
    rng = random.Random(1)
    values = {rng.choice([1e-9, 1.0, 1e6]) * rng.random() for _ in range(500)} | {0.0, -5.0}
    rows = [("k", v, rng.randrange(4)) for v in values] + [("other", 1.0, 7)]
    df = spark.createDataFrame(rows, "k string, v double, t long")
    got = {(r.k, r.v): r.below for r in sum_below(df, ["k"], "v", "t", "below").collect()}
    assert len(got) == len(rows)
    for key, value, _ in rows:
        assert got[(key, value)] == sum(t for k, v, t in rows if k == key and v < value)


def test_folds_are_balanced_and_hold_each_sample_out_once(spark):
    assigned = folds.repeated_folds(labelled(spark), 5, 3, 42, True, 4).cache()
    assert assigned.count() == 997 * 3
    assert assigned.groupBy("repeat", "sample_id").count().filter("count <> 1").isEmpty()
    per_class = assigned.groupBy("repeat", "fold", "label").count()
    spread = per_class.groupBy("repeat", "label").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.agg(F.max("d")).first()[0] <= 1
    sizes = assigned.groupBy("repeat", "fold").count().groupBy("repeat").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1
    # Inner folds of each training set stay close to equal.
    for held in (1, 5):
        inner = [r[1] for r in assigned.filter((F.col("repeat") == 1) & (F.col("fold") != held)).groupBy("inner_fold").count().collect()]
        assert len(inner) == 4 and max(inner) - min(inner) <= 4
    again = folds.repeated_folds(labelled(spark).repartition(3), 5, 3, 42, True, 4)
    assert again.exceptAll(assigned).isEmpty()


def test_repeats_differ(spark):
    assigned = folds.repeated_folds(labelled(spark), 5, 2)
    wide = assigned.groupBy("sample_id").pivot("repeat", [1, 2]).agg(F.first("fold"))
    assert 0 < wide.filter("`1` <> `2`").count() < 997


def test_holdout_share(spark):
    split = folds.holdout_split(labelled(spark), 0.2, 7)
    rows = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == round(n * 0.2) for n, t in rows.values())


def test_fold_sizes(spark):
    sizes = folds.fold_sizes(folds.repeated_folds(labelled(spark), 5, 1), "low").collect()
    assert all(r.n_train + r.n_test == 997 for r in sizes)
    assert len({r.positives_train + r.positives_test for r in sizes}) == 1
