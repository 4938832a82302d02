import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.functions import tails
from markerloom.operators import metrics, stability


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(2), rng.choice([0.1, 0.5, rng.random()])) for k in ("a", "b") for _ in range(200)]
    df = spark.createDataFrame(rows + [("one", 1, 0.5)], "k string, y_true int, score double")
    got = {r.k: r.auc for r in metrics.roc_auc(df, ["k"]).collect()}
    for k in ("a", "b"):
        assert got[k] == pytest.approx(brute_auc([(y, s) for g, y, s in rows if g == k]))
    assert got["one"] is None


def test_mcc_is_zero_when_a_factor_is(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "y_true int, y_pred int")
    row = metrics.binary_scores(df).first()
    assert row.MCC == 0.0 and row.balanced_accuracy == 0.5
    only = metrics.binary_scores(df.filter("y_true = 1")).first()
    assert only.balanced_accuracy == 1.0


def test_macro_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y_true string, y_pred string")
    row = metrics.multiclass_scores(df).first()
    assert row.accuracy == 0.5 and row.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3)
    assert row.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3) and row.macro_precision == pytest.approx((0.5 + 0.5 + 0) / 3)


def test_macro_auc_needs_every_class(spark):
    rows = [(1, "a", {"a": 0.8, "b": 0.2}), (1, "b", {"a": 0.3, "b": 0.7}), (2, "a", {"a": 0.6, "b": 0.4})]
    df = spark.createDataFrame(rows, "k int, y_true string, prob map<string,double>")
    got = {r.k: r.macro_auc for r in metrics.macro_auc(df, 2, ["k"]).collect()}
    assert got == {1: 1.0, 2: None}


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y_true double, y_pred double")
    row = metrics.regression_scores(df).first()
    assert row.R2 == pytest.approx(1 - 2 / 8) and row.MAE == pytest.approx(2 / 3) and row.RMSE == pytest.approx(math.sqrt(2 / 3))
    assert metrics.regression_scores(df.filter("y_true = 1")).first().R2 == 0.0


def coef_table(spark):
    rows = [(1, "x", "f", 1.0), (2, "x", "f", -0.5), (2, "y", "f", 2.0), (3, "x", "g", -1.0), (3, "x", "h", 0.0)]
    return spark.createDataFrame(rows, "fit_id int, class string, feature string, coef double")


def test_stability_tables(spark):
    features = spark.createDataFrame([("f",), ("g",), ("h",), ("never",)], "feature string")
    x = coef_table(spark).filter("class = 'x'")
    got = {r.Orthogroup: r for r in stability.binary_stability(x, features, 4).collect()}
    assert got["f"].n_selected == 2 and got["f"].selection_rate == 0.5
    assert got["f"].mean_coef == pytest.approx(0.5 / 4) and got["f"].mean_abs_coef == pytest.approx(1.5 / 4)
    assert got["f"].mean_coef_selected == pytest.approx(0.25)
    assert got["f"].pos_rate_selected + got["f"].neg_rate_selected == 1.0
    for name in ("h", "never"):
        assert got[name].n_selected == 0 and got[name].mean_coef == 0.0 and got[name].pos_rate_selected is None
    every = {r.Orthogroup: r.n_selected_any for r in stability.any_class_stability(coef_table(spark), features, 4).collect()}
    assert every == {"f": 2, "g": 1, "h": 0, "never": 0}
    toi = {r.Orthogroup: r.direction_in_TOI for r in stability.toi_stability(coef_table(spark), features, 4, "x").collect()}
    assert toi == {"f": "enriched_in_TOI", "g": "depleted_in_TOI", "h": "NA", "never": "NA"}
    assert [r.Orthogroup for r in stability.ranked(stability.regression_stability(x, features, 4), 2).collect()] == ["f", "g"]


def test_hyper_ties_prefer_small_l1_then_small_strength(spark):
    rows = [(1, c, l1, g, 0.5) for c in (0.1, 1.0) for l1 in (0.1, 0.9) for g in (1, 2)]
    df = spark.createDataFrame(rows, "fit_id int, C double, l1_ratio double, inner_fold int, score double")
    best = stability.choose_hyper(df).first()
    assert (best.best_C, best.best_l1_ratio) == (0.1, 0.1)
    low = stability.choose_hyper(df.withColumnRenamed("C", "alpha"), "alpha", "min", "large").first()
    assert (low.best_alpha, low.best_l1_ratio) == (1.0, 0.1)


def test_seed_walk_is_sequential(spark):
    # The second pair has a lower F1, so the third is compared with the first.
    rows = [(0, 0, 0.8, 0.7, 0.7), (0, 1, 0.9, 0.6, 0.9), (1, 0, 0.8, 0.7, 0.7), (1, 1, 0.85, 0.65, 0.8)]
    df = spark.createDataFrame(rows, "split_seed int, model_seed int, accuracy double, macro_f1 double, macro_precision double")
    best = stability.choose_seeds(df.repartition(4)).first()
    assert (best.split_seed, best.model_seed) == (1, 0)


def exact(rule, k, m, p):
    chance = [math.comb(m, d) * p**d * (1 - p) ** (m - d) for d in range(m + 1)]
    if rule == "spread":
        return sum(c for d, c in enumerate(chance) if d * (m - d) < k * (m - k))
    return min(1.0, 2 * min(sum(chance[: k + 1]), sum(chance[k:])))


@pytest.mark.parametrize("m,p", [(1, 0.5), (7, 0.3), (40, 0.9), (60, 0.05), (30, 1.0), (30, 0.0)])
def test_binomial_tails_against_summation(m, p):
    for k in range(m + 1):
        spread = exact("spread", k, m, p) if 0 < p < 1 else 1.0
        assert tails._spread(k, m, p) == pytest.approx(spread, abs=1e-12)
        assert tails._two_sided(k, m, p) == pytest.approx(exact("mean", k, m, p), abs=1e-12)


def test_binomial_tail_of_a_large_cluster():
    assert tails._two_sided(500_000_000, 1_000_000_000, 0.5) == pytest.approx(1.0, abs=1e-3)
    assert tails.at_most(499_900_000, 1_000_000_000, 0.5) == pytest.approx(1.27e-10, rel=0.02)


def test_metric_summary_skips_missing(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.7)], "fold int, AUC double")
    row = stability.metric_summary(df, ["AUC"]).first()
    assert row["mean"] == pytest.approx(0.6) and row.n_folds == 2 and row.sd == pytest.approx(math.sqrt(0.02))


def test_chi_square_tail_is_the_error_function(spark):
    import math

    values = [0.0, 1e-12, 1e-3, 0.5, 3.84145882, 7.999999, 8.0, 20.0, 300.0, 5000.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["v"]: r["p"] for r in rows.withColumn("p", tails.chi_square_tail(F.col("v"))).collect()}
    assert got.pop(None) is None
    for v in values:
        assert got[v] == pytest.approx(math.erfc(math.sqrt(v / 2)), rel=1e-9, abs=1e-14)


def test_tails_of_many_rows_are_those_of_single_ones():
    k, m, p = (np.array(x) for x in zip(*[(a, b, c) for b in (1, 7, 60, 5000) for a in {0, 1, b // 2, b} for c in (0.0, 0.01, 0.4, 1.0)], strict=True))
    for rule in (tails._spread, tails._two_sided, tails.at_most, tails.at_least):
        assert rule(k, m, p).tolist() == [float(rule(a, b, c)[0]) for a, b, c in zip(k, m, p, strict=True)]
