"""Spark's fits against small numpy solvers, and the nested cross-validation."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from markerloom.operators import moments, penalised
from markerloom.operators.penalised import NetSettings
from markerloom.plans import binary_net, continuous_net, multiclass_net
from markerloom.plans.nets import binary_net_in_tsv, continuous_net_in_tsv, multiclass_net_in_tsv

EXACT = NetSettings(max_iter=2000, tol=1e-12)


def data(seed=0, n=120, p=8):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, p)) < rng.uniform(0.2, 0.8, p)).astype(float)
    signal = 2.5 * x[:, 0] - 2.0 * x[:, 1] + 0.3 * x[:, 2]
    return x, signal, rng


def shrink(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def descend(x, y, alpha, l1):
    """Coordinate descent on the standardised design."""
    z, r = (x - x.mean(0)) / x.std(0), y - y.mean()
    b, n = np.zeros(x.shape[1]), len(y)
    for _ in range(3000):
        for j in range(len(b)):
            rho = z[:, j] @ (r - z @ b + z[:, j] * b[j]) / n
            b[j] = shrink(rho, alpha * l1) / (1 + alpha * (1 - l1))
    return b


def proximal(x, y, w, c, l1):
    """Proximal gradient for the weighted logistic objective."""
    z = (x - x.mean(0)) / x.std(0)
    lam, w = 1 / (c * w.sum()), w / w.sum()
    b, b0, step = np.zeros(x.shape[1]), 0.0, 4.0 / (1 + np.linalg.eigvalsh(z.T @ (z * w[:, None])).max())
    for _ in range(60000):
        g = w * (1 / (1 + np.exp(-(z @ b + b0))) - y)
        b = shrink(b - step * (z.T @ g + lam * (1 - l1) * b), step * lam * l1)
        b0 -= step * g.sum()
    return b


@pytest.mark.parametrize("alpha,l1", [(0.8, 0.4), (0.1, 0.95), (0.3, 0.05)])
def test_linear_penalty_parity(spark, alpha, l1):
    x, signal, rng = data()
    y = 3 * signal + rng.normal(size=len(signal))
    rows = [(Vectors.dense(a / x.std(0)), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, ["x", "y"])
    model = penalised.linear_fit(df, alpha, l1, float(np.std(y, ddof=1)), EXACT)
    assert model.coefficients.toArray() == pytest.approx(descend(x, y, alpha, l1), abs=1e-6)


def test_linear_penalty_does_not_depend_on_the_width(spark):
    x, signal, rng = data(n=60, p=6)
    y = 3 * signal + rng.normal(size=len(signal))
    coefs = []
    for width in (6, 4200):
        rows = [(Vectors.sparse(width, list(range(6)), (a / x.std(0)).tolist()), float(b)) for a, b in zip(x, y)]
        model = penalised.linear_fit(spark.createDataFrame(rows, ["x", "y"]), 0.5, 0.2, float(np.std(y, ddof=1)), EXACT)
        coefs.append(model.coefficients.toArray()[:6])
    assert coefs[0] == pytest.approx(descend(x, y, 0.5, 0.2), abs=1e-6)
    assert coefs[1] == pytest.approx(coefs[0], abs=1e-6)


def test_paths_from_moments():
    x, signal, rng = data(3, p=5)
    y = signal + rng.normal(size=len(signal))
    z = (x - x.mean(0)) / x.std(0)
    gram, cross = z.T @ z / len(y), z.T @ (y - y.mean()) / len(y)
    alphas = np.array([[0.9, 0.3, 0.02], [0.5, 0.1, 0.01]])
    found, done = moments.descend(np.stack([gram] * 2), np.stack([cross] * 2), alphas, np.array([0.3, 0.9]), 30_000)
    assert done.all()
    for k, l1 in enumerate((0.3, 0.9)):
        for step, alpha in enumerate(alphas[k]):
            assert found[k, step] == pytest.approx(descend(x, y, alpha, l1), abs=1e-7)


def test_both_linear_ways_agree(spark, baskets, monkeypatch):
    rng = np.random.default_rng(4)
    rows = {(f"s{i}", "x"): [f"f{j}" for j in range(5) if rng.random() < 0.3 + 0.1 * j] for i in range(60)}
    table = baskets(rows).selectExpr("*", "cast(3 * size(items) + 4 * cast(array_contains(items, 'f1') as int) + hash(sample_id) % 3 as double) as y")
    settings = NetSettings(outer_splits=3, outer_repeats=1, inner_cv=2, strengths=3, l1_ratios=(0.2, 0.9), max_iter=2000, tol=1e-12)
    prepared = penalised.prepare(table, [f"f{j}" for j in range(5)], settings, stratified=False)
    quick = penalised.fit_linear(prepared)
    monkeypatch.setattr(moments, "MOMENT_FEATURES", 0)
    slow = penalised.fit_linear(prepared)
    for name, keys, value in (("coef", ["fit_id", "feature"], "coef"), ("predictions", ["fit_id", "sample_id"], "y_pred"), ("inner_scores", ["fit_id", "alpha", "l1_ratio", "inner_fold"], "score")):
        a, b = (sorted((*(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in keys), r[value]) for r in getattr(f, name).collect()) for f in (quick, slow))
        assert [r[:-1] for r in a] == [r[:-1] for r in b]
        assert [r[-1] for r in a] == pytest.approx([r[-1] for r in b], abs=1e-4)
    assert quick.inner_scores.filter("not converged").isEmpty()


@pytest.mark.parametrize("c,l1", [(0.1, 0.4), (1.0, 0.95)])
def test_logistic_penalty_parity(spark, c, l1):
    x, signal, rng = data(1)
    y = (rng.random(len(signal)) < 1 / (1 + np.exp(-signal))).astype(float)
    share = penalised.balanced_weights({0: int((y == 0).sum()), 1: int(y.sum())})
    w = np.where(y == 1, share[1], share[0])
    assert w.sum() == pytest.approx(len(y))
    rows = [(Vectors.dense(a / x.std(0)), float(b), float(v)) for a, b, v in zip(x, y, w)]
    df = spark.createDataFrame(rows, ["x", "y", "weight"])
    model = penalised.logistic_fit(df, c, l1, float(len(y)), EXACT, "binomial")
    mine = model.coefficients.toArray()
    assert mine == pytest.approx(proximal(x, y, w, c, l1), abs=2e-4)


def test_grids():
    grid = penalised.c_grid(20)
    assert grid[0] == pytest.approx(1e-4) and grid[-1] == pytest.approx(1e4) and len(grid) == 20
    path = penalised.alpha_path(2.0, 100)
    assert path[0] == 2.0 and path[-1] == pytest.approx(2e-3) and len(path) == 100


def planted(baskets, n=90, labels=("a", "b", "c")):
    rng = np.random.default_rng(2)
    rows = {}
    for i in range(n):
        label = labels[i % len(labels)]
        items = [f"noise{j}" for j in range(6) if rng.random() < 0.5]
        if rng.random() < (0.9 if label == "a" else 0.1):
            items.append("up")
        if rng.random() < (0.1 if label == "a" else 0.9):
            items.append("down")
        rows[(f"s{i}", label)] = items
    return baskets(rows)


SMALL = NetSettings(outer_splits=3, outer_repeats=1, inner_cv=2, strengths=3, l1_ratios=(0.5,), max_iter=50, tol=1e-5)


def test_training_stats_match_numpy(spark, baskets):
    table = planted(baskets).selectExpr("*", "cast(label = 'a' as double) as y")
    names = ["down", "noise0", "up"]
    prepared = penalised.prepare(table, names, SMALL, True)
    rows = prepared.table.collect()
    got = {(r.fit_id, r.code): r for r in penalised.training_stats(prepared).collect()}
    for fit in prepared.fits:
        train = [r for r in rows if r.fold_of[0] != fit]
        x = np.array([r.features.toArray() for r in train])
        y = np.array([r.y for r in train])
        z = (x - x.mean(0)) / x.std(0)
        for code in range(3):
            r = got[fit, code]
            assert (r.n_train, r.mean, r.sd) == pytest.approx((len(train), x[:, code].mean(), x[:, code].std()))
            assert r.score_y == pytest.approx(z[:, code] @ (y - y.mean()))


def test_binary_net_finds_planted_features(spark, baskets):
    out = binary_net(planted(baskets), "a", SMALL)
    table = {r.Orthogroup: r for r in out.stability.collect()}
    assert len(table) == 8
    assert table["up"].selection_rate == 1.0 and table["up"].mean_coef > 0 > table["down"].mean_coef
    folds = out.fold_metrics.collect()
    assert len(folds) == 3 and all(f.n_train + f.n_test == 90 and f.TP + f.FP + f.TN + f.FN == f.n_test for f in folds)
    assert out.overall.first().AUC > 0.8
    assert out.predictions.groupBy("sample_id").count().filter("count <> 1").isEmpty() and out.predictions.count() == 90
    assert out.sample_summary.count() == 90


def test_multiclass_net_gives_directions(spark, baskets):
    out = multiclass_net(planted(baskets), "a", SMALL)
    table = {r.Orthogroup: r.direction_in_TOI for r in out.toi_stability.collect()}
    assert table["up"] == "enriched_in_TOI" and table["down"] == "depleted_in_TOI"
    assert [(r.encoded_class, r.label) for r in out.class_map.orderBy("encoded_class").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert {"prob_a", "prob_b", "prob_c"} <= set(out.predictions.columns)
    with pytest.raises(ValueError, match="3 labels or more"):
        multiclass_net(planted(baskets), "a", SMALL, keep=["a", "b"])


def test_continuous_net(spark, baskets):
    table = planted(baskets)
    meta = table.selectExpr("sample_id as id", "cast(10 + 5 * cast(array_contains(items, 'up') as int) as string) as scc")
    out = continuous_net(table, meta, "id", "scc", SMALL)
    got = {r.Orthogroup: r.n_selected for r in out.stability.collect()}
    assert got["up"] == 3 and out.overall.first().R2 > 0.95
    assert out.fold_metrics.columns == ["fold", "n_train", "n_test", "best_alpha", "best_l1_ratio", "R2", "MAE", "RMSE"]
    with pytest.raises(ValueError, match="no sample"):
        continuous_net(table, meta.selectExpr("concat(id, 'x') as id", "scc"), "id", "scc", SMALL)


def test_nets_on_wide_tables(spark, tmp_path):
    """Feature columns by prefix; those that no sample has are listed with 0."""
    rng = np.random.default_rng(3)
    rows, meta = ["sample\tOG1\tother\tOG2\ttarget\tOG_never"], ["sample\tscc\textra"]
    for i in range(90):
        label = "abc"[i % 3]
        up, noise = int(rng.random() < (0.9 if label == "a" else 0.1)), int(rng.random() < 0.5)
        rows.append(f"s{i}\t{up}\t1\t{noise}\t{label}\t0")
        meta.append(f"s{i}\t{10 + 5 * up}\tx")
    wide, outcome = tmp_path / "wide.tsv", tmp_path / "meta.tsv"
    wide.write_text("\n".join(rows) + "\n")
    outcome.write_text("\n".join(meta) + "\n")
    names = {"OG1", "OG2", "OG_never"}
    found = binary_net_in_tsv(spark, str(wide), "sample", "target", "a", SMALL, out=str(tmp_path / "net"))
    table = {r.Orthogroup: r for r in found.stability.collect()}
    assert set(table) == names and table["OG_never"].n_selected == 0 and table["OG1"].selection_rate == 1.0
    assert {r.Orthogroup for r in spark.read.parquet(str(tmp_path / "net" / "stability")).collect()} == names
    found = multiclass_net_in_tsv(spark, str(wide), "sample", "target", "a", SMALL)
    assert {r.Orthogroup: r.direction_in_TOI for r in found.toi_stability.collect()}["OG1"] == "enriched_in_TOI"
    found = continuous_net_in_tsv(spark, str(wide), str(outcome), "sample", "scc", SMALL)
    assert {r.Orthogroup: r.n_selected for r in found.stability.collect()} | {"OG2": 0} == {"OG1": 3, "OG2": 0, "OG_never": 0}
    with pytest.raises(ValueError):
        binary_net_in_tsv(spark, str(wide), "sample", "target", "a", SMALL, prefix="XX")
