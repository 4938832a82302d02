"""Shared-scan paths against plain solvers, and the screened against the full working set."""

import numpy as np
import pytest

from markerloom.operators import paths, penalised
from markerloom.operators.penalised import NetSettings

SETTINGS = NetSettings(outer_splits=3, outer_repeats=1, inner_cv=2, strengths=4, l1_ratios=(0.3, 0.9), tol=1e-9, max_iter=500)


def shrink(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def softmax(eta):
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_logistic(z, y, w, lam, l1, classes):
    """Accelerated proximal gradient; ``z`` has the intercept last. One lane for two classes, else one for each."""
    lanes, w = (1 if classes == 2 else classes), w / w.sum()
    b = np.zeros((lanes, z.shape[1]))
    step = 1.0 / np.linalg.eigvalsh(z.T @ (z * w[:, None])).max()
    target = y[:, None] if lanes == 1 else np.eye(classes)[y.astype(int)]
    v, t = b, 1.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(z @ v.T))) if lanes == 1 else softmax(z @ v.T)
        g = ((p - target) * w[:, None]).T @ z
        new = v - step * g
        new[:, :-1] = shrink(v[:, :-1] - step * (g[:, :-1] + lam * (1 - l1) * v[:, :-1]), step * lam * l1)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((new - b) * (v - new)).sum() > 0:
            s = 1.0
        v, b, t = new + (t - 1) / s * (new - b), new, s
    return b


def table_of(baskets, n=150, p=7, classes=2, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, p)) < rng.uniform(0.2, 0.7, p)
    eta = np.stack([rng.normal(size=p) * (k > 0) for k in range(classes)]) @ x.T
    y = np.array([rng.choice(classes, p=q) for q in softmax(eta.T)])
    rows = {(f"s{i}", str(y[i])): [f"f{j}" for j in np.flatnonzero(x[i])] for i in range(n)}
    return baskets(rows).selectExpr("*", "cast(label as double) as y"), [f"f{j}" for j in range(p)]


@pytest.mark.parametrize("classes, paired", [(2, 64), (2, 0), (3, 64)])
def test_chosen_coefficients_are_those_of_a_single_fit(spark, baskets, monkeypatch, classes, paired):
    monkeypatch.setattr(paths, "PAIRED", paired)
    monkeypatch.setattr(paths, "ROWS_IN_TASK", 60 if paired else 10**9)
    table, names = table_of(baskets, classes=classes)
    prepared = penalised.prepare(table, names, SETTINGS, stratified=True)
    found = penalised.fit_logistic(prepared, classes)
    rows = prepared.table.collect()
    coef = {(r["fit_id"], r["class"], r["feature"]): r["coef"] for r in found.coef.collect()}
    scores = {(r["fit_id"], r["C"], r["l1_ratio"], r["inner_fold"]): r["score"] for r in found.inner_scores.collect()}
    assert found.inner_scores.filter("not converged").isEmpty() and len(scores) == 3 * 2 * 4 * 2
    predicted = {(r["fit_id"], r["sample_id"]): r for r in found.predictions.collect()}
    assert len(predicted) == len(rows)
    for best in found.best.collect():
        fit, c, l1 = best["fit_id"], best["best_C"], best["best_l1_ratio"]
        train = [r for r in rows if r["fold_of"][0] != fit]
        x, y = np.array([r["features"].toArray() for r in train]), np.array([r["y"] for r in train])
        sd = x.std(0)
        weight = penalised.balanced_weights({k: int((y == k).sum()) for k in range(classes)})
        w = np.array([weight[int(k)] for k in y])
        z = np.hstack([x / sd, np.ones((len(x), 1))])
        plain = plain_logistic(z, y, w, 1 / (c * w.sum()), l1, classes)
        first = 1 if classes == 2 else 0
        for lane in range(len(plain)):
            got = [coef.get((fit, lane + first, name), 0.0) for name in names]
            assert got == pytest.approx(plain[lane, :-1], abs=2e-6)
        held = next(r for r in rows if r["fold_of"][0] == fit)
        at = np.append(held["features"].toArray() / sd, 1.0) @ plain.T
        p = [1 / (1 + np.exp(at[0])), 1 / (1 + np.exp(-at[0]))] if classes == 2 else softmax(at[None])[0]
        assert list(predicted[fit, held["sample_id"]]["probability"]) == pytest.approx(list(p), abs=1e-5)
        inner = np.array([r["inner_of"][0] for r in train])
        own, out = inner != 1, inner == 1
        plain = plain_logistic(z[own], y[own], w[own], 1 / (c * w[own].sum()), l1, classes)
        eta = z[out] @ plain.T
        if classes == 2:
            pairs = [(a > b) + 0.5 * (a == b) for a in eta[y[out] == 1, 0].round(9) for b in eta[y[out] == 0, 0].round(9)]
            wanted = np.mean(pairs)
        else:
            wanted = np.log(softmax(eta)[np.arange(out.sum()), y[out].astype(int)]).mean()
        assert scores[fit, c, l1, 1] == pytest.approx(wanted, abs=2e-3 if classes == 2 else 1e-6)


def linear_table(baskets, n, p, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.random((n, p)) < rng.uniform(0.1, 0.6, p)
    y = 3.0 * x[:, 0] - 2.0 * x[:, 1] + x[:, 2:6].sum(axis=1) + rng.normal(size=n) * 0.5
    rows = {(f"s{i}", str(float(y[i]))): [f"f{j:04d}" for j in np.flatnonzero(x[i])] for i in range(n)}
    return baskets(rows).selectExpr("*", "cast(label as double) as y"), [f"f{j:04d}" for j in range(p)]


@pytest.mark.parametrize("n, p, working, numbers", [(70, 200, 64, 24_000_000), (50, 600, 48, 100_000)])
def test_screened_paths_are_optimal(spark, baskets, monkeypatch, n, p, working, numbers):
    """Every feature meets its condition at the chosen point, also those that no working set held."""
    settings = NetSettings(outer_splits=2, outer_repeats=1, inner_cv=2, strengths=4, l1_ratios=(0.5, 0.95), tol=1e-8, max_iter=300)
    table, names = linear_table(baskets, n, p)
    prepared = penalised.prepare(table, names, settings, stratified=False)
    monkeypatch.setattr(paths, "WORKING_SET", working)
    monkeypatch.setattr(paths, "SUM_NUMBERS", numbers)
    found = penalised._fit_linear_paths(prepared)
    assert found.inner_scores.filter("not converged").isEmpty() and found.inner_scores.count() == 2 * 2 * 4 * 2
    coef = {(r["fit_id"], r["feature"]): r["coef"] for r in found.coef.collect()}
    predicted = {(r["fit_id"], r["sample_id"]): r["y_pred"] for r in found.predictions.collect()}
    rows = prepared.table.collect()
    for best in found.best.collect():
        fit, alpha, l1 = best["fit_id"], best["best_alpha"], best["best_l1_ratio"]
        train = [r for r in rows if r["fold_of"][0] != fit]
        x, y = np.array([r["features"].toArray() for r in train]), np.array([r["y"] for r in train])
        sd = x.std(0)
        scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
        z, b = (x - x.mean(0)) * scale, np.array([coef.get((fit, name), 0.0) for name in names])
        rest = y - y.mean() - z @ b
        slope = z.T @ rest / len(y) - alpha * (1 - l1) * b
        away = np.where(b != 0, np.abs(slope - alpha * l1 * np.sign(b)), np.maximum(np.abs(slope) - alpha * l1, 0))
        assert away.max() < 1e-6 and (b != 0).any()
        for r in rows:
            if r["fold_of"][0] == fit:
                own = (r["features"].toArray() - x.mean(0)) * scale
                assert predicted[fit, r["sample_id"]] == pytest.approx(y.mean() + own @ b, abs=1e-6)


@pytest.mark.parametrize("working", [256, 7])
def test_screened_paths_equal_the_moment_path(spark, baskets, monkeypatch, working):
    settings = NetSettings(outer_splits=2, outer_repeats=1, inner_cv=2, strengths=4, l1_ratios=(0.5, 0.95), tol=1e-9, max_iter=2000)
    table, names = linear_table(baskets, 90, 9)
    prepared = penalised.prepare(table, names, settings, stratified=False)
    exact = penalised._fit_linear_moments(prepared)
    monkeypatch.setattr(paths, "WORKING_SET", working)
    screened = penalised._fit_linear_paths(prepared)
    assert exact.inner_scores.filter("not converged").isEmpty() and screened.inner_scores.filter("not converged").isEmpty()
    assert sorted(exact.inner_scores.columns) == sorted(screened.inner_scores.columns) and sorted(exact.best.columns) == sorted(screened.best.columns)
    key = lambda r: (r["fit_id"], round(r["alpha"], 9), r["l1_ratio"], r["inner_fold"])
    a, b = ({key(r): r["score"] for r in f.inner_scores.collect()} for f in (exact, screened))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=1e-6) for k in a)
    a, b = ({(r["fit_id"], r["feature"]): r["coef"] for r in f.coef.collect()} for f in (exact, screened))
    assert all(a.get(k, 0.0) == pytest.approx(b.get(k, 0.0), abs=1e-6) for k in a.keys() | b.keys())


def test_scans_do_not_grow_with_the_grid(spark, baskets):
    """More l1 ratios and repeats share the scans of fewer."""
    table, names = table_of(baskets, n=100, p=5)
    scans = []
    for repeats, ratios in ((1, (0.5,)), (3, (0.2, 0.5, 0.9))):
        settings = NetSettings(outer_splits=3, outer_repeats=repeats, inner_cv=2, strengths=5, l1_ratios=ratios, tol=1e-6)
        prepared = penalised.prepare(table, names, settings, stratified=True)
        seen = []
        plain = paths.solve_paths
        paths.solve_paths = lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1]
        try:
            penalised.fit_logistic(prepared, 2)
        finally:
            paths.solve_paths = plain
        scans.append(seen[0].scans)
    assert scans[1] <= 2 * scans[0] + 5


def test_areas_by_ranges_of_the_score(spark, baskets, monkeypatch):
    table, names = table_of(baskets, n=120, p=4)
    prepared = penalised.prepare(table, names, SETTINGS, stratified=True)
    whole = penalised.fit_logistic(prepared, 2).inner_scores.collect()
    monkeypatch.setattr(paths, "RANKED_TOGETHER", 5)
    parts = penalised.fit_logistic(prepared, 2).inner_scores.collect()
    score = lambda rows: {(r["fit_id"], r["C"], r["l1_ratio"], r["inner_fold"]): r["score"] for r in rows}
    assert score(whole) == pytest.approx(score(parts), abs=1e-12)


def test_the_shift_over_classes_is_the_cheapest():
    rng = np.random.default_rng(1)
    beta, ratio = rng.normal(size=(4, 5, 3)) * (rng.random((4, 5, 3)) < 0.6), np.array([0.05, 0.5, 0.95, 1.0])
    shift = paths._shift(beta, ratio)
    cost = lambda t: ratio[:, None] * np.abs(beta - t[:, None]).sum(1) + 0.5 * (1 - ratio[:, None]) * ((beta - t[:, None]) ** 2).sum(1)
    for move in np.linspace(-3, 3, 121):
        assert (cost(shift)[:, :-1] <= cost(np.full(shift.shape, move))[:, :-1] + 1e-9).all()
