"""Paths from shared expansions against those of scans, and areas by one sort against pairs."""

import dataclasses

import numpy as np
import pytest
from test_paths import SETTINGS, table_of

from markerloom.operators import expansions, paths, penalised


@pytest.mark.parametrize("classes, tolerance", [(2, 1e-4), (2, 1e-7), (3, 1e-4), (3, 1e-7)])
def test_expansions_give_the_paths_of_scans(spark, baskets, monkeypatch, classes, tolerance):
    """With a wide tolerance most points come from sums alone; with a narrow one scans settle the rest."""
    table, names = table_of(baskets, n=12_000, p=3, classes=classes)
    exact = dataclasses.replace(SETTINGS, tol=1e-9)
    prepared = penalised.prepare(table, names, exact, stratified=True)
    plain = penalised.fit_logistic(prepared, classes)
    left, whole = [], []
    settled = paths.settled
    monkeypatch.setattr(expansions, "LEAST_ROWS", 1000)
    monkeypatch.setattr(paths, "settled", lambda dealt, grid, points, out: left.append(sum(len(p[1]) for p in points)) or whole.append(out.score.size) or settled(dealt, grid, points, out))
    prepared.settings = dataclasses.replace(SETTINGS, tol=tolerance)
    found = penalised.fit_logistic(prepared, classes)
    assert left[0] < whole[0] / 2 if tolerance > 1e-5 else left[0] > 0
    score = lambda f: {(r["fit_id"], r["C"], r["l1_ratio"], r["inner_fold"]): r["score"] for r in f.inner_scores.collect()}
    a, b = score(plain), score(found)
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=2 * tolerance if classes > 2 else 1e-3) for k in a)
    assert found.inner_scores.filter("not converged").isEmpty()
    if tolerance < 1e-5:
        best = lambda f: {r["fit_id"]: (r["best_C"], r["best_l1_ratio"]) for r in f.best.collect()}
        coef = lambda f: {(r["fit_id"], r["class"], r["feature"]): r["coef"] for r in f.coef.collect()}
        same, (a, b) = [k for k, v in best(plain).items() if best(found)[k] == v], (coef(plain), coef(found))
        assert same and all(a.get(k, 0.0) == pytest.approx(b.get(k, 0.0), abs=3e-6) for k in a.keys() | b.keys() if k[0] in same)


def test_areas_with_ties():
    rng = np.random.default_rng(0)
    for digits in (0, 1, 8):
        scores, own = np.round(rng.normal(size=90), digits), rng.random(90) < 0.4
        pairs = [(a > b) + 0.5 * (a == b) for a in scores[own] for b in scores[~own]]
        assert paths._area(scores, own) == pytest.approx(np.mean(pairs), abs=1e-12)
