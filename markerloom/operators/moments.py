"""Linear elastic-net paths from second moments (V6, V7).

Every repeat splits the samples into cells, one per outer and inner fold. Sums
of products per cell come from one scan. What a fit trains on or scores by is a
sum of cells, so the whole grid of every fit is solved without the rows:
coordinate descent down the penalties, all l1 ratios and inner folds at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sums of products take the square of the features in every cell; this bounds a fit's share to some MB.
MOMENT_FEATURES = 256
FLUSH_NUMBERS = 4_000_000
STEP_TOLERANCE = 1e-10

CELLS = "repeat int, fold int, inner_fold int, i int, j int, total double"
SOLVED = "fit_id int, kind string, alpha double, l1_ratio double, inner_fold int, score double, converged boolean, code int, coef double"


def moment_cells(table: DataFrame, size: int) -> DataFrame:
    """``repeat, fold, inner_fold, i, j, total``: sums of products of (1, y, features) per cell, upper triangle."""

    def emit(held: dict) -> pd.DataFrame:
        upper = np.triu_indices(size + 2)
        frames = [
            pd.DataFrame({"repeat": r, "fold": f, "inner_fold": g, "i": upper[0], "j": upper[1], "total": total[upper]})
            for (r, f, g), total in held.items()
        ]
        out = pd.concat(frames)
        return out[out.total != 0.0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            rows = np.zeros((len(batch), size + 2))
            rows[:, 0], rows[:, 1] = 1.0, batch["y"]
            sizes = batch["codes"].map(len).to_numpy()
            rows[np.repeat(np.arange(len(batch)), sizes), np.concatenate([np.zeros(0, dtype=np.int64), *batch["codes"]]).astype(np.int64) + 2] = 1.0
            folds, inner = (np.stack(batch[c].to_numpy()) for c in ("fold_of", "inner_of"))
            for repeat in range(folds.shape[1]):
                cells = pd.DataFrame({"f": folds[:, repeat], "g": inner[:, repeat]})
                for (f, g), own in cells.groupby(["f", "g"]).indices.items():
                    key = (repeat, int(f), int(g))
                    part = rows[own].T @ rows[own]
                    held[key] = held[key] + part if key in held else part
                    if len(held) * part.size > FLUSH_NUMBERS:
                        yield emit(held)
                        held = {}
        if held:
            yield emit(held)

    lean = table.select("y", F.unwrap_udt("features").getField("indices").alias("codes"), "fold_of", "inner_of")
    return lean.mapInPandas(run, CELLS).groupBy("repeat", "fold", "inner_fold", "i", "j").agg(F.sum("total").alias("total"))


def descend(gram: np.ndarray, cross: np.ndarray, alphas: np.ndarray, l1: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many problems along their penalties: ``(problem, step, feature)``, and which converged.

    ``gram (problem, p, p)`` and ``cross (problem, p)`` are centred means of
    products, ``alphas (problem, step)`` fall, ``l1 (problem,)``. Each step
    starts from the one before.
    """
    problems, size = cross.shape
    steps = alphas.shape[1]
    beta, left = np.zeros((problems, size)), cross.copy()  # left = cross - gram @ beta
    out, done = np.zeros((problems, steps, size)), np.zeros((problems, steps), dtype=bool)
    diagonal = np.einsum("bjj->bj", gram)
    scale = np.sqrt(np.maximum(diagonal, 0.0))
    columns = [np.ascontiguousarray(gram[:, :, j]) for j in range(size)]
    limit = STEP_TOLERANCE * np.maximum(np.abs(cross).max(axis=1), 1e-300)
    for step in range(steps):
        thresholds, ridge = alphas[:, step] * l1, alphas[:, step] * (1.0 - l1)
        bottom = diagonal + ridge[:, None]
        over = np.where(diagonal > 0, 1.0 / np.where(bottom > 0, bottom, 1.0), 0.0)
        active = np.ones(problems, dtype=bool)
        for _ in range(max_iter):
            largest = np.zeros(problems)
            for j in range(size):
                rho = left[:, j] + diagonal[:, j] * beta[:, j]
                new = (np.maximum(rho - thresholds, 0.0) + np.minimum(rho + thresholds, 0.0)) * over[:, j]
                change = new - beta[:, j]
                if change.any():
                    left -= columns[j] * change[:, None]
                    beta[:, j] = new
                    largest = np.maximum(largest, np.abs(change) * scale[:, j])
            active = largest > limit
            if not active.any():
                break
        out[:, step], done[:, step] = beta, ~active
    return out, done


class _Sums:
    """Sums of products of one training or scoring set, with scaled features."""

    def __init__(self, total: np.ndarray, scale: np.ndarray) -> None:
        self.n = total[0, 0]
        n = max(self.n, 1.0)
        self.mean_y, self.yy = total[0, 1] / n, total[1, 1]
        self.mean_x, self.xy = total[0, 2:] * scale / n, total[1, 2:] * scale
        self.xx = total[2:, 2:] * scale[:, None] * scale[None, :]
        self.gram = self.xx / n - np.outer(self.mean_x, self.mean_x)
        self.cross = self.xy / n - self.mean_x * self.mean_y

    def error(self, beta: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Mean squared error of every row of coefficients."""
        quad = np.einsum("sj,jk,sk->s", beta, self.xx, beta)
        linear = beta @ self.mean_x * self.n
        sums = self.yy + self.n * intercept**2 + quad - 2 * intercept * self.mean_y * self.n - 2 * beta @ self.xy + 2 * intercept * linear
        return sums / max(self.n, 1.0)


def solve_fits(cells: DataFrame, size: int, splits: int, inner_cv: int, l1_ratios: Sequence[float], strengths: int, span: float, max_iter: int) -> DataFrame:
    """Inner scores, the chosen point and its coefficients of every outer fit (``SOLVED``).

    ``kind`` is ``score`` for a grid point of an inner fold, ``coef`` for a
    non-zero coefficient of the refit (code -1: its intercept). Ties of the mean
    score go to the smaller l1 ratio, then to the larger penalty.
    """
    ratios = np.array(sorted(l1_ratios))
    steps = span ** (np.arange(strengths) / max(strengths - 1, 1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """All fits of one repeat at once: short loops over long arrays."""
        repeat = int(frame["repeat"].iloc[0])
        cells_of = np.zeros((splits + 1, inner_cv + 1, size + 2, size + 2))
        np.add.at(cells_of, (frame["fold"], frame["inner_fold"], frame["i"], frame["j"]), frame["total"])
        cells_of += np.triu(cells_of, 1).swapaxes(-1, -2)
        everything = cells_of.sum(axis=0)
        outers, parts, grids = [], [], []
        for fold in range(1, splits + 1):
            held = everything - cells_of[fold]
            whole = held.sum(axis=0)
            share = np.diag(whole)[2:] / max(whole[0, 0], 1.0)
            sd = np.sqrt(np.maximum(share * (1.0 - share), 0.0))
            scale = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
            outers.append(_Sums(whole, scale))
            grids.append(np.abs(outers[-1].cross).max() / ratios[:, None] * steps[None, :])
            parts += [(_Sums(whole - held[g], scale), _Sums(held[g], scale)) for g in range(1, inner_cv + 1)]
        many = len(ratios)
        found, done = descend(
            np.repeat(np.stack([own.gram for own, _ in parts]), many, axis=0),
            np.repeat(np.stack([own.cross for own, _ in parts]), many, axis=0),
            np.concatenate([grid for grid in grids for _ in range(inner_cv)]),
            np.tile(ratios, len(parts)),
            max_iter,
        )
        rows, means = [], np.zeros((splits, many, strengths))
        for at, (own, other) in enumerate(parts):
            fit, g = divmod(at, inner_cv)
            for k, ratio in enumerate(ratios):
                beta = found[at * many + k]
                errors = other.error(beta, own.mean_y - beta @ own.mean_x)
                means[fit, k] += errors / inner_cv
                scored = {"alpha": grids[fit][k], "l1_ratio": ratio, "inner_fold": g + 1, "score": errors, "converged": done[at * many + k]}
                rows.append(pd.DataFrame({"fit_id": repeat * splits + fit + 1, "kind": "score", **scored, "code": -1, "coef": 0.0}))
        best = [np.unravel_index(int(np.argmin(m)), m.shape) for m in means]
        paths, done = descend(
            np.stack([o.gram for o in outers]),
            np.stack([o.cross for o in outers]),
            np.stack([grids[fit][k] for fit, (k, _) in enumerate(best)]),
            np.array([ratios[k] for k, _ in best]),
            max_iter,
        )
        for fit, (k, step) in enumerate(best):
            beta = paths[fit, step]
            codes = np.concatenate([[-1], np.flatnonzero(beta)])
            values = np.concatenate([[outers[fit].mean_y - beta @ outers[fit].mean_x], beta[beta != 0]])
            chosen = {"alpha": grids[fit][k, step], "l1_ratio": ratios[k], "inner_fold": 0, "score": means[fit, k, step], "converged": bool(done[fit, step])}
            rows.append(pd.DataFrame({"fit_id": repeat * splits + fit + 1, "kind": "coef", **chosen, "code": codes, "coef": values}))
        return pd.concat(rows)

    return cells.groupBy("repeat").applyInPandas(run, SOLVED)
