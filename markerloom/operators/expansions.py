"""Logistic paths of many rows by shared expansions of the loss (V4, V5, V7).

Every fit of a repeated cross-validation learns from most of the same rows, so
with many rows all fits have nearly the same coefficients at a grid point. The
paths of all rows together are walked first, by scans. Around some of their
points, one scan adds up the loss, its gradient and its curvature by (repeat,
outer fold, inner fold, class) over all rows, and the third derivatives over all
rows together. A fit's training set is a sum of such cells, so its paths and the
log-likelihood of its inner folds follow from sums, without another scan.

What is left out is of fourth order in the distance from the expansion point.
It is estimated for every grid point; a point with an estimate above the
tolerance goes on from there by scans over its own rows, as with few rows.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators import paths
from markerloom.session import written

#: Rows from which expansions are tried, and features and coefficients of a problem up to which.
LEAST_ROWS, MOST_FEATURES, MOST_COEFFICIENTS = 300_000, 32, 160
#: Rows of a block, and rows whose products of three features are held at once.
BLOCK_ROWS, TRIPLED_ROWS = 8192, 1024
#: Numbers of a task's sums.
CELL_NUMBERS = 6_000_000
#: The paths of all rows only give the places of expansions.
PLACE_TOLERANCE = 2e-3
#: Linear predictors up to this size have no loss that would be cut off.
MOST_PREDICTOR = 15.0
#: Newton steps on an expansion, and problems solved together.
MOST_STEPS, TOGETHER = 12, 128
#: Factor of the estimate of what an expansion leaves out.
MARGIN = 2.0

BLOCKS = "n int, sizes binary, codes binary, y binary, folds binary, inner binary"
CELLS = "repeat int, fold int, place int, sums binary"
SOLVED = "fit int, place int, found binary"


def fitting(grid: paths.Grid, rows: int) -> bool:
    return (
        grid.family != paths.LINEAR
        and (grid.family == paths.BINARY or grid.joint)
        and rows >= LEAST_ROWS
        and grid.paired
        and grid.width <= MOST_FEATURES
        and grid.lanes * (grid.width + 1) <= MOST_COEFFICIENTS
        and grid.splits > 1
        and grid.inner_cv > 1
    )


def as_blocks(table: DataFrame) -> DataFrame:
    """Rows as arrays of bytes, so that a scan is spent on sums and not on reading them."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[begin : begin + BLOCK_ROWS]
                arrays = (
                    part["codes"].map(len).to_numpy().astype("u1"),
                    np.concatenate([np.zeros(0), *part["codes"]]).astype("u1"),
                    part["y"].to_numpy().astype("<f8"),
                    np.stack(part["fold_of"].to_numpy()).astype("<i2"),
                    np.stack(part["inner_of"].to_numpy()).astype("<i2"),
                )
                yield pd.DataFrame([(len(part), *(a.tobytes() for a in arrays))], columns=["n", "sizes", "codes", "y", "folds", "inner"])

    tasks = table.sparkSession.sparkContext.defaultParallelism
    return written(paths._lean(table).mapInPandas(pack, BLOCKS).repartition(4 * tasks), "blocks")


def batches(frame: pd.DataFrame, width: int) -> Iterator[paths._Batch]:
    """Blocks as dense rows, the intercept's column last."""
    for block in frame.itertuples():
        x = np.zeros((block.n, width + 1))
        x[:, -1] = 1.0
        x[np.repeat(np.arange(block.n), np.frombuffer(block.sizes, dtype="u1")), np.frombuffer(block.codes, dtype="u1")] = 1.0
        folds, inner = (np.frombuffer(raw, dtype="<i2").reshape(block.n, -1) for raw in (block.folds, block.inner))
        yield paths._Batch(x, np.frombuffer(block.y), folds, inner)


def _products(blocks: DataFrame, classes: int, width: int) -> np.ndarray:
    """Sums of products of two features by class over all rows: ``(class, feature + 1, feature + 1)``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros((classes, width + 1, width + 1))
        for frame in frames:
            for batch in batches(frame, width):
                for c in range(classes):
                    own = batch.x[batch.y == c]
                    whole[c] += own.T @ own
        yield pd.DataFrame({"sums": [whole.tobytes()]})

    found = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapInPandas(scan, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in found).reshape(classes, width + 1, width + 1)


@dataclass
class _Layout:
    """Which number of a cell is what; symmetric arrays are held once."""

    lanes: int
    q: int

    def __post_init__(self) -> None:
        k, q = self.lanes, self.q
        self.two = list(itertools.combinations_with_replacement(range(k), 2))
        self.three = list(itertools.combinations_with_replacement(range(k), 3))
        self.upper = np.triu_indices(q)
        self.size = 2 + k * q + len(self.two) * len(self.upper[0])
        # A product of 0/1 features is that of the distinct ones.
        sets = {frozenset(t) - {q - 1} for t in itertools.combinations_with_replacement(range(q), 3)}
        self.sets = sorted((tuple(sorted(s)) for s in sets), key=lambda s: (len(s), s))
        number = {frozenset(s): i for i, s in enumerate(self.sets)}
        self.triple = np.array([[[number[frozenset(t) - {q - 1}] for t in ((i, j, m) for m in range(q))] for j in range(q)] for i in range(q)])
        filled = np.array([s + (q - 1,) * (3 - len(s)) for s in self.sets])
        self.of_sets = filled[:, 0], filled[:, 1], filled[:, 2]

    def unpacked(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, loss, gradient and curvature of ``(..., number)``; the last two over lanes x features."""
        k, q = self.lanes, self.q
        end = 2 + k * q
        held = cells[..., end:].reshape(*cells.shape[:-1], len(self.two), -1)
        curve = np.zeros((*cells.shape[:-1], k, q, k, q))
        for n, (a, b) in enumerate(self.two):
            for i, j in ((a, b), (b, a)):
                curve[..., i, self.upper[0], j, self.upper[1]] = held[..., n, :]
                curve[..., i, self.upper[1], j, self.upper[0]] = held[..., n, :]
        return cells[..., 0], cells[..., 1], cells[..., 2:end], curve.reshape(*cells.shape[:-1], k * q, k * q)

    def third(self, sums: np.ndarray) -> np.ndarray:
        """Third derivatives ``(lane, set of features)`` as an array over lanes x features, three times."""
        k, q = self.lanes, self.q
        out = np.zeros((k, q, k, q, k, q))
        for n, lanes in enumerate(self.three):
            dense = sums[n][self.triple]
            for a, b, c in set(itertools.permutations(lanes)):
                out[a, :, b, :, c, :] = dense
        return out.reshape((k * q,) * 3)


def _derivatives(layout: _Layout, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss (row, place), slopes, curvatures and third derivatives (row, place, lanes) at ``eta (row, place, lane)``."""
    if layout.lanes == 1:
        loss, slope, curve = paths._row_terms(paths.BINARY, eta, y)
        return loss, slope, curve, curve * (1.0 - 2.0 * (slope + y[:, None, None]))
    p, whole = paths._softmax(eta)
    own = np.zeros((len(y), 1, layout.lanes))
    own[np.arange(len(y)), 0, y.astype(int)] = 1.0
    curve = [p[..., a] * ((a == b) - p[..., b]) for a, b in layout.two]
    # Third cumulants of a draw of one class.
    third = [p[..., a] * ((a == b == c) - p[..., b] * (b == c) - p[..., b] * (a == c) - p[..., c] * (a == b) + 2.0 * p[..., b] * p[..., c]) for a, b, c in layout.three]
    return whole - (eta * own).sum(axis=-1), p - own, np.stack(curve, axis=-1), np.stack(third, axis=-1)


class _Cells:
    """Sums of one task around some places."""

    def __init__(self, layout: _Layout, grid: paths.Grid, raw: np.ndarray, weight: np.ndarray, repeats: int) -> None:
        self.layout, self.grid, self.raw, self.weight, self.repeats = layout, grid, raw, weight, repeats
        self.classes, self.parts = len(weight), grid.splits * grid.inner_cv
        self.cells = np.zeros((repeats, self.parts * self.classes, len(raw), layout.size))
        self.third = np.zeros((self.classes, len(layout.sets), len(raw) * len(layout.three)))

    def add(self, batch: paths._Batch) -> None:
        layout, x, n, places = self.layout, batch.x, len(batch.y), len(self.raw)
        lanes, q = layout.lanes, layout.q
        eta = (x @ self.raw.reshape(-1, q).T).reshape(n, places, lanes)
        loss, slope, curve, third = _derivatives(layout, eta, batch.y)
        third, (one, two, three) = third.reshape(n, -1), layout.of_sets
        for c in range(self.classes):
            own = np.flatnonzero(batch.y == c)
            for begin in range(0, len(own), TRIPLED_ROWS):
                some = own[begin : begin + TRIPLED_ROWS]
                by_feature = np.ascontiguousarray(x[some].T)
                self.third[c] += (by_feature[one] * by_feature[two] * by_feature[three]) @ third[some]
        pairs = x[:, layout.upper[0]] * x[:, layout.upper[1]]
        slope, curve = slope.reshape(n, -1), curve.reshape(n, -1)
        end = 2 + lanes * q
        for repeat in range(self.repeats):
            part = (batch.folds[:, repeat] - 1) * self.grid.inner_cv + batch.inner[:, repeat] - 1
            key = part.astype(np.int64) * self.classes + batch.y.astype(np.int64)
            order = np.argsort(key, kind="stable")
            held = [a[order] for a in (x, pairs, loss, slope, curve)]
            numbers, starts = np.unique(key[order], return_index=True)
            for number, begin, stop in zip(numbers, starts, [*starts[1:], n], strict=True):
                own_x, own_pairs, own_loss, own_slope, own_curve = (a[begin:stop] for a in held)
                out = self.cells[repeat, number]
                out[:, 0] += stop - begin
                out[:, 1] += own_loss.sum(axis=0)
                out[:, 2:end] += (own_slope.T @ own_x).reshape(places, -1)
                out[:, end:] += (own_curve.T @ own_pairs).reshape(places, -1)

    def rows(self, first: int) -> Iterator[tuple[int, int, int, bytes]]:
        folds = self.cells.reshape(self.repeats, self.grid.splits, -1, len(self.raw), self.layout.size)
        # Weighted by class, and not.
        third = np.stack([np.tensordot(self.weight, self.third, 1), self.third.sum(axis=0)])
        third = third.reshape(2, len(self.layout.sets), len(self.raw), -1)
        for place in range(len(self.raw)):
            yield -1, -1, first + place, np.ascontiguousarray(third[:, :, place].swapaxes(1, 2)).tobytes()
            for repeat, fold in np.ndindex(*folds.shape[:2]):
                yield repeat, fold, first + place, np.ascontiguousarray(folds[repeat, fold, :, place]).tobytes()


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    whole = sum(np.frombuffer(raw) for raw in frame["sums"])
    return pd.DataFrame({**{name: [frame[name].iloc[0]] for name in ("repeat", "fold", "place")}, "sums": [whole.tobytes()]})


@dataclass
class Expansions:
    """Sums around places near the paths of all fits."""

    grid: paths.Grid
    layout: _Layout
    cells: DataFrame
    raw: np.ndarray  # (place, lane, feature + 1): coefficients of unscaled features
    nearest: np.ndarray  # (g > 0, l1, step): the place of a grid point
    start: np.ndarray  # (g > 0, l1, step, lane, feature + 1): unscaled, of all rows
    moment: np.ndarray  # weighted mean products of two features
    rows: int
    weighted: float  # sum of the weights
    blocks: DataFrame

    @classmethod
    def of(cls, table: DataFrame, grid: paths.Grid, rows: int, solved: paths.Solved) -> Expansions | None:
        classes, q = grid.class_weight.shape[1], grid.width + 1
        layout, blocks = _Layout(grid.lanes, q), as_blocks(table)
        tasks = table.sparkSession.sparkContext.defaultParallelism
        products = _products(blocks, classes, grid.width)
        counts = products[:, -1, -1]
        weight = grid.class_weight.mean(axis=0)
        weighted = float(weight @ counts)
        moment = np.tensordot(weight, products, 1) / weighted
        share = np.diagonal(products.sum(axis=0))[:-1] / rows
        sd = np.sqrt(share * (1.0 - share))
        scale = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
        # Outer training sets and inner ones have different penalties; the walk goes between them.
        sides = np.log([grid.penalty[:, 0].mean(axis=0), grid.penalty[:, 1:].mean(axis=(0, 1))])
        penalty = np.exp(sides.mean(axis=0))[None, None]
        whole = paths.Grid(
            grid.family, 1, 0, grid.l1_ratios, penalty, np.full((1, 1), weighted), scale[None], weight[None],
            tolerance=PLACE_TOLERANCE, most_rounds=grid.most_rounds, all_rows=True,
        )
        shape = penalty.shape
        out = paths.Solved(np.full(shape, np.nan), np.zeros(shape, dtype=bool), [], np.zeros(1), np.zeros(0))
        walked = paths._walk(_dealt(blocks), whole, range(1), out)[0, :, 0] * np.append(scale, 1.0)
        start = _between(walked, sides)
        solved.scans += out.scans + 1
        if np.abs(start).sum(axis=-1).max() > MOST_PREDICTOR:
            return None
        raw, nearest = _places(start, moment, rows, grid)
        sums, chunk = [], max(1, CELL_NUMBERS // _numbers(layout, grid, classes))
        for first in range(0, len(raw), chunk):
            sums.append(_scanned(blocks.coalesce(tasks), layout, grid, raw[first : first + chunk], weight, first))
        together = sums[0]
        for more in sums[1:]:
            together = together.unionAll(more)
        cells = written(together.groupBy("repeat", "fold", "place").applyInPandas(_added, CELLS), "cells")
        solved.scans += len(sums)
        return cls(grid, layout, cells, raw, nearest, start, moment, rows, weighted, blocks)

    def solve(self, fits: range, out: paths.Solved) -> np.ndarray:
        """Paths of some fits as ``paths._walk`` has them."""
        grid, spark = self.grid, self.cells.sparkSession
        splits = grid.splits
        learning = F.filter(
            F.sequence(F.lit(fits.start), F.lit(fits.stop - 1)),
            lambda fit: (F.col("repeat") < 0) | ((F.floor(fit / splits) == F.col("repeat")) & (fit % splits != F.col("fold"))),
        )
        cells, sent = self.cells, spark.sparkContext.broadcast(replace(self, cells=None, blocks=None))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            fit, place = int(frame["fit"].iloc[0]), int(frame["place"].iloc[0])
            own = frame[frame["repeat"] >= 0]
            third = frame[frame["repeat"] < 0]["sums"].iloc[0]
            found = sent.value._solved(fit, place, [np.frombuffer(raw) for raw in own["sums"]], np.frombuffer(third))
            return pd.DataFrame({"fit": [fit], "place": [place], "found": [pickle.dumps(found)]})

        tasks = spark.sparkContext.defaultParallelism
        dealt = cells.withColumn("fit", F.explode(learning)).repartition(8 * tasks, "fit", "place")
        shape = (len(fits), len(grid.l1_ratios), paths._kept_sets(grid), grid.penalty.shape[3], grid.lanes, grid.width + 1)
        kept, open_ = np.zeros(shape), {}
        for row in dealt.groupBy("fit", "place").applyInPandas(run, SOLVED).collect():
            g, k, step, beta, done, score = pickle.loads(row["found"])
            saved = g < shape[2]
            kept[row["fit"] - fits.start, k[saved], g[saved], step[saved]] = beta[saved]
            out.converged[row["fit"], g, k, step] = done
            if grid.family != paths.BINARY:
                out.score[row["fit"], g, k, step] = score
            if not done.all():
                open_.setdefault(row["fit"], []).append([a[~done] for a in (g, k, step, beta)])
        sent.destroy()
        points = [(fit, *(np.concatenate(a) for a in zip(*open_[fit], strict=True))) for fit in sorted(open_)]
        for fit, g, k, step, beta in paths.settled(_dealt(self.blocks), grid, points, out):
            saved = g < shape[2]
            kept[fit - fits.start, k[saved], g[saved], step[saved]] = beta[saved]
        return kept

    def _solved(self, fit: int, place: int, folds: list[np.ndarray], third: np.ndarray) -> tuple[np.ndarray, ...]:
        """All points of a fit near one place: their training set, l1 ratio and step, coefficients, mark and score."""
        grid, layout = self.grid, self.layout
        weight = grid.class_weight[fit]
        cells = sum(folds).reshape(grid.inner_cv, len(weight), layout.size)
        inner = np.tensordot(cells, weight, axes=(1, 0))
        sets = np.concatenate([inner.sum(axis=0, keepdims=True), inner.sum(axis=0) - inner])
        weighted, plain = third.reshape(2, len(layout.three), -1)
        third = layout.third(weighted) / self.weighted
        _, _, slope, curve = layout.unpacked(sets / grid.total[fit][:, None])
        if grid.family != paths.BINARY:
            held, plain = layout.unpacked(cells.sum(axis=1)), layout.third(plain) / self.rows
        near = np.argwhere(self.nearest == place)
        points = np.array([(g, k, step) for side, k, step in near for g in (range(1, grid.inner_cv + 1) if side else (0,))])
        parts = []
        for begin in range(0, len(points), TOGETHER):
            g, k, step = points[begin : begin + TOGETHER].T
            beta, done, away = self._near(fit, place, g, k, step, slope, curve, third)
            score = np.full(len(g), np.nan)
            if grid.family != paths.BINARY:
                # No rows are held out where nothing is left out.
                rows, loss, first, second = (np.concatenate([np.zeros_like(a[:1]), a])[g] for a in held)
                bent = 0.5 * second + np.maximum(rows, 1.0)[:, None, None] * _along(plain, away) / 6.0
                change = np.einsum("pi,pi->p", first, away) + np.einsum("pi,pij,pj->p", away, bent, away)
                score = -(loss + change) / np.maximum(rows, 1.0)
            parts.append((g, k, step, beta, done, score))
        return tuple(np.concatenate(a) for a in zip(*parts, strict=True))

    def _near(self, fit: int, place: int, g: np.ndarray, k: np.ndarray, step: np.ndarray, slope: np.ndarray, curve: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimisers (scaled), whether they are accurate, and how far they are from the place (unscaled)."""
        grid, lanes, q = self.grid, self.layout.lanes, self.layout.q
        scale, bias = np.tile(np.append(grid.scale[fit], 1.0), lanes), np.arange(lanes * q) % q == grid.width
        ratio, penalty, at = grid.l1_ratios[k], grid.penalty[fit, g, k, step], self.raw[place].ravel()
        soft, ridge = (np.where(bias, 0.0, share[:, None]) for share in (penalty * ratio, penalty * (1.0 - ratio)))
        known = self.start[(g > 0).astype(int), k, step].reshape(len(g), -1)
        beta = np.where(scale > 0, known / np.where(scale > 0, scale, 1.0), 0.0)
        for _ in range(MOST_STEPS):
            away = beta * scale - at
            bent = _along(third, away)
            hessian = (curve[g] + bent) * scale[:, None] * scale
            gradient = slope[g] + np.einsum("pij,pj->pi", curve[g] + 0.5 * bent, away)
            if grid.joint:
                hessian += (bias[:, None] & bias) / lanes**2
            left = np.einsum("pij,pj->pi", hessian, beta) - gradient * scale
            new = paths.coordinate_descent(hessian, left, beta, soft, ridge, lanes if grid.joint else 1)
            if grid.joint:
                by_class = new.reshape(len(g), lanes, q)
                new = (by_class - paths._shift(by_class, ratio)[:, None, :]).reshape(len(g), -1)
            moved, beta = np.abs(new - beta).max(axis=1), new
            limit = grid.tolerance * np.maximum(1.0, np.abs(beta).max(axis=1))
            if not (moved > 0.1 * limit).any():
                break
        away = beta * scale - at
        done = (moved <= limit) & (self._left_out(away, curve[g], scale) <= limit)
        # What went astray is walked from where all rows are.
        beta = np.where(np.isfinite(beta).all(axis=1, keepdims=True), beta, known * (scale > 0) / np.where(scale > 0, scale, 1.0))
        return beta.reshape(len(g), lanes, q), done, away

    def _left_out(self, away: np.ndarray, curve: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimate of how far the fourth derivatives, and third ones of a part of the rows, move a coefficient.

        With steps d of the linear predictor that are about normal over the rows,
        the former shift the gradient by half the fourth cumulant times E[d^2] times
        the step itself; the latter differ from those of all rows by chance.
        """
        lanes, q = self.layout.lanes, self.layout.q
        steps = away.reshape(-1, lanes, q)
        if lanes > 1:
            steps = steps - steps.mean(axis=1, keepdims=True)
        square = np.einsum("pki,ij,pkj->pk", steps, self.moment, steps)
        last = np.arange(lanes) * q + q - 1
        spread = np.maximum(curve[:, last, last], 1e-12)
        if lanes == 1:
            fourth = square / 8.0
        else:
            p = 0.5 - np.sqrt(np.maximum(0.25 - spread, 0.0))
            a, b = p[:, :, None], p[:, None, :]
            both = np.where(np.eye(lanes, dtype=bool), (spread * np.abs(1.0 - 6.0 * spread))[:, :, None], a * b * np.abs(1.0 - 2.0 * (a + b) + 6.0 * a * b))
            fourth = np.einsum("pkl,pl->pk", both, square)
        by_lane = np.abs(steps / np.where(scale > 0, scale, np.inf).reshape(lanes, q)).max(axis=(1, 2))
        chance = 0.05 * square.max(axis=1) / spread.min(axis=1) / np.sqrt(self.rows)
        return MARGIN * ((0.5 * fourth / spread).max(axis=1) * by_lane + chance)


def _dealt(blocks: DataFrame) -> paths._Dealt:
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    return paths._Dealt(blocks.withColumn("part", F.lit(0)).coalesce(tasks), 1, tasks)


def _along(third: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Third derivatives along steps: ``(step, i, j)``."""
    return (away @ third.reshape(len(third), -1)).reshape(len(away), len(third), len(third))


def _between(walked: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Points ``(l1, step, ...)`` of paths walked at the mean of two logarithmic penalties, moved to both."""
    if sides.shape[2] == 1:
        return np.stack([walked, walked])
    middle = sides.mean(axis=0)
    out = []
    for side in sides:
        step = np.arange(sides.shape[2])
        # A smaller penalty is towards the next step; at an end, the last two steps go on.
        begin = np.clip(np.where(side < middle, step, step - 1), 0, sides.shape[2] - 2)
        low, high = np.take_along_axis(middle, begin, axis=1), np.take_along_axis(middle, begin + 1, axis=1)
        share = ((side - low) / (high - low))[..., None, None]
        k = np.arange(len(walked))[:, None]
        out.append((1.0 - share) * walked[k, begin] + share * walked[k, begin + 1])
    return np.stack(out)


def _places(start: np.ndarray, moment: np.ndarray, rows: int, grid: paths.Grid) -> tuple[np.ndarray, np.ndarray]:
    """Few of the points, so that each is near one, and the number of each point's nearest.

    Near is a third of what training sets differ by chance.
    """
    lanes, q = grid.lanes, grid.width + 1
    flat = start.reshape(-1, lanes, q)
    centred = flat - flat.mean(axis=1, keepdims=True) if lanes > 1 else flat
    values, vectors = np.linalg.eigh(moment)
    at = (centred @ (vectors * np.sqrt(np.maximum(values, 0.0)))).reshape(len(flat), -1)
    square = (at * at).sum(axis=1)
    distance = np.maximum(square[:, None] + square[None, :] - 2.0 * at @ at.T, 0.0)
    share = (1 - 1 / grid.splits) * (1 - 1 / grid.inner_cv)
    free, spread = (1, 0.25) if lanes == 1 else (lanes - 1, (1 - 1 / lanes) / lanes)
    near = distance <= free / 9 * q * (1 / share - 1) / (rows * spread)
    chosen, open_ = [], np.ones(len(flat), dtype=bool)
    while open_.any():
        chosen.append(int((near & open_).sum(axis=1).argmax()))
        open_ &= ~near[chosen[-1]]
    nearest = distance[:, chosen].argmin(axis=1)
    used, nearest = np.unique(nearest, return_inverse=True)
    return flat[np.array(chosen)[used]], nearest.reshape(start.shape[:3])


def _numbers(layout: _Layout, grid: paths.Grid, classes: int) -> int:
    """Numbers that a task holds for a place."""
    cells = grid.fits * grid.inner_cv * classes * layout.size
    return cells + classes * len(layout.sets) * len(layout.three)


def _scanned(blocks: DataFrame, layout: _Layout, grid: paths.Grid, raw: np.ndarray, weight: np.ndarray, first: int) -> DataFrame:
    """Sums of every task around the places ``raw``, numbered from ``first``."""
    repeats = grid.fits // grid.splits

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            for batch in batches(frame, grid.width):
                held = held or _Cells(layout, grid, raw, weight, repeats)
                held.add(batch)
        for row in held.rows(first) if held else ():
            yield pd.DataFrame([row], columns=["repeat", "fold", "place", "sums"])

    return blocks.mapInPandas(scan, CELLS)
