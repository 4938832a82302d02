"""Elastic-net paths of all fits at once, by shared scans (V4-V7).

A repeated nested cross-validation asks for one path per outer fit, inner fold
left out and l1 ratio. Here all of them walk down the penalties together. A
step is a few rounds; a round is one scan of the vectors, in which every task
adds up, for all open problems, the gradient over all features and the weighted
sums of products of each problem's working set. Sums are added by group of fits,
where a coordinate descent on the quadratic model gives the next coefficients.
The number of scans grows with the steps of the path, not with the fits or the
l1 ratios.

Up to ``WORKING_SET`` features every problem works on all of them. Beyond it,
the sequential strong rule names the features that may enter at a step, and the
gradient of the next scan checks all the others; a problem is done only if none
of them violates its condition. If more features compete than the working set
holds, those with the largest violations go first, and further rounds follow.

Classes of a multiclass problem are solved for together while that is small;
beyond it each class moves by itself, by a bound of the joint curvature.

Features are scaled by 1 / SD of the outer training set and not centred; the
intercept is not penalised. Lanes are (problem, class) pairs; a linear or binary
net has one lane per problem.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from markerloom.operators import expansions
from markerloom.session import written

#: Features of a problem that are solved for at once.
WORKING_SET = 256
#: Up to so many features, sums of products of all lanes come from one matrix product over pairs of features.
PAIRED = 64
#: Up to so many lanes of a fit are multiplied one by one instead.
FEW_LANES = 12
#: Numbers held at once: of dense rows, of a task's sums, and of the paths of the fits that walk together.
ROW_NUMBERS, SUM_NUMBERS, WAVE_NUMBERS = 4_000_000, 24_000_000, 16_000_000
MOST_ROWS = 4096
#: Rows that a task of a scan has at least, as far as there are as many.
ROWS_IN_TASK = 50_000
#: Sweeps of the coordinate descent between two outright solutions, and at most.
SWEEPS, MOST_SWEEPS, MOST_JOINT_SWEEPS = 4, 2000, 40
#: The largest loss of a row that counts for a score: that of the least probability told apart from 0.
MOST_LOSS = -math.log(2.220446049250313e-16)
#: Scores of held-out rows of a point that one task ranks; more are split by ranges of the score.
RANKED_TOGETHER = 1_000_000
SUMS = "unit int, sums binary"
AREAS = "fit int, inner_fold int, point int, bucket int, positives long, negatives long, wins double"

LINEAR, BINARY, MULTICLASS = "linear", "binary", "multiclass"


@dataclass
class Grid:
    """What is to be solved: ``penalty[fit, g, l1, step]`` falls with the step; ``g`` 0 leaves no inner fold out."""

    family: str
    splits: int
    inner_cv: int
    l1_ratios: np.ndarray
    penalty: np.ndarray
    total: np.ndarray  # (fit, g): sum of the weights of the training rows
    scale: np.ndarray  # (fit, feature): 1 / SD, 0 for a constant feature
    class_weight: np.ndarray  # (fit, class); ones for a linear net
    spread: float = 1.0  # unit of the outcome, for the tolerance
    tolerance: float = 1e-7  # a problem is done when its model moves no coefficient by more
    most_rounds: int = 200  # of a step; a problem still open then is marked
    working_set: int = field(default_factory=lambda: WORKING_SET)
    all_rows: bool = False  # no fit leaves an outer fold out
    paired: bool = field(init=False)  # sums of products come from pairs of features

    def __post_init__(self) -> None:
        self.paired = self.width <= min(PAIRED, self.working_set)

    @property
    def lanes(self) -> int:
        return self.class_weight.shape[1] if self.family == MULTICLASS else 1

    @property
    def joint(self) -> bool:
        """Whether all classes of a problem are solved for together, by their true curvature."""
        return self.family == MULTICLASS and self.paired and self.lanes * (self.width + 1) <= self.working_set

    @property
    def fits(self) -> int:
        return len(self.scale)

    @property
    def width(self) -> int:
        return self.scale.shape[1]


@dataclass
class Solved:
    """``score`` and ``converged`` by (fit, g, l1, step), the chosen point and the coefficients of each fit."""

    score: np.ndarray
    converged: np.ndarray
    best: list[tuple[int, int]]  # (l1, step)
    mean_score: np.ndarray
    coef: np.ndarray  # (fit, lane, feature + 1), scaled, the intercept last
    scans: int = 0


@dataclass
class _Open:
    """The open problems of one fit in a round."""

    fit: int
    g: np.ndarray  # (problem,)
    ratio: np.ndarray
    at: np.ndarray  # number of the l1 ratio
    penalty: np.ndarray
    following: np.ndarray  # penalty of the next step
    beta: np.ndarray  # (problem, lane, feature + 1), scaled
    before: np.ndarray  # the last accepted ones
    objective: np.ndarray  # at ``before``; infinite at the start of a step
    working: np.ndarray | None  # (problem, lane, place): features, -1 for none; None for all

    @property
    def size(self) -> int:
        return len(self.g)

    def shapes(self, grid: Grid) -> list[tuple[int, ...]]:
        """Of the sums of gradients, of products, of the loss, and of loss and number of held-out rows."""
        lanes, q = self.size * grid.lanes, grid.width + 1
        inside = q if self.working is None else self.working.shape[2] + 1
        products = (self.size, grid.lanes * q, grid.lanes * q) if grid.joint else (lanes, inside, inside)
        return [(lanes, q), products, (self.size,), (self.size,), (self.size,)]

    def numbers(self, grid: Grid) -> int:
        return sum(math.prod(s) for s in self.shapes(grid))


@dataclass
class _Answer:
    beta: np.ndarray
    worse: np.ndarray  # the objective rose; ``beta`` is half the way back
    objective: np.ndarray
    working: np.ndarray | None
    done: np.ndarray
    held: np.ndarray  # mean loss over the inner fold left out


@dataclass
class _Batch:
    """Some rows as dense arrays, the intercept's column last."""

    x: np.ndarray
    y: np.ndarray
    folds: np.ndarray
    inner: np.ndarray
    ids: list = field(default_factory=list)


def _batches(frames: Iterator[pd.DataFrame], width: int) -> Iterator[_Batch]:
    rows = min(MOST_ROWS, max(64, ROW_NUMBERS // (width + 1)))
    for frame in frames:
        for begin in range(0, len(frame), rows):
            part = frame.iloc[begin : begin + rows]
            x = np.zeros((len(part), width + 1))
            x[:, -1] = 1.0
            sizes = part["codes"].map(len).to_numpy()
            x[np.repeat(np.arange(len(part)), sizes), np.concatenate([np.zeros(0, dtype=np.int64), *part["codes"]]).astype(np.int64)] = 1.0
            ids = part["sample_id"].tolist() if "sample_id" in part else []
            yield _Batch(x, part["y"].to_numpy(dtype=float), np.stack(part["fold_of"].to_numpy()), np.stack(part["inner_of"].to_numpy()), ids)


def _lean(table: DataFrame, *more: str) -> DataFrame:
    codes = F.unwrap_udt("features").getField("indices").alias("codes")
    return table.select("y", codes, "fold_of", "inner_of", *more)


@dataclass
class _Dealt:
    """The rows for all scans. Each of ``parts`` has all rows, in ``ranges`` tasks, and works on a share of the fits.

    Many rows are dealt over all tasks and each task adds up for all fits; then
    there is one part. With few rows that would only move sums, so the rows are
    repeated and the fits are dealt.
    """

    rows: DataFrame
    parts: int
    ranges: int

    @classmethod
    def of(cls, table: DataFrame, fits: int) -> _Dealt:
        tasks = table.sparkSession.sparkContext.defaultParallelism
        ranges = max(1, -(-table.count() // ROWS_IN_TASK))
        if 2 * ranges > tasks:
            return cls(_lean(table).withColumn("part", F.lit(0)).coalesce(tasks), 1, tasks)
        parts = min(tasks // ranges, fits)
        # Numbers that hashing deals to one task each.
        number = F.pmod(F.hash("id"), F.lit(parts * ranges))
        known = table.sparkSession.range(200 * parts * ranges).groupBy(number.alias("task")).agg(F.min("id").alias("id"))
        ids = [r["id"] for r in known.orderBy("task").collect()]
        copied = _lean(table).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        share = F.pmod(F.xxhash64("codes", "y", "fold_of"), F.lit(ranges))
        key = F.element_at(F.lit(ids), (F.col("part") * ranges + share).cast("int") + 1)
        return cls(written(copied.withColumn("task", key).repartition(parts * ranges, "task"), "dealt").persist(StorageLevel.MEMORY_AND_DISK), parts, ranges)


def _softmax(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities over the last axis, and the logarithm of the sum of exponentials."""
    top = eta.max(axis=-1, keepdims=True)
    e = np.exp(eta - top)
    whole = e.sum(axis=-1, keepdims=True)
    return e / whole, (top + np.log(whole))[..., 0]


def _row_terms(family: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss (row, problem), and slope and curvature (row, problem, lane) of unweighted rows; ``eta`` likewise.

    The curvature of several classes is a bound on their joint one, so lanes can
    move at the same time: diag(p) or 2 diag(p (1 - p)), whichever is less.
    """
    if family == LINEAR:
        miss = eta - y[:, None, None]
        return 0.5 * miss[..., 0] ** 2, miss, np.ones_like(miss)
    if family == BINARY:
        p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
        loss = np.logaddexp(0.0, eta[..., 0]) - y[:, None] * eta[..., 0]
        return loss, p - y[:, None, None], p * (1.0 - p)
    p, whole = _softmax(eta)
    own = np.zeros((len(y), 1, eta.shape[2]))
    own[np.arange(len(y)), 0, y.astype(int)] = 1.0
    loss = whole - (eta * own).sum(axis=-1)
    sharp = (p * p).sum(axis=-1, keepdims=True) > 0.5
    return loss, p - own, np.where(sharp, 2.0 * p * (1.0 - p), p)


@dataclass
class _Model:
    """Quadratic models of the lanes of one fit, over their working sets with the intercept last."""

    hessian: np.ndarray
    left: np.ndarray
    start: np.ndarray
    soft: np.ndarray
    ridge: np.ndarray


class _Sums:
    """Sums over rows for the open problems of one fit: flat, so that they add up as one array."""

    def __init__(self, grid: Grid, own: _Open) -> None:
        self.grid, self.own = grid, own
        self.shapes = own.shapes(grid)
        self.flat = np.zeros(own.numbers(grid))
        self.scale = np.append(grid.scale[own.fit], 1.0)
        lanes, q = self.shapes[0]
        if grid.joint:
            lanes, q, self.scale = own.size, grid.lanes * q, np.tile(self.scale, grid.lanes)
        if own.working is None:
            self.places, self.absent = np.broadcast_to(np.arange(q), (lanes, q)), np.zeros((lanes, q), dtype=bool)
        else:
            # Empty places take the first feature; the solver leaves them out.
            tail = np.full((lanes, 1), grid.width)
            held = own.working.reshape(lanes, -1)
            self.places = np.concatenate([np.maximum(held, 0), tail], axis=1)
            self.absent = np.concatenate([held < 0, tail < 0], axis=1)

    def views(self) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            size = int(np.prod(shape))
            out.append(self.flat[at : at + size].reshape(shape))
            at += size
        return out

    def add(self, batch: _Batch, pairs: np.ndarray | None) -> None:
        grid, own = self.grid, self.own
        repeat, fold = divmod(own.fit, grid.splits)
        train = slice(None) if grid.all_rows else batch.folds[:, repeat] != fold + 1
        x, y = batch.x[train], batch.y[train]
        if not len(y):
            return
        gradient, products, loss, held, held_n = self.views()
        used = batch.inner[train, repeat][:, None] != own.g[None, :]
        raw = (own.beta * self.scale[: grid.width + 1]).reshape(gradient.shape).T
        eta = (x @ raw).reshape(len(y), own.size, grid.lanes)
        each, slope, curve = _row_terms(grid.family, eta, y)
        weight = grid.class_weight[own.fit][y.astype(int)] if grid.family != LINEAR else np.ones(len(y))
        within = used * weight[:, None]
        loss += (each * within).sum(axis=0)
        scored = each if grid.family == LINEAR else np.minimum(each, MOST_LOSS)
        held += (scored * ~used).sum(axis=0)
        held_n += (~used).sum(axis=0)
        gradient += (x.T @ (slope * within[:, :, None]).reshape(len(y), -1)).T
        if grid.joint:
            self._add_joint(products, pairs[train], _softmax(eta)[0], within)
            return
        curve = (curve * within[:, :, None]).reshape(len(y), -1)
        if pairs is not None and curve.shape[1] <= FEW_LANES:
            # Cheaper than taking the training rows' pairs.
            for lane in range(curve.shape[1]):
                products[lane] += np.triu((x * curve[:, lane : lane + 1]).T @ x)
        elif pairs is not None:
            upper = np.triu_indices(products.shape[1])
            products[:, upper[0], upper[1]] += (pairs[train].T @ curve).T
        else:
            for lane in range(curve.shape[1]):
                part = x if own.working is None else x[:, self.places[lane]]
                products[lane] += (part * curve[:, lane : lane + 1]).T @ part

    def _add_joint(self, products: np.ndarray, pairs: np.ndarray, p: np.ndarray, within: np.ndarray) -> None:
        """Blocks of two classes: sums of products weighted by p_k (1 - p_k) or -p_k p_l."""
        q, size = self.grid.width + 1, within.shape[1]
        upper = np.triu_indices(q)
        both = [(k, m) for k in range(self.grid.lanes) for m in range(k, self.grid.lanes)]
        # One product for all blocks, so that the pairs are read once.
        by_lane, weight = np.ascontiguousarray(p.transpose(2, 0, 1)), np.empty((len(within), len(both), size))
        inside = by_lane * within
        for n, (k, m) in enumerate(both):
            np.multiply(inside[k], (1.0 - by_lane[m]) if k == m else -by_lane[m], out=weight[:, n])
        sums = (weight.reshape(len(within), -1).T @ pairs).reshape(len(both), size, -1)
        for found, (k, m) in zip(sums, both, strict=True):
            block = products[:, k * q : (k + 1) * q, m * q : (m + 1) * q]
            block[:, upper[0], upper[1]] += found
            if k != m:
                off = upper[0] != upper[1]
                block[:, upper[1][off], upper[0][off]] += found[:, off]

    def _mean_gradient(self) -> np.ndarray:
        own = self.own
        per = len(self.absent) // own.size
        by_lane = np.repeat(self.grid.total[own.fit][own.g], per)[:, None]
        return self.views()[0].reshape(len(self.absent), -1) / by_lane * self.scale

    def model(self) -> _Model:
        """The quadratic models at the scanned coefficients."""
        grid, own, absent = self.grid, self.own, self.absent
        products = self.views()[1]
        if grid.paired:
            products = products + np.triu(products, 1).swapaxes(1, 2)
        near = np.where(absent, 0.0, self.scale[self.places])
        per, bias = len(absent) // own.size, self.places % (grid.width + 1) == grid.width
        by_lane = np.repeat(grid.total[own.fit][own.g], per)[:, None, None]
        hessian = products / by_lane * near[:, :, None] * near[:, None, :]
        soft = np.where(bias, 0.0, np.repeat(own.penalty * own.ratio, per)[:, None])
        ridge = np.where(bias, 0.0, np.repeat(own.penalty * (1 - own.ratio), per)[:, None])
        if grid.joint:
            # Intercepts that rise together change nothing; they stay centred.
            hessian += (bias[:, :, None] & bias[:, None, :]) / grid.lanes**2
        rows = np.arange(len(absent))[:, None]
        start = np.where(absent, 0.0, own.beta.reshape(len(absent), -1)[rows, self.places])
        left = np.einsum("lij,lj->li", hessian, start) - np.where(absent, 0.0, self._mean_gradient()[rows, self.places])
        return _Model(hessian, left, start, soft, ridge)

    def answer(self, solved: np.ndarray) -> _Answer:
        """What the next round goes on from, given the models' minimisers."""
        grid, own, absent = self.grid, self.own, self.absent
        _, _, loss, held, held_n = self.views()
        total = grid.total[own.fit][own.g]
        slopes = own.beta[..., :-1]
        lam, ratio = own.penalty[:, None, None], own.ratio[:, None, None]
        objective = loss / total + (lam * (ratio * np.abs(slopes) + 0.5 * (1 - ratio) * slopes**2)).sum(axis=(1, 2))
        worse = np.isfinite(own.objective) & (objective > own.objective + 1e-10 * np.maximum(1.0, np.abs(own.objective)))
        flat = own.beta.reshape(len(absent), -1).copy()
        lane, place = np.nonzero(~absent)
        flat[lane, self.places[lane, place]] = solved[lane, place]
        beta, working = flat.reshape(own.beta.shape), None
        if grid.family == MULTICLASS:
            beta = beta - _shift(beta, own.ratio)[:, None, :]
        size = np.maximum(grid.spread, np.abs(own.beta).max(axis=(1, 2)))
        settled = np.abs(beta - own.beta).max(axis=(1, 2)) <= grid.tolerance * size
        if own.working is not None:
            gradient = self._mean_gradient().reshape(own.beta.shape)[..., :-1]
            inside = np.zeros(own.beta.shape, dtype=bool).reshape(len(absent), -1)
            inside[lane, self.places[lane, place]] = True
            inside = inside.reshape(own.beta.shape)[..., :-1]
            pull = self._pull(gradient, own.penalty)
            outside = np.where(inside, 0.0, pull).max(axis=(1, 2))
            settled &= outside <= 0.1 * grid.tolerance * (size + own.penalty * own.ratio)
            # A problem that is done goes on with the next step's penalty, and with what may enter there.
            limit = np.where(settled, 2 * own.following - own.penalty, own.penalty) * own.ratio
            after = self._pull(gradient, np.where(settled, own.following, own.penalty))
            after = np.where(inside & ~settled[:, None, None], 0.0, after)
            kept = (np.where(settled[:, None, None], own.beta, beta)[..., :-1] != 0) | (slopes != 0)
            working = self._chosen(kept | (np.abs(gradient) >= limit[:, None, None]), after)
        done, back = settled & ~worse, worse[:, None, None]
        following = np.where(done[:, None, None], own.beta, np.where(back, 0.5 * (own.before + own.beta), beta))
        return _Answer(following, worse, np.where(worse, own.objective, objective), working, done, held / np.maximum(held_n, 1))

    def _pull(self, gradient: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """How far every feature is from its condition at the scanned coefficients."""
        own, slopes = self.own, self.own.beta[..., :-1]
        lam, ratio = penalty[:, None, None], own.ratio[:, None, None]
        bent = np.abs(gradient + lam * (ratio * np.sign(slopes) + (1 - ratio) * slopes))
        free = np.maximum(np.abs(gradient) - lam * ratio, 0.0)
        return np.where(self.grid.scale[own.fit] > 0, np.where(slopes != 0, bent, free), 0.0)

    def _chosen(self, wanted: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """Features to work on next; of too many, those that are farthest from their condition."""
        wanted = wanted & (self.grid.scale[self.own.fit] > 0)
        size = min(self.grid.working_set, max(1, int(wanted.sum(axis=2).max(initial=0))))
        order = np.argsort(-np.where(wanted, pull, -1.0), axis=2, kind="stable")[..., :size]
        return np.where(np.take_along_axis(wanted, order, axis=2), order, -1)


def _shift(beta: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What to take from all classes of a feature, as ``(problem, feature + 1)``.

    It changes no probability, so rounds do not find it; it is where the penalty
    of the feature is least. The intercepts are centred.
    """
    classes = beta.shape[1]
    mean = beta.mean(axis=1)
    l1, l2 = ratio[:, None, None], 1.0 - ratio[:, None, None]
    above = np.arange(classes, -classes - 1, -2)[None, :, None]
    # The least is at a coefficient or where the slope between two of them is 0.
    flat = mean[:, None, :] + l1 * above / (np.maximum(l2, 1e-12) * classes)
    tried = np.concatenate([beta, np.where(l2 > 0, flat, beta[:, :1]), np.zeros((len(beta), 1, beta.shape[2]))], axis=1)
    away = beta[:, None] - tried[:, :, None]
    cost = (l1[..., None] * np.abs(away) + 0.5 * l2[..., None] * away * away).sum(axis=2)
    # Zero is tried last and kept if nothing is better by more than rounding.
    least = cost.argmin(axis=1)
    best = np.take_along_axis(tried, least[:, None], axis=1)[:, 0]
    gain = cost[:, -1] - np.take_along_axis(cost, least[:, None], axis=1)[:, 0]
    out = np.where(gain > 1e-15 * np.maximum(cost[:, -1], 1e-300), best, 0.0)
    out[:, -1] = mean[:, -1]
    return out


def coordinate_descent(hessian: np.ndarray, left: np.ndarray, start: np.ndarray, soft: np.ndarray, ridge: np.ndarray, classes: int = 1) -> np.ndarray:
    """Minimisers of b'Hb/2 - left'b + soft |b| + ridge b^2/2 for many lanes at once: ``(lane, place)``.

    Every few sweeps the equations of the non-zero places are solved outright; a
    lane goes there, or as far as no sign changes. What a further sweep does not
    move is the minimiser. Lanes that hold several ``classes`` are shifted as well,
    as sweeps creep along what only the penalty bends.
    """
    b, open_ = start.copy(), np.arange(len(start))
    ratio = soft[:, 0] / np.maximum(soft[:, 0] + ridge[:, 0], 1e-300)
    limit = 1e-11 * np.maximum(np.abs(left).max(axis=1, initial=0.0), 1e-300)
    for _ in range((MOST_SWEEPS if classes == 1 else MOST_JOINT_SWEEPS) // SWEEPS):
        own = (hessian[open_], left[open_], b[open_], soft[open_], ridge[open_])
        found, moved = _sweeps(*own)
        done = moved <= limit[open_]
        if classes > 1:
            by_class = found.reshape(len(found), classes, -1)
            found = (by_class - _shift(by_class, ratio[open_])[:, None, :]).reshape(found.shape)
        b[open_] = np.where(done[:, None], found, _polished(own[0], own[1], found, own[3], own[4]))
        open_ = open_[~done]
        if not len(open_):
            break
    return b


def _sweeps(hessian: np.ndarray, left: np.ndarray, b: np.ndarray, soft: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few sweeps over the places, and how far the last one moved each lane."""
    b, rest = b.copy(), left - np.einsum("lij,lj->li", hessian, b)
    diagonal = np.einsum("ljj->lj", hessian)
    bottom = diagonal + ridge
    over = np.where(diagonal > 0, 1.0 / np.where(bottom > 0, bottom, 1.0), 0.0)
    scale = np.sqrt(np.maximum(diagonal, 0.0))
    columns = np.ascontiguousarray(hessian.transpose(2, 0, 1))
    for _ in range(SWEEPS):
        largest = np.zeros(len(b))
        for j in range(b.shape[1]):
            rho = rest[:, j] + diagonal[:, j] * b[:, j]
            new = (np.maximum(rho - soft[:, j], 0.0) + np.minimum(rho + soft[:, j], 0.0)) * over[:, j]
            change = new - b[:, j]
            if change.any():
                rest -= columns[j] * change[:, None]
                b[:, j] = new
                np.maximum(largest, np.abs(change) * scale[:, j], out=largest)
        if not largest.any():
            break
    return b, largest


def _polished(hessian: np.ndarray, left: np.ndarray, b: np.ndarray, soft: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    active = b != 0
    both = active[:, :, None] & active[:, None, :]
    matrix = np.where(both, hessian, 0.0)
    place = np.arange(b.shape[1])
    matrix[:, place, place] += np.where(active, ridge, 1.0)
    try:
        exact = np.linalg.solve(matrix, np.where(active, left - soft * np.sign(b), 0.0)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return b
    # As far as the first sign change; the cost falls all the way there.
    turned = active & (soft > 0) & (np.sign(exact) != np.sign(b))
    share = np.where(turned, b / np.where(turned, b - exact, 1.0), np.inf)
    reach = np.minimum(1.0, share.min(axis=1, initial=np.inf))[:, None]
    new = np.where(share <= reach, 0.0, b + reach * (exact - b))
    return np.where(np.isfinite(exact).all(axis=1)[:, None], new, b)


class _Round:
    """One scan over all rows for some open problems, and the solutions that follow from it."""

    def __init__(self, grid: Grid, problems: list[_Open], groups: int) -> None:
        self.grid, self.problems = grid, problems
        # Problems of one group are solved together: long arrays, few calls.
        sizes = np.cumsum([own.numbers(grid) for own in problems])
        number = (sizes - 1) * groups // sizes[-1]
        self.groups = [np.flatnonzero(number == n).tolist() for n in np.unique(number)]

    def sums(self, frames: Iterator[pd.DataFrame], parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Sums of every group that the part of these rows works on."""
        upper = np.triu_indices(self.grid.width + 1) if self.grid.paired else None
        held: dict[int, list[tuple[int, list[_Sums]]]] = {}
        for frame in frames:
            for part, rows in frame.groupby("part"):
                if part not in held:
                    held[part] = [(n, [_Sums(self.grid, self.problems[i]) for i in group]) for n, group in enumerate(self.groups) if n % parts == part]
                for batch in self.batches(rows):
                    pairs = batch.x[:, upper[0]] * batch.x[:, upper[1]] if self.grid.paired else None
                    for _, sums in held[part]:
                        for own in sums:
                            own.add(batch, pairs)
        for groups in held.values():
            for number, sums in groups:
                yield number, np.concatenate([own.flat for own in sums])

    def batches(self, rows: pd.DataFrame) -> Iterator[_Batch]:
        if "sizes" in rows:
            return expansions.batches(rows, self.grid.width)
        return _batches(iter([rows]), self.grid.width)

    def answers(self, number: int, whole: np.ndarray) -> list[_Answer]:
        """What follows for the problems of a group from the sums over all rows."""
        at = 0
        held = []
        for i in self.groups[number]:
            own = _Sums(self.grid, self.problems[i])
            own.flat = whole[at : at + len(own.flat)]
            at += len(own.flat)
            held.append(own)
        models = [own.model() for own in held]
        out: list[_Answer | None] = [None] * len(held)
        for size in sorted({m.start.shape[1] for m in models}):
            alike = [i for i, m in enumerate(models) if m.start.shape[1] == size]
            joined = [np.concatenate([getattr(models[i], name) for i in alike]) for name in ("hessian", "left", "start", "soft", "ridge")]
            found, at = coordinate_descent(*joined, self.grid.lanes if self.grid.joint else 1), 0
            for i in alike:
                lanes = len(models[i].start)
                out[i] = held[i].answer(found[at : at + lanes])
                at += lanes
        return out

    def run(self, dealt: _Dealt) -> list[_Answer]:
        sent = dealt.rows.sparkSession.sparkContext.broadcast(self)
        parts, alone = dealt.parts, dealt.ranges == 1

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            this: _Round = sent.value
            for number, whole in this.sums(frames, parts):
                yield pd.DataFrame({"unit": [number], "sums": [pickle.dumps(this.answers(number, whole)) if alone else whole.tobytes()]})

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            number, whole = int(frame["unit"].iloc[0]), 0
            for raw in frame["sums"]:
                whole = whole + np.frombuffer(raw)
            return pd.DataFrame({"unit": [number], "sums": [pickle.dumps(sent.value.answers(number, whole))]})

        found = dealt.rows.mapInPandas(scan, SUMS)
        if not alone:
            # As many partitions as groups: small as the sums may be, solving them is the work.
            found = found.repartition(len(self.groups), "unit").groupBy("unit").applyInPandas(solve, SUMS)
        answers = {r["unit"]: pickle.loads(r["sums"]) for r in found.collect()}
        sent.destroy()
        return [answer for number in range(len(self.groups)) for answer in answers[number]]


def _chunks(grid: Grid, problems: list[_Open], parts: int, most: int | None = None) -> Iterator[list[_Open]]:
    """Problems whose sums fit into the tasks, if each works on its part."""
    held, numbers = [], 0
    for own in problems:
        if held and numbers + own.numbers(grid) > (most or SUM_NUMBERS) * parts:
            yield held
            held, numbers = [], 0
        held.append(own)
        numbers += own.numbers(grid)
    if held:
        yield held


def solve_paths(table: DataFrame, grid: Grid, larger_is_better: bool) -> Solved:
    """Walks all paths, scores every point on its inner fold, and keeps the coefficients of each fit's best point.

    ``table`` has ``y, features, fold_of, inner_of``. Ties of the mean score go
    to the smaller l1 ratio, then to the larger penalty. What the driver holds is
    bounded: the paths of the fits that walk together.
    """
    many, inner, steps = len(grid.l1_ratios), grid.inner_cv, grid.penalty.shape[3]
    shape = (grid.fits, inner + 1, many, steps)
    out = Solved(
        np.full(shape, np.nan), np.zeros(shape, dtype=bool), [(0, 0)] * grid.fits, np.full(grid.fits, np.nan),
        np.zeros((grid.fits, grid.lanes, grid.width + 1)),
    )
    numbers = many * grid.lanes * (grid.width + 1) * (3 * (inner + 1) + _kept_sets(grid) * steps)
    together = max(1, WAVE_NUMBERS // numbers)
    rows = table.count()
    expanded = expansions.Expansions.of(table, grid, rows, out) if expansions.fitting(grid, rows) else None
    dealt = None if expanded else _Dealt.of(table, min(together, grid.fits))
    for first in range(0, grid.fits, together):
        fits = range(first, min(grid.fits, first + together))
        held = expanded.solve(fits, out) if expanded else _walk(dealt, grid, fits, out)
        if grid.family == BINARY:
            share = max(1, WAVE_NUMBERS // max(1, 4 * held[0].size))
            for at in range(0, len(fits), share):
                out.scans += 1
                _score_areas(table, grid, fits[at : at + share], held[at : at + share], out)
        _keep_best(fits, held, out, larger_is_better)
    if dealt:
        dealt.rows.unpersist()
    return out


def _kept_sets(grid: Grid) -> int:
    """Training sets whose whole paths are kept: areas are taken after the walk, other scores on the way."""
    return grid.inner_cv + 1 if grid.family == BINARY else 1


def _walk(dealt: _Dealt, grid: Grid, fits: range, out: Solved) -> np.ndarray:
    """The paths of some fits, ``(fit, l1, g, step, lane, feature + 1)`` for the kept ``g``.

    Every problem goes to its next step as soon as it is done with one, so the
    rounds are those of the slowest path, not the sum of the slowest steps. Wide
    problems are held apart by l1 ratio, as their working sets differ in size.
    """
    many, sets, steps = len(grid.l1_ratios), grid.inner_cv + 1, grid.penalty.shape[3]
    narrow, groups = grid.width <= grid.working_set, 2 * dealt.parts * dealt.ranges
    shape = (len(fits), many, sets)
    beta = np.zeros((*shape, grid.lanes, grid.width + 1))
    before, objective = beta.copy(), np.full(shape, np.inf)
    step, rounds = np.zeros(shape, dtype=int), np.zeros(shape, dtype=int)
    kept = np.zeros((len(fits), many, _kept_sets(grid), steps, grid.lanes, grid.width + 1))
    working = {} if narrow else {(i, k): np.full((sets, grid.lanes, 1), -1) for i in range(len(fits)) for k in range(many)}
    while True:
        problems = []
        for i, fit in enumerate(fits):
            for ratios in [np.arange(many)] if narrow else np.arange(many)[:, None]:
                k, g = np.nonzero(step[i, ratios] < steps)
                if len(g):
                    k = ratios[k]
                    now = step[i, k, g]
                    lam, following = grid.penalty[fit, g, k, now], grid.penalty[fit, g, k, np.minimum(now + 1, steps - 1)]
                    own = None if narrow else working[i, k[0]][g]
                    problems.append(_Open(fit, g, grid.l1_ratios[k], k, lam, following, beta[i, k, g], before[i, k, g], objective[i, k, g], own))
        if not problems:
            return kept
        for chunk in _chunks(grid, problems, dealt.parts):
            out.scans += 1
            for own, answer in zip(chunk, _Round(grid, chunk, groups).run(dealt), strict=True):
                i, at = own.fit - fits.start, (own.at, own.g)
                now = step[i][at].copy()
                rounds[i][at] += 1
                over = answer.done | (rounds[i][at] >= grid.most_rounds)
                if not narrow:
                    working[i, own.at[0]] = _placed(working[i, own.at[0]], own.g, answer.working)
                k, g, end = own.at[over], own.g[over], now[over]
                saved = g < kept.shape[2]
                kept[i, k[saved], g[saved], end[saved]] = own.beta[over][saved]
                out.converged[own.fit, g, k, end] = answer.done[over]
                if grid.family != BINARY:
                    # Scores are the mean squared error and the mean log-likelihood.
                    out.score[own.fit, g, k, end] = answer.held[over] * (2.0 if grid.family == LINEAR else -1.0)
                # A finished step is the start of the next one, whose objective is another.
                beta[i][at] = np.where(over[:, None, None], own.beta, answer.beta)
                before[i][at] = np.where((answer.worse & ~over)[:, None, None], own.before, own.beta)
                objective[i][at] = np.where(over, np.inf, answer.objective)
                step[i][at] = now + over
                rounds[i][at] = np.where(over, 0, rounds[i][at])


def settled(dealt: _Dealt, grid: Grid, points: list[tuple], out: Solved) -> Iterator[tuple]:
    """Grid points ``(fit, g, l1, step, beta)``, arrays but the fit, solved by themselves from coefficients nearby.

    As they come out, with their coefficients: all those of a fit that are done at once.
    """
    groups = 2 * dealt.parts * dealt.ranges
    open_ = [(fit, g, k, step, beta, beta, np.full(len(g), np.inf), np.zeros(len(g), dtype=int)) for fit, g, k, step, beta in points]
    while open_:
        problems = [
            _Open(fit, g, grid.l1_ratios[k], k, grid.penalty[fit, g, k, step], grid.penalty[fit, g, k, step], beta, before, objective, None)
            for fit, g, k, step, beta, before, objective, _ in open_
        ]
        held, at = open_, 0
        open_ = []
        for chunk in _chunks(grid, problems, dealt.parts, SUM_NUMBERS // 4):
            out.scans += 1
            for own, answer in zip(chunk, _Round(grid, chunk, groups).run(dealt), strict=True):
                fit, g, k, step, _, before, _, rounds = held[at]
                at += 1
                over = answer.done | (rounds + 1 >= grid.most_rounds)
                out.converged[fit, g[over], k[over], step[over]] = answer.done[over]
                if grid.family != BINARY:
                    out.score[fit, g[over], k[over], step[over]] = answer.held[over] * (2.0 if grid.family == LINEAR else -1.0)
                if over.any():
                    yield fit, g[over], k[over], step[over], own.beta[over]
                if not over.all():
                    before = np.where(answer.worse[:, None, None], before, own.beta)
                    open_.append((fit, *(a[~over] for a in (g, k, step, answer.beta, before, answer.objective, rounds + 1))))


def _placed(held: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``held`` with the rows ``at`` replaced, both filled up to the same number of places."""
    size = max(held.shape[2], new.shape[2])
    out = np.full((*held.shape[:2], size), -1)
    out[:, :, : held.shape[2]] = held
    out[at] = -1
    out[at, :, : new.shape[2]] = new
    return out[:, :, : max(1, int((out >= 0).sum(axis=2).max()))]


def _keep_best(fits: range, kept: np.ndarray, out: Solved, larger: bool) -> None:
    for i, fit in enumerate(fits):
        scores = out.score[fit, 1:]
        seen = ~np.isnan(scores)
        number = seen.sum(axis=0)
        means = np.where(number > 0, np.where(seen, scores, 0.0).sum(axis=0) / np.maximum(number, 1), -np.inf if larger else np.inf)
        # The first of equals in this order: smaller l1 ratio, then larger penalty.
        at = int(np.argmax(means) if larger else np.argmin(means))
        out.best[fit] = divmod(at, means.shape[1])
        out.mean_score[fit] = means.flat[at] if number.flat[at] else np.nan
        out.coef[fit] = kept[i][out.best[fit][0], 0, out.best[fit][1]]


def _score_areas(table: DataFrame, grid: Grid, fits: range, kept: np.ndarray, out: Solved) -> None:
    """Areas under the ROC curve of every inner fold at all points, exact, with ties counted half."""
    scale = np.concatenate([grid.scale[fits.start : fits.stop], np.ones((len(fits), 1))], axis=1)
    # (fit, g, point, feature): points are (l1, step).
    raw = kept[:, :, 1:, :, 0].swapaxes(1, 2).reshape(len(fits), grid.inner_cv, -1, grid.width + 1) * scale[:, None, None, :]
    buckets = max(1, -(-table.count() // (RANKED_TOGETHER * grid.splits)))
    if buckets == 1:
        _score_areas_by_rows(table, grid, fits, raw, out)
        return
    sent = table.sparkSession.sparkContext.broadcast(raw)
    first, splits, inner_cv, width = fits.start, grid.splits, grid.inner_cv, grid.width
    schema = "fit int, inner_fold int, bucket int, sizes binary, scores binary, labels binary"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coefs = sent.value
        for batch in _batches(frames, width):
            for i in range(len(coefs)):
                repeat, fold = divmod(first + i, splits)
                train = batch.folds[:, repeat] != fold + 1
                for g in range(1, inner_cv + 1):
                    own = train & (batch.inner[:, repeat] == g)
                    if not own.any():
                        continue
                    eta = (batch.x[own] @ coefs[i, g - 1].T).T  # (point, row)
                    y = np.broadcast_to(batch.y[own] > 0.5, eta.shape)
                    bucket = np.minimum((buckets / (1.0 + np.exp(-np.clip(eta, -700, 700)))).astype(np.int64), buckets - 1)
                    for b in range(buckets):
                        inside = bucket == b
                        sizes = inside.sum(axis=1)
                        if sizes.any():
                            yield pd.DataFrame({"fit": [first + i], "inner_fold": [g], "bucket": [b], "sizes": [sizes.astype("<i8").tobytes()], "scores": [eta[inside].tobytes()], "labels": [np.packbits(y[inside]).tobytes()]})

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for sizes, scores, labels in zip(frame["sizes"], frame["scores"], frame["labels"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, dtype="<i8"))
            values = np.frombuffer(scores)
            parts.append((np.append(0, ends), values, np.unpackbits(np.frombuffer(labels, dtype=np.uint8), count=len(values)).astype(bool)))
        found = []
        for point in range(len(parts[0][0]) - 1):
            value = np.concatenate([v[e[point] : e[point + 1]] for e, v, _ in parts])
            label = np.concatenate([m[e[point] : e[point + 1]] for e, _, m in parts])
            other, own = np.sort(value[~label]), value[label]
            wins = 0.5 * (np.searchsorted(other, own, side="left") + np.searchsorted(other, own, side="right")).sum()
            found.append((int(frame["fit"].iloc[0]), int(frame["inner_fold"].iloc[0]), point, int(frame["bucket"].iloc[0]), len(own), len(other), float(wins)))
        return pd.DataFrame(found, columns=["fit", "inner_fold", "point", "bucket", "positives", "negatives", "wins"])

    ranked = _lean(table).coalesce(table.sparkSession.sparkContext.defaultParallelism).mapInPandas(scan, schema).groupBy("fit", "inner_fold", "bucket").applyInPandas(rank, AREAS)
    # A bucket's positives win against the negatives of all lower ones.
    cells = F.array_sort(F.collect_list(F.struct("bucket", "positives", "negatives", "wins")))
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"))
    whole = F.aggregate(
        "cells", start,
        lambda s, c: F.struct((s["p"] + c["positives"]).alias("p"), (s["n"] + c["negatives"]).alias("n"), (s["w"] + c["wins"] + c["positives"] * s["n"]).alias("w")),
    )
    areas = ranked.groupBy("fit", "inner_fold", "point").agg(cells.alias("cells")).select("fit", "inner_fold", "point", whole.alias("t"))
    found = areas.select("fit", "inner_fold", "point", F.try_divide(F.col("t.w"), F.col("t.p") * F.col("t.n")).alias("auc")).toPandas()
    sent.destroy()
    steps = grid.penalty.shape[3]
    out.score[found["fit"], found["inner_fold"], found["point"] // steps, found["point"] % steps] = found["auc"]


def _score_areas_by_rows(table: DataFrame, grid: Grid, fits: range, raw: np.ndarray, out: Solved) -> None:
    """The same where one task can rank an inner fold: rows are sent there once for all fits of a repeat, not their scores."""
    sent = table.sparkSession.sparkContext.broadcast(raw)
    splits, inner_cv, width, steps = grid.splits, grid.inner_cv, grid.width, grid.penalty.shape[3]
    repeats = range(fits.start // splits, (fits.stop - 1) // splits + 1)
    code = np.dtype("u1" if width <= 2**8 else "<u2" if width <= 2**16 else "<i4")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, width):
            held = []
            for repeat in repeats:
                for g in range(1, inner_cv + 1):
                    own = np.flatnonzero(batch.inner[:, repeat] == g)
                    if len(own):
                        x = batch.x[own, :-1] != 0
                        arrays = x.sum(axis=1).astype("<i4"), np.nonzero(x)[1].astype(code), batch.folds[own, repeat].astype("<i4"), batch.y[own] > 0.5
                        held.append((repeat, g, *(a.tobytes() for a in arrays)))
            yield pd.DataFrame(held, columns=["repeat", "g", "sizes", "codes", "folds", "labels"])

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        repeat, g = int(frame["repeat"].iloc[0]), int(frame["g"].iloc[0])
        sizes, codes, folds, labels = (np.concatenate([np.frombuffer(raw, dtype=kind) for raw in frame[name]]) for name, kind in (("sizes", "<i4"), ("codes", code), ("folds", "<i4"), ("labels", "?")))
        ends, rows, found = np.append(0, np.cumsum(sizes)), max(64, ROW_NUMBERS // (width + 1)), []

        def dense(begin: int) -> np.ndarray:
            end = min(begin + rows, len(sizes))
            x = np.zeros((end - begin, width + 1))
            x[:, -1] = 1.0
            x[np.repeat(np.arange(end - begin), sizes[begin:end]), codes[ends[begin] : ends[end]]] = 1.0
            return x

        begins = range(0, len(sizes), rows)
        # Made once where they are small.
        once = [dense(b) for b in begins] if len(sizes) * (width + 1) <= 4 * ROW_NUMBERS else None
        for fit in range(max(fits.start, repeat * splits), min(fits.stop, (repeat + 1) * splits)):
            train = folds != fit % splits + 1
            own = labels[train]
            # Points with the same coefficients have the same scores.
            coefs, same = np.unique(sent.value[fit - fits.start, g - 1], axis=0, return_inverse=True)
            areas, together = np.full(len(coefs), np.nan), max(1, ROW_NUMBERS // max(1, len(own)))
            for first in range(0, len(coefs) if 0 < own.sum() < len(own) else 0, together):
                some = coefs[first : first + together]
                eta = np.concatenate([some @ (once[n] if once else dense(b))[train[b : b + rows]].T for n, b in enumerate(begins)], axis=1)
                areas[first : first + together] = [_area(e, own) for e in eta]
            found.append(pd.DataFrame({"fit": fit, "inner_fold": g, "point": np.arange(len(same.ravel())), "auc": areas[same.ravel()]}))
        return pd.concat(found)

    tasks = table.sparkSession.sparkContext.defaultParallelism
    dealt = _lean(table).coalesce(tasks).mapInPandas(scan, "repeat int, g int, sizes binary, codes binary, folds binary, labels binary")
    areas = dealt.repartition(min(len(repeats) * inner_cv, 8 * tasks), "repeat", "g").groupBy("repeat", "g").applyInPandas(rank, "fit int, inner_fold int, point int, auc double")
    found = areas.toPandas()
    sent.destroy()
    out.score[found["fit"], found["inner_fold"], found["point"] // steps, found["point"] % steps] = found["auc"]


def _area(scores: np.ndarray, own: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half. The last bit of a score carries the label through one sort."""
    bits = ((scores + 0.0).view(np.int64) & ~np.int64(1)) | own
    bits = np.sort(bits.view(np.float64)).view(np.int64)
    mark, value = bits & 1, bits >> 1
    at = np.flatnonzero(mark.astype(bool))
    positives, negatives = len(at), len(own) - len(at)
    wins = float(at.sum()) - 0.5 * positives * (positives - 1)
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    tied = np.add.reduceat(mark, starts)
    both = tied * (np.diff(np.append(starts, len(own))) - tied)
    # Among equals the negatives came first above 0, and last below.
    wins -= 0.5 * float((both * np.where(value[starts] >= 0, 1, -1)).sum())
    return wins / (positives * negatives)


def predict_held_out(table: DataFrame, raw: np.ndarray, splits: int) -> DataFrame:
    """``fit_id, sample_id, y_true, eta`` of every sample and repeat in one scan.

    ``raw (fit, lane, feature + 1)`` are coefficients of unscaled features with
    the intercept last; a batch is one matrix product per fit.
    """
    sent = table.sparkSession.sparkContext.broadcast(raw)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coefs = sent.value
        for batch in _batches(frames, coefs.shape[2] - 1):
            ids = np.array(batch.ids, dtype=object)
            for fit in range(len(coefs)):
                repeat, fold = divmod(fit, splits)
                held = batch.folds[:, repeat] == fold + 1
                if held.any():
                    eta = batch.x[held] @ coefs[fit].T
                    yield pd.DataFrame({"fit_id": fit + 1, "sample_id": ids[held], "y_true": batch.y[held], "eta": list(eta)})

    codes = F.unwrap_udt("features").getField("indices").alias("codes")
    lean = table.select("sample_id", "y", codes, "fold_of", "inner_of")
    return lean.mapInPandas(run, "fit_id int, sample_id string, y_true double, eta array<double>")
