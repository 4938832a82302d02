"""Hard negatives by slot-decomposed selection (operator 13).

An anchor's positives ask for overlapping windows of scores: at most the
positive's own score, and at least a share of it. The positives' scores, taken as
upper limits, split all scores into disjoint slots. Every task keeps the best few
rows of each slot of each anchor while it reads; these are combined by slot.
Slots fall in score, so the first rows of a slot followed by those of all lower
slots, in that order, answer the window that the slot's limit opens.

Anchors are compared with all rows, in blocks: a block of anchors of bounded size
is sent to all tasks, and rows stream past it. What a task sends on is bounded
by anchors times slots times rows kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, stored

POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this percentage of its positive.
LEAST_PERCENT = 80
#: Components are these many parts of one, rounded down.
PARTS = 256
#: Bytes of anchors that are sent to the tasks at once.
ANCHOR_BYTES = 32 << 20
#: Rows and anchors of a table of scores.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 2048
#: Candidates held before they are cut to the best.
HELD = 1_000_000
KEPT = "anchor long, slot int, score long, vec_id long, row long"


def whole_vectors(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """``row, vec_id, label, vector``: rows that take part, with whole-number components and a number of their own.

    Rows with a null key, label or vector, or with a null or non-finite component
    take no part. Write the result before relying on ``row``.
    """
    wide = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.transform(wide, lambda x: F.floor(x * parts)).alias("vector"),
    )


class Best:
    """The best ``k`` candidates of every group: higher scores, then smaller ids, then smaller row numbers."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.held = [np.zeros((4, 0), dtype=np.int64)]
        self.waiting = 0
        # The candidate that a further one has to beat, once a group is full.
        self.least = np.full(groups, np.iinfo(np.int64).min)
        self.least_id = np.full(groups, np.iinfo(np.int64).max)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = score.astype(np.int64)
        better = (score > self.least[group]) | ((score == self.least[group]) & (ids <= self.least_id[group]))
        if better.any():
            self.held.append(np.stack([group[better].astype(np.int64), score[better], ids[better], rows[better]]))
            self.waiting += int(better.sum())
            if self.waiting > HELD:
                self.cut()

    def cut(self) -> np.ndarray:
        """Columns group, score, id, row of what is kept."""
        whole = np.concatenate(self.held, axis=1)
        whole = whole[:, np.lexsort((whole[3], whole[2], -whole[1], whole[0]))]
        group = whole[0]
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(begins, len(group)))
        place = np.arange(len(group)) - np.repeat(begins, sizes)
        full = begins[sizes >= self.k] + self.k - 1
        self.least[group[full]], self.least_id[group[full]] = whole[1, full], whole[2, full]
        self.held, self.waiting = [whole[:, place < self.k]], 0
        return self.held[0]


@dataclass(frozen=True)
class Anchors:
    """A block of anchors, by label; ``begin`` has the first and the end of each label's."""

    row: np.ndarray
    matrix: np.ndarray
    label: np.ndarray
    begin: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, rows: list, size: int, kind: type) -> Anchors:
        rows = sorted(rows, key=lambda r: (r["label"], r["row"]))
        labels = np.array([r["label"] for r in rows], dtype=object)
        matrix = np.zeros((len(rows), size), dtype=kind)
        for i, r in enumerate(rows):
            matrix[i, : len(r["vector"])] = r["vector"]
        begin: dict[str, tuple[int, int]] = {}
        for i, name in enumerate(labels.tolist()):
            begin[name] = (begin.get(name, (i, 0))[0], i + 1)
        return cls(np.array([r["row"] for r in rows], dtype=np.int64), matrix, labels, begin)


def _read(batches: Batches, size: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids, labels and padded vectors, some rows at a time, ordered by label."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            lot = batch.slice(begin, ROWS_AT_ONCE)
            vectors = lot.column(3)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            if (lengths == size).all():
                matrix = flat.reshape(-1, size).astype(kind)
            else:
                matrix = np.zeros((lot.num_rows, size), dtype=kind)
                matrix[np.repeat(np.arange(lot.num_rows), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            labels = np.array(lot.column(2).to_pylist(), dtype=object)
            order = np.argsort(labels, kind="stable")
            yield lot.column(0).to_numpy()[order], lot.column(1).to_numpy()[order], labels[order], matrix[order]


def _runs(labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
    cuts = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(labels)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield labels[a], a, b


def _scan(rows: DataFrame, work) -> DataFrame:
    """Runs ``work`` over all rows with one set of best candidates per task.

    As many tasks as the cluster has slots: each sends what it keeps only once.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    target = arrow_schema(rows.sparkSession, KEPT)

    def run(batches: Batches) -> Batches:
        group, score, ids, row = work(batches)
        columns = [*group, score, ids, row]
        for begin in range(0, len(row), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[begin : begin + (1 << 16)], type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.select("row", "vec_id", "label", "vector").coalesce(tasks).mapInArrow(run, KEPT)


def _first(kept: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group over what all tasks kept, numbered from 0."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return kept.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < k)


def _positives_of(rows: DataFrame, block, size: int, kind: type, k: int) -> DataFrame:
    """``anchor, place, score, vec_id``: the best other rows with the anchor's label."""

    def work(batches: Batches):
        anchors: Anchors = block.value
        best = Best(len(anchors.row), k)
        for numbers, ids, labels, matrix in _read(batches, size, kind):
            for name, a, b in _runs(labels):
                first, end = anchors.begin.get(name, (0, 0))
                for at in range(first, end, ANCHORS_AT_ONCE):
                    to = min(end, at + ANCHORS_AT_ONCE)
                    scores = matrix[a:b] @ anchors.matrix[at:to].T
                    i, j = np.nonzero((scores >= best.least[at:to].astype(float)) & (numbers[a:b, None] != anchors.row[None, at:to]))
                    best.add(j + at, scores[i, j], ids[a:b][i], numbers[a:b][i])
        group, score, ids, row = best.cut()
        return (anchors.row[group], np.zeros(len(group), dtype=np.int32)), score, ids, row

    return _first(_scan(rows, work), ["anchor"], k).select("anchor", "place", "score", "vec_id")


def _negatives_of(rows: DataFrame, block, limits, size: int, kind: type, k: int, percent: int) -> DataFrame:
    """``anchor, slot, score, vec_id, place``: the best rows of other labels in each slot of each anchor.

    ``limits`` has the falling upper limits of every anchor of the block; a slot
    reaches from its limit down to above the next one. Rows below every window
    of the anchor, or above all, are in none.
    """

    def work(batches: Batches):
        anchors, upper = block.value, limits.value
        slots = upper.shape[1]
        used = (upper > -np.inf).sum(axis=1)
        ceiling = np.where(used > 0, upper[:, 0], -np.inf)
        last = np.maximum(used - 1, 0)
        # The lowest window's least score, a little too low rather than too high.
        floor = np.where(used > 0, upper[np.arange(len(upper)), last] * (percent / 100) * (1 - 1e-9) - 1e-3, np.inf)
        best = Best(len(anchors.row) * slots, k)
        for numbers, ids, labels, matrix in _read(batches, size, kind):
            for at in range(0, len(anchors.row), ANCHORS_AT_ONCE):
                to = min(len(anchors.row), at + ANCHORS_AT_ONCE)
                scores = (matrix @ anchors.matrix[at:to].T).astype(np.float64)
                for name, a, b in _runs(labels):
                    first, end = anchors.begin.get(name, (0, 0))
                    scores[a:b, max(first - at, 0) : max(end - at, 0)] = -np.inf
                # Below a full lowest slot nothing can enter an answer.
                lowest = best.least[np.arange(at, to) * slots + last[at:to]].astype(float)
                i, j = np.nonzero((scores >= np.maximum(floor[at:to], lowest)) & (scores <= ceiling[at:to]))
                found, j = scores[i, j], j + at
                slot = (upper[j] >= found[:, None]).sum(axis=1) - 1
                best.add(j * slots + slot, found, ids[i], numbers[i])
        group, score, ids, row = best.cut()
        return (anchors.row[group // slots], (group % slots).astype(np.int32)), score, ids, row

    return _first(_scan(rows, work), ["anchor", "slot"], k).select("anchor", "slot", "score", "vec_id", "place")


def _number_kind(rows: DataFrame) -> tuple[int, type]:
    """The longest vector, and a type in which all inner products are exact."""
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    seen = rows.agg(F.max(F.size("vector")).alias("size"), F.max(most).alias("most")).first()
    size, most = seen["size"] or 0, seen["most"] or 0
    largest = size * most * most
    if largest >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    return size, np.float32 if largest < 1 << 24 else np.float64


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are those of ``whole_vectors``; ``is_anchor`` speaks of ``vec_id``
    and ``label``. Scores are inner products; the shorter of two vectors is
    taken to go on with zeros. A positive below zero has an empty window.

    Every row counts, also if it repeats the key of another: a second row with
    an anchor's key is an anchor of its own, and can be the other's positive.
    Ties go to the smaller key, then to the row read first. Nulls take no part
    (see ``whole_vectors``); an anchor without others of its label, or without
    rows in its windows, gives no rows; no rows give none. Components whose
    inner products would not be exact (2^53 and more) are an error.
    """
    spark = rows.sparkSession
    held = stored(rows, "vectors")
    size, kind = _number_kind(held)
    anchors = held.filter(is_anchor)
    count = anchors.count()
    blocks = max(1, -(-count * max(size, 1) * 8 // ANCHOR_BYTES))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found = []
    for number in range(blocks):
        block = Anchors.of(dealt.filter(F.col("block") == number).collect(), size, kind)
        if not len(block.row):
            continue
        sent = spark.sparkContext.broadcast(block)
        near = stored(_positives_of(held, sent, size, kind, positives), "positives")
        limits = np.full((len(block.row), positives), -np.inf)
        place = {row: i for i, row in enumerate(block.row.tolist())}
        for r in near.filter("score >= 0").select("anchor", "place", "score").collect():
            limits[place[r["anchor"]], r["place"]] = r["score"]
        slots = stored(_negatives_of(held, sent, spark.sparkContext.broadcast(limits), size, kind, negatives, percent), "slots")
        found.append(_answers(near, slots, negatives, percent))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _answers(near: DataFrame, slots: DataFrame, k: int, percent: int) -> DataFrame:
    """Suffix merges: the rows of a positive's slot, then those of the lower slots, as far as its window reaches."""
    falling = F.array_sort(F.collect_list(F.struct("slot", "place", "score", "vec_id"))).alias("falling")
    merged = near.withColumnsRenamed({"place": "limit", "score": "positive_score", "vec_id": "positive_id"}).join(
        slots.groupBy("anchor").agg(falling), "anchor"
    )
    suffix = F.slice(F.filter("falling", lambda x: x["slot"] >= F.col("limit")), 1, k)
    inside = F.filter(suffix, lambda x: x["score"] * 100 >= F.col("positive_score") * percent)
    answers = merged.filter("positive_score >= 0").select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("place", "n"))
    return answers.select(
        "anchor", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")
    )
