"""Packing by concatenation: two passes of prefix sums give every document its place (operator 1)."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, keyed_texts, stored
from markerloom.llm.tokens import VOCABULARY, encoder, vocabulary_path

WINDOW = 2048
END_ID = 1
TOKENISED = "part int, doc_id long, below long, n_tokens long, ids binary"


def tokenised(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: ids of every text and its place inside its partition.

    ``part`` is the task that read the row, ``below`` the tokens of the rows
    before it there. Write the result before relying on either. ``ids`` are
    little-endian unsigned 32-bit integers with ``end_id`` last.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    target = arrow_schema(documents.sparkSession, TOKENISED)

    def run(batches: Batches) -> Batches:
        part, below = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                lot = batch.slice(begin, 500)
                keys, starts, sizes, ids = lot.column(0), [], [], []
                for found in encoder(path).encode(lot.column(1).to_pylist()):
                    whole = np.concatenate([found, end]).astype("<u4")
                    starts.append(below)
                    sizes.append(len(whole))
                    ids.append(whole.tobytes())
                    below += len(whole)
                parts = np.full(len(ids), part, dtype=np.int32)
                columns = [pa.array(parts), keys.cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return keyed_texts(documents, key, text).mapInArrow(run, TOKENISED)


def partition_starts(rows: DataFrame) -> dict[int, int]:
    """Tokens before each partition. One number per task of the first pass reaches the driver."""
    totals = sorted((r["part"], r["total"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect())
    return dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents laid end to end and cut every ``window`` tokens.

    One row per piece: ``doc_id, start`` (in its document), ``length, doc_tokens,
    sequence_id, offset`` (in its sequence) and ``ids``. Only the last sequence
    can be short. Nothing is shuffled but one total per partition.

    Null and empty texts give one piece with ``end_id``; null keys stay null;
    equal rows are packed as often as they occur; no documents give no rows;
    a text longer than the window spans as many sequences as it needs.
    """
    rows = stored(tokenised(documents, key, text, vocabulary, end_id), "tokens")
    starts = documents.sparkSession.createDataFrame(sorted(partition_starts(rows).items()), "part int, base long")
    # One row for each task of the first pass.
    placed = rows.join(F.broadcast(starts), "part").withColumn("at", F.col("base") + F.col("below"))

    def piece(sequence: Column) -> Column:
        begin = sequence * window - F.col("at")
        start = F.greatest(begin, F.lit(0))
        length = F.least(begin + window, F.col("n_tokens")) - start
        ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int"))
        return F.struct(
            start.alias("start"), length.alias("length"), F.col("n_tokens").alias("doc_tokens"), sequence.alias("sequence_id"),
            F.greatest(-begin, F.lit(0)).alias("offset"), ids.alias("ids"),
        )

    # Cut inside the row, so that a long document is not copied for each of its pieces.
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n_tokens") - 1) / window)
    return placed.select("doc_id", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("doc_id", "p.*")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids``: the sequences themselves.

    A piece that fills its window is a sequence already. The others are
    boundary records: those of one sequence, at most a window full, meet in one group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda whole, p: F.concat(whole, p["ids"]))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        joined.alias("ids"),
    )
