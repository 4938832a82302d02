"""Shared pieces of the text operators: intermediates, shared files, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.session import scratch_path

Batches = Iterator[pa.RecordBatch]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder, compressed, and reads it back.

    Cuts the lineage, and rows keep the partition and order they were written
    with, so what was numbered inside a task stays valid if executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text`` of ``df``: the key as long, a null text as empty. Other columns are left behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def by_text(
    df: DataFrame, schema: str, work: Callable[[list[int | None], list[str]], Iterable[dict[str, Any]]], rows: int = 500
) -> DataFrame:
    """Runs ``work`` over lots of ``doc_id, text`` rows; it gives column lists to be put into ``schema``.

    A lot has at most ``rows`` rows, whatever the size of an Arrow batch, so
    memory follows the longest texts only.
    """
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                for columns in work(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                    )

    return df.select("doc_id", "text").mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def filesystem(uri: str):
    """File system and path of a folder that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; made by the first file system that can, else by the writers."""
    return scratch_path(spark, name)


def attempt_name(partition: int, suffix: str) -> str:
    """A name that no other attempt at the same task uses; readers follow a list of finished files."""
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


def write_once(folder: str, name: str):
    """Output stream for a new file in ``folder``, and the path it got."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    target = f"{path}/{name}"
    return system.open_output_stream(target, compression=None), f"{folder.rstrip('/')}/{name}"


def open_file(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)
