"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("markerloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, also if the driver was started elsewhere.

    On a cluster the package is installed or sent along like any other; a path
    that a machine does not have does no harm.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, taken from the session.

    A machine-local folder is made only for a one-process master without the
    setting; on a cluster a missing setting is an error, because executors on
    other machines could not read what was written.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="markerloom-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path per table, below one folder per application for easy removal."""
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark).rstrip('/')}/markerloom/{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true
    file sizes, so that later joins broadcast only what is known to be small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
