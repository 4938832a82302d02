"""Named queries on the driver's tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from markerloom.catalog import clustering, evaluation, files, mining, models, presence

    return presence, mining, evaluation, clustering, files, models


def queries() -> dict[str, Query]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
