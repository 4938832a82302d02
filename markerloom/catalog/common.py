"""SQL fragments and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6

BRANDS = """
samples AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS label FROM customer),
presence AS MATERIALIZED (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sample_id, p_brand AS feature
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE o_custkey IN (SELECT c_custkey FROM customer))
"""

WORDS = """
samples AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS label FROM documents),
presence AS MATERIALIZED (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS sample_id,
         unnest(regexp_extract_all(lower(text), '[a-z]+')) AS feature
  FROM documents)
"""


def rounded(column: str | Column, name: str | None = None, digits: int = DIGITS) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    out = F.round(value, digits)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def listed(column: str | Column) -> Column:
    return F.concat_ws(",", column)


class Registry:
    """Collects queries and their SQL under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(query: Callable) -> Callable:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return keep
