"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import stored

MOST_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of its component, for all nodes with a link to another.

    ``links`` has columns ``a, b``. Links are held as stars: each round a join
    and a sum by node, written to the shared folder; the number of rounds grows
    with the logarithm of the nodes. What is done is seen from a count and a hash.
    """
    held, before = stored(links.filter("a != b").distinct(), "links"), None
    for _ in range(MOST_ROUNDS):
        held = stored(_small(_large(held)), "links")
        mark = held.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
