"""Documents to packed training sequences: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.llm import packing, pii, quality, simhash
from markerloom.llm.common import stored
from markerloom.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null and empty texts have no words and go; repeated rows stay or go
    together; texts of any length are read whole; no documents give no rows.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of fingerprints join: the smallest id, then the least text hash.

    Three-word shingles and at most three differing bits, as in the operator's
    contract. Null, empty and blank texts share a fingerprint and so a group;
    a row without an id stays only if its group has no other; rows that repeat
    id and text count as one; no documents give no rows.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` is that of the new text.

    Null texts stay null, with a null ``n_chars``; rows are neither dropped nor
    merged; overlapping finds become one; no documents give no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids.

    Null and empty texts give their end token alone; equal rows are packed as
    often as they occur; no documents give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The learned rules, the hashes and the vocabulary have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
