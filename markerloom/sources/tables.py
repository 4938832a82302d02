"""Baskets from the star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.operators.presence import baskets_from_long
from markerloom.session import share_package

WORD = "[a-z]+"


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of a few splits over all cores before costly row work.

    A scan with fewer splits than cores holds at most cores x split size
    bytes, so what this shuffles is bounded; a larger scan is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def document_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as samples, their distinct words as features, the language as label.

    Built inside the row: no shuffle.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    texts = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return texts.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("label"),
        F.array_distinct(words).alias("items"),
    )


def brand_presence(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, feature``: the brands each customer bought, repeats included."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "p_brand")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("p_brand").alias("feature"))
    )


def customer_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer, also those without an order, with the segment as label."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("label")
    )


def brand_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as samples, brands bought as features, the segment as label."""
    return baskets_from_long(customer_samples(spark, folder), brand_presence(spark, folder))


def balances(spark: SparkSession, folder: str) -> DataFrame:
    """Customer metadata with a continuous outcome."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("balance"))


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a quality judgement: ``sample_id, label, toxic, score``."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("sample_id"),
            F.col("quality").cast("string").alias("label"),
            "quality",
            "toxic",
            F.col("n_chars").cast("double").alias("score"),
        )
    )
