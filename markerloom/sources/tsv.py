"""Tab-separated inputs (A1-A5). Every column is read as text and cast by name later."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.functions.cells import is_present
from markerloom.operators.checks import require_columns, require_features
from markerloom.operators.presence import names_literal

FEATURE_PREFIX = "OG"
ANNOTATED_FEATURE = "Orthogroup"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with a header, all columns STRING (A1, A2)."""
    return spark.read.option("sep", "\t").option("header", True).option("maxColumns", 1_000_000).csv(path)


def _plain(cell: Column) -> Column:
    """A cell without the quotes around it; an empty one is NULL."""
    quoted = (F.length(cell) >= 2) & cell.startswith('"') & cell.endswith('"')
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(quoted, inner).otherwise(cell), F.lit(""))


def read_cells(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Column names of a TSV, and its lines as ``cells``, an array in column order.

    A reader with a column per name makes a plan as long as the table is wide;
    here the plan is the same for five columns and for fifty thousand. Every
    file of a folder may repeat the header. Cells cannot hold a tab.
    """
    names, lines = _raw_cells(spark, path)
    return names, lines.select(F.transform("cells", _plain).alias("cells"))


def _raw_cells(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The same with cells as they stand in the file."""
    lines = spark.read.text(path)
    first = lines.head()
    header = first.value if first else ""
    names = [n[1:-1].replace('""', '"') if len(n) >= 2 and n[0] == n[-1] == '"' else n for n in header.split("\t")]
    return names, lines.filter(F.col("value") != header).select(F.split("value", "\t", -1).alias("cells"))


def _cell(names: Sequence[str], name: str) -> Column:
    return F.get("cells", F.lit(list(names).index(name)))


def feature_columns(
    columns: Sequence[str],
    id_col: str,
    label_col: str | None = None,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    prefix: str | None = None,
) -> tuple[list[str], list[str]]:
    """Predictor columns in file order, and excluded names that do not exist.

    An unknown included name is an error; an unknown excluded name is only
    reported.
    """
    others = [c for c in columns if c not in (id_col, label_col)]
    if include is not None:
        missing = [c for c in include if c not in columns]
        if missing:
            raise ValueError(f"predictors not found in the input: {', '.join(missing)}")
        return [c for c in include if c not in (id_col, label_col)], []
    unknown = [c for c in exclude or [] if c not in columns]
    kept = [c for c in others if c not in set(exclude or [])]
    return [c for c in kept if prefix is None or c.startswith(prefix)], unknown


def catalogue(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    """``feature, position`` in column order."""
    return spark.createDataFrame([(name, i) for i, name in enumerate(features)], "feature string, position int")


def read_presence(
    spark: SparkSession,
    path: str,
    id_col: str,
    label_col: str | None = None,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    prefix: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Wide presence TSV to ``(baskets, catalogue)``."""
    columns, lines = read_cells(spark, path)
    require_columns(columns, [c for c in (id_col, label_col) if c is not None])
    names, unknown = feature_columns(columns, id_col, label_col, include, exclude, prefix)
    if unknown:
        warnings.warn(f"excluded predictors that the table does not have: {', '.join(unknown)}", stacklevel=2)
    require_features(names)
    chosen = set(names)
    by_place = names_literal([c if c in chosen else "" for c in columns])
    present = F.transform("cells", lambda cell, i: F.when(is_present(cell), F.nullif(F.get(by_place, i), F.lit(""))))
    kept = [_cell(columns, id_col).alias("sample_id")]
    if label_col is not None:
        kept.append(_cell(columns, label_col).alias("label"))
    return lines.select(*kept, F.array_compact(present).alias("items")), catalogue(spark, names)


def read_annotation(spark: SparkSession, path: str, feature_col: str = ANNOTATED_FEATURE) -> DataFrame:
    """Wide annotation TSV to ``feature, sample_id, entry`` (A3)."""
    columns, lines = _raw_cells(spark, path)
    require_columns(columns, [feature_col], "the annotation table")
    samples = names_literal([c if c != feature_col else "" for c in columns])
    # A line can be long: it is split once (a plain explode splits it for a filter, too), and cells are read one by one.
    rows = lines.select(_cell(columns, feature_col).alias("feature"), F.posexplode_outer("cells").alias("place", "entry"))
    named = rows.select(_plain(F.col("feature")).alias("feature"), F.get(samples, F.col("place")).alias("sample_id"), _plain(F.col("entry")).alias("entry"))
    return named.filter(F.col("entry").isNotNull() & (F.col("sample_id") != ""))


def _list_text(column: str):
    """The text form of a list of names, ``['a', 'b']``, to an array."""
    inner = F.regexp_replace(F.col(column), r"^\s*[\[\(\{]|[\]\)\}]\s*$", "")
    return F.array_sort(
        F.array_compact(
            F.transform(
                F.split(inner, ","),
                lambda item: F.nullif(F.regexp_replace(F.trim(item), "^['\"]|['\"]$", ""), F.lit("")),
            )
        )
    )


def import_itemsets(spark: SparkSession, path: str, n_samples: int) -> DataFrame:
    """Frequent patterns saved as TSV (``support``, ``itemsets``) (A4)."""
    raw = read_tsv(spark, path)
    require_columns(raw, ["support", "itemsets"], "the saved patterns")
    support = F.col("support").cast("double")
    return raw.select(_list_text("itemsets").alias("itemset"), support.alias("support")).select(
        "itemset",
        F.size("itemset").alias("length"),
        F.bround(F.col("support") * n_samples).cast("bigint").alias("freq"),
        "support",
    )


def import_rules(spark: SparkSession, path: str) -> DataFrame:
    """Marker rules saved as TSV (A5)."""
    from markerloom.operators.rules import METRICS

    raw = read_tsv(spark, path)
    require_columns(raw, ["orthogroups", *METRICS], "the saved rules")
    named = raw.select(_list_text("orthogroups").alias("orthogroups"), *[F.col(m).cast("double").alias(m) for m in METRICS])
    return named.select("orthogroups", F.size("orthogroups").alias("num_orthogroups"), *METRICS)
