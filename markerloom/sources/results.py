"""Result sinks (K1, K2, K4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_table(df: DataFrame, path: str, force: bool = False) -> None:
    """Canonical parquet output; refuses to overwrite unless forced (K1, K4)."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def require_free(spark: SparkSession, out: str, force: bool = False) -> None:
    """Refuse an output folder that already holds a run, unless forced (K4)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/parameters")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not force and system.exists(path):
        raise FileExistsError(f"{out} already holds results; choose another folder or force")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flat(df: DataFrame, list_text: bool = False) -> DataFrame:
    """Arrays as text, so that a row fits a TSV.

    ``list_text`` writes ``['a', 'b']``, the form the saved-pattern readers
    also accept; otherwise items are joined by a comma.
    """
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            quoted = F.transform(F.col(f"`{f.name}`"), lambda item: F.concat(F.lit("'"), item.cast("string"), F.lit("'")))
            text = (
                F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]"))
                if list_text
                else F.concat_ws(",", F.transform(F.col(f"`{f.name}`"), lambda item: item.cast("string")))
            )
            columns.append(text.alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return df.select(*columns)


def export_tsv(df: DataFrame, path: str, force: bool = False, list_text: bool = False) -> None:
    """TSV folder with headers, one file per task (K1)."""
    writer = flat(df, list_text).write.mode("overwrite" if force else "errorifexists")
    writer.option("sep", "\t").option("header", True).csv(path)


def _quoted(cell: Column) -> Column:
    return F.when(cell.contains('"'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def export_wide_tsv(
    cells: DataFrame, path: str, row: str, column: str, value: str, names: Sequence[str], corner: str, force: bool = False
) -> None:
    """One value per ``row`` and ``column`` as a wide TSV folder: a line per row, a column per name (K1).

    Lines are put together as text: a pivot makes a plan as long as the table
    is wide, here it is the same for five columns and for fifty thousand. Values
    of other columns are left out; every file begins with the header. Cells
    cannot hold a tab.
    """
    places = cells.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names, 1)], "_name string, _place int")
    known = cells.select(F.col(f"`{row}`").alias("_row"), F.col(f"`{column}`").alias("_name"), _quoted(F.coalesce(F.col(f"`{value}`"), F.lit(""))).alias("_cell"))
    # A row without any of the columns keeps its line.
    place = F.when(F.col("_place").isNotNull(), F.struct("_place", "_cell"))
    rows = known.join(places, "_name", "left").groupBy("_row").agg(F.array_sort(F.collect_list(place)).alias("_cells"))
    # Before a cell there are as many tabs as places since the one before it.
    spaced = F.transform(
        "_cells",
        lambda cell, i: F.concat(F.repeat(F.lit("\t"), cell["_place"] - F.coalesce(F.get("_cells", i - 1)["_place"], F.lit(0))), cell["_cell"]),
    )
    last = F.coalesce(F.get("_cells", F.size("_cells") - 1)["_place"], F.lit(0))
    after = F.repeat(F.lit("\t"), F.lit(len(names)) - last)
    line = F.concat(_quoted(F.coalesce(F.col("_row").cast("string"), F.lit(""))), F.array_join(spaced, ""), after)
    header = "\t".join('"' + name.replace('"', '""') + '"' if '"' in name else name for name in [corner, *names])
    # The header alone, so that there is one without any rows, and before the first line of every file.
    cells.sparkSession.createDataFrame([(header,)], "line string").write.mode("overwrite" if force else "errorifexists").text(path)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("line")).write.mode("append").text(path)


def parameters(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """Run parameters as ``key, value`` rows (K2)."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
