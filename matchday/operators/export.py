"""JSON export of marts (SNK5-SNK8).

Rows are written by the executors (JSON Lines, UTF-8, non-ASCII kept, null
fields dropped), never collected to the driver. One array or one document is
made only of the first k rows of a mart, where k and the order are given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def export_json(df: DataFrame, path: str, drop_nulls: bool = True) -> None:
    """Write a mart as JSON Lines, whatever its size (SNK5, SNK6, SNK8)."""
    (df.write.mode("overwrite").option("ignoreNullFields", str(drop_nulls).lower())
     .option("encoding", "UTF-8").json(path))


def first_rows(df: DataFrame, order: Sequence, k: int):
    """The first k rows of `df` by `order` as one array column value, in that order."""
    rank = F.row_number().over(Window.orderBy(*order))      # over k rows
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ranked = df.orderBy(*order).limit(k).select(F.struct(rank.alias("at"), row.alias("row")).alias("r"))
    return ranked.agg(F.transform(F.array_sort(F.collect_list("r"), lambda a, b: a["at"] - b["at"]),
                                  lambda r: r["row"]).alias("rows"))


def export_json_array(df: DataFrame, path: str, order: Sequence, k: int, drop_nulls: bool = True) -> None:
    """Write the first k rows by `order` as one file holding one JSON array (SNK5's API files)."""
    arr = F.to_json("rows", {"ignoreNullFields": str(drop_nulls).lower()})
    first_rows(df, order, k).select(arr.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an export back with its schema (missing fields come back as null)."""
    return spark.read.schema(schema).json(path)


def stamp(df: DataFrame, extraction_timestamp: str, load_date: str, source: str) -> DataFrame:
    """Add the `_metadata` stamp `{extraction_timestamp, load_date, source}` (SNK7)."""
    return df.withColumn("_metadata", F.struct(F.lit(extraction_timestamp).alias("extraction_timestamp"),
                                                 F.lit(load_date).alias("load_date"),
                                                 F.lit(source).alias("source")))


def wrap_rows(df: DataFrame, order: Sequence, k: int, field: str = "data") -> DataFrame:
    """The first k rows by `order` as one document `{<field>: [row, ...]}` (SNK7's list payloads, e.g. a league table)."""
    return first_rows(df, order, k).withColumnRenamed("rows", field)


def write_bronze(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Partitioned bronze write: `<path>/load_date=<d>/part-*.json` (SNK7).
    Writing a load again replaces it; other loads stay. `compression`, e.g. `gzip`: documents
    repeat their field names in every row, and take a tenth of the space."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_date").json(path, compression=compression)
