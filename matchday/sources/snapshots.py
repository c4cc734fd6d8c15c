"""Latest-load selection (SRC4, SRC5).

The reference sorted folder names on the driver's local disk and took the
last. Here the newest `load_date` is a scalar aggregate over the partition
column, which Spark answers from the directory listing, and the filter on it
is a partition filter: only the newest folder is read.
"""

from __future__ import annotations

import datetime as dt
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoSnapshotError


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def partition_folders(spark: SparkSession, path: str, col: str) -> list[tuple[str, str]]:
    """(value, folder) of the folders `<path>/<col>=<value>`; lists one level, no files below it."""
    fs, place = _file_system(spark, path.rstrip("/"))
    if not fs.exists(place):
        return []
    out = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{col}="):
            out.append((unquote(name[len(col) + 1:]), status.getPath().toString()))
    return out


def partition_values(df: DataFrame, col: str) -> set[str]:
    """Values of a Hive-style partition column, from the file listing only.

    `max(partition_col)` as a query would read every file of every load
    (Spark's metadata-only answer is off by default); the listing is metadata
    the driver holds for planning anyway.
    """
    pat = re.compile(rf"/{re.escape(col)}=([^/]+)/")
    return {unquote(m.group(1)) for f in df.inputFiles() for m in [pat.search(f)] if m}


def newest_load(spark: SparkSession, path: str, col: str = "load_date") -> str:
    """Value of the newest folder `<path>/<col>=<value>`, by name (ISO dates sort as text).

    One level of names is listed, whatever the number of files. A source without a
    load folder, or without a folder at all, raises `NoSnapshotError` (SRC5).
    """
    found = [v for v, _ in partition_folders(spark, path, col)]
    if not found:
        raise NoSnapshotError(f"no `{col}` load under {path}")
    return max(found)


def _typed(v: str, dtype: T.DataType):
    if isinstance(dtype, T.DateType):
        return dt.date.fromisoformat(v)
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(v)
    return v


def latest_value(df: DataFrame, col: str = "load_date"):
    """Largest value of a partition column (from the listing), else of a data column."""
    vals = partition_values(df, col)
    if vals:
        dtype = df.schema[col].dataType
        return max(_typed(v, dtype) for v in vals)
    row = df.agg(F.max(col).alias("m")).first()
    return None if row is None else row["m"]


def latest_snapshot(df: DataFrame, col: str = "load_date") -> DataFrame:
    """Rows of the newest load folder only; raises `NoSnapshotError` on an empty source (SRC5).

    "Newest" is taken over the source's folders (as the folder glob did), so
    call this on the scanned source, before filters on data columns.
    """
    v = latest_value(df, col)
    if v is None:
        raise NoSnapshotError(f"no `{col}` load found")
    return df.filter(F.col(col) == F.lit(v))


def latest_per_key(df: DataFrame, keys, col: str = "load_date") -> DataFrame:
    """Rows of the newest load *per key* (Q5: statistics keep one row per load)."""
    from ..operators.ranking import first_per_key
    return first_per_key(df, keys, [F.col(col).desc_nulls_last()])
