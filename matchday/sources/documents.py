"""Multi-line JSON document scans (SRC1-SRC3, SRC8, SRC10).

Schemas are always given (see `matchday.schemas`): inference costs a pass
over the data and cannot type an array that is empty in every file of a load.
`load_date=YYYY-MM-DD` directories are Hive partitions, so a filter on
`load_date` prunes directories at planning time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COL = "_corrupt_record"   # text of a document that doesn't parse
FILE_COL = "source_file"
META_COL = "_metadata"  # name of the stamp struct inside each document
META_RENAMED = "meta"


def read_documents(spark: SparkSession, path: str, schema: T.StructType,
                   glob: str | None = "*.json", multiline: bool = True, broken: str = "fail") -> DataFrame:
    """Read a directory tree of JSON documents with a fixed schema.

    A document that doesn't parse fails the job (`broken="fail"`), or is kept with
    its file and its text (`broken="keep"`), for `split_broken`; none is lost.

    The document field `_metadata` is renamed `meta` at once: Spark also has a
    hidden file-metadata column of that name, and a rename keeps the two apart.
    `load_date` comes from the directory names (partition discovery).
    """
    reader = spark.read.option("multiLine", multiline)
    if broken == "keep":
        reader = (reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT_COL, T.StringType())]))
                  .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL))
    else:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path)
    if META_COL in schema.fieldNames():
        df = df.withColumnRenamed(META_COL, META_RENAMED)
    return df.withColumn(FILE_COL, F.input_file_name()) if broken == "keep" else df


def split_broken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole documents, quarantine rows) of a scan with `broken="keep"`.

    Quarantine rows have the file, the load and the text as it was, so that a
    document can be mended and loaded again. Store `docs` before using both.
    """
    bad = F.col(CORRUPT_COL).isNotNull()
    load = F.col("load_date") if "load_date" in docs.columns else F.lit(None).cast("date").alias("load_date")
    quarantine = docs.filter(bad).select(FILE_COL, load, F.col(CORRUPT_COL).alias("document"))
    return docs.filter(~bad).drop(CORRUPT_COL, FILE_COL), quarantine


POSITION = "file_position"


def read_rows(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = "*.json") -> DataFrame:
    """Rows of files that hold one JSON array each, with `file_position` (SRC8).

    The position is data, struct<file, at>: it orders rows by file path, then by
    place in the array, however Spark splits and shuffles them. A file that isn't
    an array of objects fails the job.
    """
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path).select(F.input_file_name().alias("file"), "value")
    rows = F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})
    return text.select("file", F.posexplode(rows).alias("at", "row")).select(
        "row.*", F.struct("file", "at").alias(POSITION))


def with_load_date(schema: T.StructType) -> T.StructType:
    """Schema plus the `load_date` partition column, typed as date."""
    if "load_date" in schema.fieldNames():
        return schema
    return T.StructType(schema.fields + [T.StructField("load_date", T.DateType(), True)])
