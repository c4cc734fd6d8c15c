"""Keyed tables in hash buckets: a merge rewrites only the buckets that its load touches (SNK2, SNK3).

    <path>/buckets=<n>/snapshot=<k>/bucket=<b>/part-*.parquet
    <path>/buckets=<n>/touched=<k>/bucket=<b>/          (empty folders)

The number of buckets is part of the path and stays. A merge names the buckets that it
touches and writes them into a new snapshot folder; of every bucket the version of the
highest snapshot that touched it and has Spark's `_SUCCESS` marker counts (a touched
bucket without a folder there is empty). Nothing that counts is overwritten or moved,
so a job that dies leaves the table as it was, and untouched buckets keep their files.
`compact` writes all buckets into one snapshot, so that folders don't add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoSnapshotError, UnknownColumnError
from ..session import materialize
from ..sources.snapshots import _file_system, partition_folders, path_exists
from .upsert import SNAPSHOT_COL, key_facts, merge_source, not_replaced, strict_source

BUCKETS = 64
BUCKET_COL = "bucket"


def bucket_of(keys: Sequence[str], buckets: int):
    """A row's bucket, from its key alone."""
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")


def _base(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The table's folder and number of buckets."""
    found = sorted((int(v), f) for v, f in partition_folders(spark, path, "buckets") if v.isdigit())
    return (found[0][1], found[0][0]) if found else None


def _snapshots(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Committed snapshots, newest first."""
    found = ((int(v), f) for v, f in partition_folders(spark, base, SNAPSHOT_COL) if v.isdigit())
    return sorted(((n, f) for n, f in found if path_exists(spark, f"{f}/_SUCCESS")), reverse=True)


def bucket_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder that counts, of every bucket that has rows. Folder names are listed, no files."""
    base = _base(spark, path)
    out: dict[int, str | None] = {}
    for k, folder in _snapshots(spark, base[0]) if base else []:
        written = dict(partition_folders(spark, folder, BUCKET_COL))
        for b, _ in partition_folders(spark, f"{base[0]}/touched={k}", BUCKET_COL):
            out.setdefault(int(b), written.get(b))
    return {b: f for b, f in out.items() if f}


def _touched(df: DataFrame, by: Sequence[str], buckets: int) -> set[int]:
    """Buckets of the rows of `df`: at most `buckets` numbers."""
    return {r[0] for r in df.select(bucket_of(by, buckets)).distinct().collect()}


def read_buckets(spark: SparkSession, path: str, keys: Sequence[str] = (), values: DataFrame | None = None,
                 only: set[int] | None = None) -> DataFrame:
    """The table; with `values(keys...)` only the buckets that may hold these keys (not filtered further).
    `keys` are those that give the bucket."""
    folders = bucket_folders(spark, path)
    if not folders:
        raise NoSnapshotError(f"no bucket under {path}")
    schema = spark.read.parquet(next(iter(folders.values()))).schema
    if values is not None:
        only = _touched(values, keys, _base(spark, path)[1])
    paths = [folders[b] for b in sorted(folders) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(df: DataFrame, by: Sequence[str], base: str, buckets: int, version: int, touched) -> None:
    """A new snapshot. Rows go to their bucket's tasks; a bucket with very many rows is split among several."""
    fs, place = _file_system(df.sparkSession, f"{base}/touched={version}")
    fs.delete(place, True)               # of a job that died
    for b in sorted(touched):
        fs.mkdirs(_file_system(df.sparkSession, f"{base}/touched={version}/{BUCKET_COL}={b}")[1])
    (df.withColumn(BUCKET_COL, bucket_of(by, buckets)).hint("rebalance", BUCKET_COL)
     .write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
     .partitionBy(BUCKET_COL).parquet(f"{base}/{SNAPSHOT_COL}={version}"))


def merge_buckets(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], order_col: str = "updated_at",
                  tiebreak: Sequence[str] = (), buckets: int = BUCKETS, strict: bool = False,
                  bucket_by: Sequence[str] | None = None, replace: DataFrame | None = None) -> int:
    """Create-or-merge like `upsert.merge_into`; returns the snapshot written.

    The load is stored once; only buckets that its keys fall into are read and
    written. `buckets` counts for a new table only. `bucket_by`: those of the keys
    that give the bucket (all of them by default; the same for every merge of a
    table). `replace(bucket_by...)`: all rows of these go, whether or not the source
    has their keys.
    """
    keys = list(keys)
    by = list(bucket_by or keys)
    if BUCKET_COL in source.columns:
        raise UnknownColumnError(f"a column is called {BUCKET_COL!r}")
    src = materialize(strict_source(source, keys) if strict else merge_source(source, keys, order_col, tiebreak))
    found = _base(spark, path)
    base, n = found or (f"{path.rstrip('/')}/buckets={buckets}", buckets)
    done = _snapshots(spark, base) if found else []
    gone = src.select(*keys) if replace is None else replace.select(*by).distinct()
    touched = _touched(src.select(*by).union(gone.select(*by)), by, n)
    out = src
    if bucket_folders(spark, path):
        target = read_buckets(spark, path, only=touched)
        if set(source.columns) != set(target.columns):
            raise UnknownColumnError(f"source and target differ in columns {sorted(set(source.columns) ^ set(target.columns))}")
        kept = not_replaced(target, src, keys, *key_facts(src, keys)) if replace is None else target.join(gone, gone.columns, "left_anti")
        out = src.unionByName(kept.select(*src.columns))
    version = done[0][0] + 1 if done else 0
    _write(out, by, base, n, version, touched)
    return version


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """All buckets in one new snapshot; `keys` are those that give the bucket."""
    df, (base, n) = read_buckets(spark, path), _base(spark, path)
    version = _snapshots(spark, base)[0][0] + 1
    _write(df, keys, base, n, version, range(n))
    return version
