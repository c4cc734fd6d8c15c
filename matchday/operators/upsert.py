"""Keyed upsert and snapshot tables (SNK1-SNK4, SET1, SET3, JN6, JN7).

Parquet has no MERGE. A merge is the DataFrame composition

    result = latest(source) UNION ALL (target LEFT ANTI JOIN latest(source) ON keys)

which is
`whenMatchedUpdateAll + whenNotMatchedInsertAll`: matched target rows
are replaced by the source row, unmatched source rows are inserted, other
target rows are kept. Null keys never compare equal, so null-key rows are
inserted and kept like rows with keys of their own; but in a merge a target row that
equals such a source row in every column is that row, so that a rerun adds nothing.

A table is a directory of immutable snapshots `<path>/snapshot=<n>`; a merge
reads snapshot n and writes n+1, so no job overwrites the files it reads.
Readers take the highest snapshot with Spark's `_SUCCESS` marker: what a job
left that died before its commit ended is never read, and written over later.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoSnapshotError, UnknownColumnError
from ..sources.snapshots import partition_folders, path_exists
from .ranking import first_per_key

SNAPSHOT_COL = "snapshot"
SENT_KEYS = 4 << 20      # bytes of a load's keys, about, up to which they may be sent to every executor


def _latest_first(df: DataFrame, order_col: str, tiebreak: Sequence[str]) -> list:
    """Newest first; the remaining columns make the order total, so that runs agree (Q14)."""
    first = [order_col, *tiebreak]
    rest = [f.name for f in df.schema.fields if f.name not in first]
    # maps have no order of their own; their entries do
    value = {f.name: F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
             for f in df.schema.fields}
    return [value[c].desc_nulls_last() for c in [*first, *rest]]


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_col: str = "updated_at",
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest `order_col` wins (SNK4, SET1 with a defined row).

    `tiebreak` columns (descending), then all others, settle rows with equal `order_col`.
    """
    return first_per_key(df, list(keys), _latest_first(df, order_col, tiebreak))


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in keys))


def _null_key_solo(keys: Sequence[str]):
    """A group id of its own for rows with a null key (they never match under `=`)."""
    return F.when(_any_null(keys), F.monotonically_increasing_id())


def key_facts(source: DataFrame, keys: Sequence[str]) -> tuple[bool, bool]:
    """(whether rows have a null key, whether the keys are too many to be sent to every executor), in one pass.

    The planner judges a load by the files that it comes from, which are packed; a join
    it has planned as a broadcast stays one, also when the keys turn out to be many.
    """
    text = F.concat_ws("", *(F.col(f"`{k}`").cast("string") for k in keys))
    null, size = source.agg(F.max(_any_null(keys)), F.sum(F.octet_length(text) + 64)).first()
    return bool(null), (size or 0) > SENT_KEYS


def not_replaced(target: DataFrame, source: DataFrame, keys: Sequence[str], null_keys: bool, many: bool = False) -> DataFrame:
    """The target rows that no source row replaces (JN6): an anti-join on the source's distinct keys.

    With `null_keys` (the source has rows with a null key) the target's rows with a
    null key are compared with these as a whole, in a branch of their own, so that
    the keyed rows keep their partitioning. `many`: the keys stay where they lie,
    whatever the planner takes them for; else those of a small load may be broadcast.
    """
    keys = list(keys)
    gone = source.select(*keys).distinct()
    kept = target.join(gone.hint("merge") if many else gone, keys, "left_anti").select(*target.columns)
    if not null_keys:
        return kept
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in target.columns)), {"ignoreNullFields": "false"}).alias("_row")
    lone = target.filter(_any_null(keys)).select(*target.columns, row)
    again = source.filter(_any_null(keys)).select(row).distinct()
    # whole rows as text are small when compressed and large once broadcast: they stay where they lie
    return kept.filter(~_any_null(keys)).unionByName(lone.join(again.hint("merge"), "_row", "left_anti").select(*target.columns))


def merge_source(source: DataFrame, keys: Sequence[str], order_col: str = "updated_at",
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Latest row per key (SNK4), except rows with a null key: those can never
    match under `=`, so each one is kept as its own insert, as MERGE does.
    A per-key top-1: a key with a third of the rows ships one row per map task."""
    keys = list(keys)
    order = _latest_first(source, order_col, tiebreak)
    return (first_per_key(source.withColumn("_solo", _null_key_solo(keys)), keys + ["_solo"], order)
            .drop("_solo"))


def strict_source(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`source` as it is, if no two rows share a key; else the job that reads it fails (SNK4 as MERGE has it).

    The check is part of the plan, one aggregate on the keys; no job of its own
    runs. Rows with a null key never match anything and may repeat.
    """
    keys, row = list(keys), F.struct(*(F.col(f"`{c}`") for c in source.columns))
    solo = source.withColumn("_solo", _null_key_solo(keys))
    text = F.concat(F.lit("several source rows for one key: "), F.to_json(F.struct(*keys)))
    one = F.when(F.col("n") > 1, F.raise_error(text).cast(source.schema)).otherwise(F.col("row"))
    return (solo.groupBy(*keys, "_solo").agg(F.any_value(row).alias("row"), F.count(F.lit(1)).alias("n"))
            .select(one.alias("row")).select("row.*"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           order_col: str = "updated_at", tiebreak: Sequence[str] = (),
           dedupe: bool = True, null_keys: bool = False, many: bool = False) -> DataFrame:
    """Update-all / insert-all merge of `source` into `target` on `keys` (SNK2, JN6, JN7, SET3).

    Every source row is kept (after the latest-wins de-duplication), a target row
    only when no source row has its key. The keys of a small load are broadcast
    by the planner's size check, and then the target isn't shuffled at all. Both
    sides must have the same columns: nothing is filled with nulls. `null_keys`: the
    source has rows with a null key, and target rows that equal one are replaced by it.
    `many`: its keys are too many for a broadcast.
    """
    keys = list(keys)
    if set(source.columns) != set(target.columns):
        raise UnknownColumnError(f"source and target differ in columns {sorted(set(source.columns) ^ set(target.columns))}")
    src = merge_source(source, keys, order_col, tiebreak) if dedupe else source
    return src.unionByName(not_replaced(target, source, keys, null_keys, many))


# --- snapshot tables -------------------------------------------------------------------------

def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest committed snapshot number: only folder names are listed, not files."""
    for n, folder in sorted(((int(v), f) for v, f in partition_folders(spark, path, SNAPSHOT_COL) if v.isdigit()),
                            reverse=True):
        if path_exists(spark, f"{folder}/_SUCCESS"):
            return n
    return None


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a table, without the snapshot column (SRC6)."""
    v = latest_version(spark, path)
    if v is None:
        raise NoSnapshotError(f"no snapshot under {path}")
    return read_version(spark, path, v)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One snapshot, read from its own directory (its own schema; no other version listed)."""
    return spark.read.parquet(f"{path.rstrip('/')}/{SNAPSHOT_COL}={version}")


def table_exists(spark: SparkSession, path: str) -> bool:
    return latest_version(spark, path) is not None


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write one immutable snapshot (SNK1 full overwrite = a new snapshot).

    The plan's own partitioning is written as is: an ordered mart keeps its
    order, and a merge adds no shuffle of the target. No reader uses a version
    before its `_SUCCESS` marker, so a retried job may overwrite what a failed
    attempt left there.
    """
    (df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
     .parquet(f"{path.rstrip('/')}/{SNAPSHOT_COL}={version}"))


def overwrite(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Full snapshot overwrite (SNK1); returns the new version."""
    v = latest_version(spark, path)
    nv = 0 if v is None else v + 1
    write_snapshot(df, path, nv)
    return nv


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
               order_col: str = "updated_at", tiebreak: Sequence[str] = (), strict: bool = False, latest: bool = False) -> int:
    """Create-or-merge (SNK3): first load writes the de-duplicated source, later
    loads upsert into the current snapshot. Returns the version written.
    `strict`: a source with two rows for one key fails, and nothing is written.
    `latest`: the source comes from `merge_source` with the same arguments, and isn't de-duplicated (and shuffled) again."""
    if strict:
        source = strict_source(source, keys)
    v = latest_version(spark, path)
    if v is None:
        out = source if latest else merge_source(source, keys, order_col, tiebreak)
        nv = 0
    else:
        target = read_version(spark, path, v)
        null_keys, many = key_facts(source, keys)
        out = upsert(target, source, keys, order_col, tiebreak, dedupe=not latest, null_keys=null_keys, many=many)
        nv = v + 1
    write_snapshot(out, path, nv)
    return nv


# --- lookup marts ----------------------------------------------------------------------------

LOOKUP_COL = "lookup_key"


def write_lookup(spark: SparkSession, df: DataFrame, path: str, key) -> int:
    """A mart for lookups by `key` (a column expression), as a new snapshot.

    Rows are sorted by the key and its column has Parquet Bloom filters, so that a
    lookup reads one file's row group, if any (FLT8, Q-API2, Q-API3). The hash of
    the row joins the range, so that one key with very many rows fills several files.
    """
    v = latest_version(spark, path)
    nv = 0 if v is None else v + 1
    row = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)))
    keyed = df.withColumn(LOOKUP_COL, key)
    (keyed.repartitionByRange(F.col(LOOKUP_COL), row).sortWithinPartitions(LOOKUP_COL)
     .write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
     .option(f"parquet.bloom.filter.enabled#{LOOKUP_COL}", "true")
     .parquet(f"{path.rstrip('/')}/{SNAPSHOT_COL}={nv}"))
    return nv


def lookup(spark: SparkSession, path: str, value: str) -> DataFrame:
    """The rows of a lookup mart with this key; the comparison reaches the scan."""
    return read_latest(spark, path).filter(F.col(LOOKUP_COL) == value).drop(LOOKUP_COL)
