"""Record of the loads that silver tables were made of (SRC4, SRC5).

A load is a folder `<bronze>/<part>/load_date=<v>`. What one listing of it shows
(files, bytes, newest change) is its mark; `<silver>/loads` holds the mark that each
load had when it was merged. So a rerun can tell what it has done already, a load
that was written again is seen as changed, and a part without any load has a state
of its own instead of an error. The driver holds one row per load, and the names of
one load's files while it adds them up.

Marks are written after the tables: a run that dies before that merges its load again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import _file_system, partition_folders
from ..sources.tables import optional_table
from .upsert import merge_into, read_latest

LOADS = "loads"
MARK = "part string, load_date string, files long, bytes long, changed long"
MERGED, CHANGED, NEW, NO_LOAD = "merged", "changed", "new", "no snapshot"


def marks(spark: SparkSession, bronze_root: str, part: str, newest: bool = False) -> list[tuple]:
    """(part, load, files, bytes, newest change) of the loads of a part, or of its newest one; empty files don't count."""
    loads = sorted(partition_folders(spark, f"{bronze_root.rstrip('/')}/{part}", "load_date"))
    out = []
    for load, folder in loads[-1:] if newest else loads:
        fs, place = _file_system(spark, folder)
        files = [(s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)
                 if s.isFile() and s.getLen() and s.getPath().getName()[:1] not in "._"]
        out.append((part, load, len(files), sum(n for n, _ in files), max((t for _, t in files), default=0)))
    return out


def record(spark: SparkSession, silver_root: str, found: Sequence[tuple]) -> None:
    """Notes that these loads were merged as they were when `found` was listed."""
    if found:
        merge_into(spark, f"{silver_root.rstrip('/')}/{LOADS}", spark.createDataFrame(list(found), MARK), ("part", "load_date"), "changed")


def states(spark: SparkSession, bronze_root: str, silver_root: str, parts: Sequence[str]) -> DataFrame:
    """(part, load_date, state) of every load: merged, changed since, or new; a part without one has the state `no snapshot`."""
    now = [m for part in parts for m in marks(spark, bronze_root, part) or [(part, None, 0, 0, 0)]]
    listed = spark.createDataFrame(now, MARK)
    known = optional_table(lambda: read_latest(spark, f"{silver_root.rstrip('/')}/{LOADS}"))
    known = (spark.createDataFrame([], MARK) if known is None else known).withColumn("mark", F.struct("files", "bytes", "changed"))
    return listed.join(known.select("part", "load_date", "mark"), ["part", "load_date"], "left").select(
        "part", "load_date", F.when(F.col("load_date").isNull(), NO_LOAD).when(F.col("mark").isNull(), NEW)
        .when(F.col("mark") == F.struct("files", "bytes", "changed"), MERGED).otherwise(CHANGED).alias("state"))


def all_merged(spark: SparkSession, silver_root: str, found: Sequence[tuple]) -> bool:
    """Whether all these loads were merged as they are."""
    known = optional_table(lambda: read_latest(spark, f"{silver_root.rstrip('/')}/{LOADS}"))
    if known is None or not found:
        return False
    names = [c.split()[0] for c in MARK.split(", ")]
    done = {tuple(r) for r in known.filter(F.col("part") == found[0][0]).select(*names).collect()}     # one row per load
    return set(found) <= done
