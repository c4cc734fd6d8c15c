"""Session helpers.

`build_session` is for tests, the bench and command-line runs; library code
never creates a session, it takes the caller's. `shared_dir` resolves the
cluster's shared scratch location from `spark.checkpoint.dir`.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes,
# splits skewed shuffle partitions and coalesces small ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "matchday", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition settings for a cluster run, sized from the input volume.

    Scan splits and post-shuffle partitions aim at `target_partition_bytes`
    (256 MB: fits executor memory with room for sort/aggregation buffers);
    the initial shuffle partition count is a multiple of the total cores so
    every wave is full, and AQE coalesces or splits from there at runtime.
    """
    cores = max(1, executors * cores_per_executor)
    by_size = -(-input_bytes // target_partition_bytes)
    shuffle = max(cores, -(-by_size // cores) * cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint dir (`spark.checkpoint.dir`).

    Only a local-mode session (tests, one machine) without one gets a
    temporary folder; on a cluster a machine-local folder would not be seen
    by the executors, so a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        current = tempfile.mkdtemp(prefix="matchday-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint location (never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ship_library(spark: SparkSession) -> None:
    """Give the executors this package, for clusters that have no install of it.

    Once per application: the package's sources go out as an archive through
    Spark's own file distribution (`addPyFile`).
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="matchday-code-")) / "matchday-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))     # copied to Spark's file server; executors fetch it from there
    _SHIPPED.add(application)


_SHIPPED: set[str] = set()


def stored(df, name: str):
    """`df` written once as Parquet into the shared folder and read again.

    For wide rows that repeat themselves (documents): a checkpoint keeps every row as
    it lies in memory, Parquet a small part of that, and later scans read the columns they use.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Write `df` to the shared checkpoint dir and read it back (eager `checkpoint`).

    Used where one intermediate feeds many branches of a plan: it is computed
    once, and a lost executor does not force recomputing its lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
