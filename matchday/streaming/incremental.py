"""Pick up each new bronze load once and merge it into its silver table.

The source job is a weekly batch that globbed the newest `load_date=` folder.
Here the same upsert is driven by Structured Streaming with
`trigger(availableNow=True)`: the file source's checkpoint records which
files were merged, so a run processes exactly the loads that arrived since
the last one, then stops. A batch replayed after a failure merges the same
rows again, which the keyed upsert absorbs (idempotent).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.upsert import merge_into
from ..sources.documents import META_COL, META_RENAMED, with_load_date


def stream_documents(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of JSON documents under `path` (Hive-style `load_date=` folders)."""
    reader = (spark.readStream.schema(with_load_date(schema)).option("multiLine", True)
              .option("pathGlobFilter", glob))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.json(path)
    if META_COL in schema.fieldNames():
        df = df.withColumnRenamed(META_COL, META_RENAMED)
    return df


def merge_new_loads(spark: SparkSession, bronze_path: str, schema: T.StructType,
                    build: Callable[[DataFrame], DataFrame], table_path: str, keys: Sequence[str],
                    checkpoint: str, order_col: str = "updated_at", tiebreak: Sequence[str] = ()) -> None:
    """Merge every not-yet-seen bronze file into `table_path`, then return."""
    def merge_batch(batch: DataFrame, epoch_id: int) -> None:
        # the batch is read twice (emptiness, merge): keep it for the duration of the batch
        batch.persist()
        try:
            if not batch.isEmpty():
                merge_into(spark, table_path, build(batch), keys, order_col, tiebreak)
        finally:
            batch.unpersist()

    q = (stream_documents(spark, bronze_path, schema).writeStream
         .foreachBatch(merge_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
