"""Token files (operator 6): token ids of whole texts as ORC, in document order.

ORC keeps the ids in integer run-length encoding; every stripe has a row index
and a Bloom filter on `doc_id`, so that a lookup or a range read skips files,
stripes and row groups by metadata, and stripes are read in parallel.

Defined results: a null text counts as empty and has the end id alone; a null
`doc_id` sorts first; rows with equal `doc_id` are ordered by their text's hash
(equal rows are alike, so their order cannot matter); an empty table gives an
empty file set; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from . import common
from .tokens import encoder, with_end

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
FILE_SCHEMA = "doc_id long, ids array<int>, n_tokens long, shard int, shard_start long"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
}
ROWS_OUT = 2000   # rows of a batch handed back to Spark


def _encode_partition(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, start = encoder(name), TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, offsets = common.text_buffer(batch.column(1))
            for a, b in common.row_chunks(offsets, 8 << 20):
                for lo in range(a, b, ROWS_OUT):
                    hi = min(b, lo + ROWS_OUT)
                    own = offsets[lo:hi + 1]
                    ids, at = with_end(*enc.encode(buf[own[0]:own[-1]], own - own[0]), end_id)
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), lists, pa.array(np.diff(at)),
                         pa.array(np.full(hi - lo, shard, np.int32)), pa.array(start + at[:-1])],
                        ["doc_id", "ids", "n_tokens", "shard", "shard_start"])
                    start += int(at[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 partitions: int | None = None) -> str:
    """Write `docs(doc_id, text)` as ORC files under `path`, one sorted `doc_id` range each.

    Texts are range-partitioned (the hash of the text spreads a repeated id) and
    encoded where they land, so ids are never shuffled. `shard` and `shard_start`
    say where a row's ids start among its file's.
    """
    n = partitions or common.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    key = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id"), key).sortWithinPartitions("doc_id", key)
    (ordered.mapInArrow(_encode_partition(tokenizer, end_id), FILE_SCHEMA)
     .write.mode("overwrite").options(**ORC_OPTIONS).orc(path))
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): `start` counts the ids of all documents before.

    The offset of each file comes from a manifest with one row per file, read
    from two narrow columns.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    files = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return (rows.join(F.broadcast(base), "shard")   # one row per file
            .select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(common.documents(spark, sf_dir), shared_dir(spark, "orc-tokens"))
    return token_digests(read_tokens(spark, path))
