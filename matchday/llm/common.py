"""Helpers shared by the corpus operators: table reads, Arrow text buffers, 64-bit hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, shared_dir
from ..sources.tables import read_table

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


BATCH_BYTES = 8 << 20    # of an Arrow batch handed to Python, about


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: 10,000 rows of long texts would be hundreds of megabytes for every worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or int(now.rstrip("b")) <= 0 or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table, whose texts may be long."""
    bounded_batches(spark)
    return read_table(spark, sf_dir, "documents")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder; its lineage is cut there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet into the shared folder and read again (smaller than a checkpoint)."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def maybe_among(ids: DataFrame, column: str, bits: int = 1 << 21):
    """A test `col -> Column` that is true for every value in `ids`, and for few others.

    A Bloom filter of one hash and fixed size: `bits / 64` numbers reach the
    driver and the plan, whatever the number of ids. Rows that fail it need no
    join with `ids`; if there are many ids, most rows pass, and nothing is lost.
    """
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(bits))
    rows = (ids.select(bit(F.col(column)).alias("b"))
            .groupBy(F.shiftright("b", 6).cast("int").alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("word")).collect())
    words = [0] * (bits // 64)
    for r in rows:
        words[r["at"]] = r["word"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def test(c: Column) -> Column:
        b = bit(c)
        return F.getbit(F.get(table, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1
    return test


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (bijective bit mixing)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 random odd-looking 64-bit values, one per byte."""
    return mix(np.arange(256, dtype=U64) * U64(_P) + U64((seed * 0xD1B54A32D192ED03 + 1) & _MASK))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept for the next call)."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        inverse = pow(_P, -1, 1 << 64)
        out = []
        for base in (_P, inverse):
            a = np.full(size, base, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > 1 << 24:
            return out[0][:n], out[1][:n]
        _POWERS["p"], _POWERS["q"] = out
    return _POWERS["p"][:n], _POWERS["q"][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run `values[start:end]` of 64-bit symbols, by prefix sums."""
    p, q = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * p[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    if total == 0:
        return out
    at = np.cumsum(n) - n
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
