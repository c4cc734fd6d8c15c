"""Ranking, per-key top-k, ordered arrays and global top-k (WIN1-4, AGG6-7, ORD1-8, FLT6, SET2).

Scale notes
* Per-key top-k uses `row_number() <= k`. Catalyst turns this into a partial
  `WindowGroupLimit` *before* the shuffle, so each map task ships at most k
  rows per key: a key holding a third of all rows costs k rows of shuffle.
* Global top-k is `orderBy(...).limit(k)` = `TakeOrderedAndProject`
  (per-partition top-k, then a k-row merge).
* A global rank over the whole table (`global_row_number`) never funnels rows
  through one task: range-partition on the sort key, sort inside each
  partition, count rows per partition (one row per partition), and add each
  partition's offset. The sort key must be total (end with a unique column),
  which also makes the numbering stable when a task is re-run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownColumnError
from ..session import materialize

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id: record number in the low 33 bits


def _cols(cs) -> list:
    if isinstance(cs, (str, Column)):
        return [cs]
    return list(cs)


def rank_per_key(df: DataFrame, keys, order, alias: str = "rn") -> DataFrame:
    """`row_number() over (partition by keys order by order)` (WIN1/WIN2 building block)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn(alias, F.row_number().over(w))


def last_k_per_key(df: DataFrame, keys, order, k: int, alias: str = "rn") -> DataFrame:
    """Keep the first k rows of each key under `order`; `alias` holds 1..k (WIN2, FLT6)."""
    return rank_per_key(df, keys, order, alias).filter(F.col(alias) <= k)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first under `order` (WIN1, SET1 with a defined winner)."""
    return last_k_per_key(df, keys, order, 1, "_rn").drop("_rn")


def ordered_array(df: DataFrame, keys, order, value, k: int, alias: str) -> DataFrame:
    """Per key, an array of `value` for the first k rows under `order`, in that order (AGG6).

    `collect_list` alone has no order after a shuffle, so the rank travels with
    the value and the array is sorted by it. At most k values per key are
    collected, whatever the key's row count.
    """
    keys = _cols(keys)
    val = F.col(value) if isinstance(value, str) else value
    ranked = last_k_per_key(df.withColumn("_v", val), keys, order, k, "_rk")
    return (ranked.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_rk"), F.col("_v")))).alias("_a"))
            .select(*keys, F.transform("_a", lambda x: x["_v"]).alias(alias)))


def last_k_oldest_first(df: DataFrame, keys, date_col: str, tiebreak: str, k: int,
                        alias: str = "pos") -> DataFrame:
    """The k most recent rows per key, numbered oldest first 1..k (WIN4 + ORD6)."""
    latest = last_k_per_key(df, keys, [F.col(date_col).desc(), F.col(tiebreak).desc()], k, "_rk")
    # Within the kept rows the newest has _rk = 1; count of kept rows per key flips it.
    n = F.count(F.lit(1)).over(Window.partitionBy(*_cols(keys)))
    return latest.withColumn(alias, (n - F.col("_rk") + 1).cast("int")).drop("_rk")


def global_row_number(df: DataFrame, order, alias: str = "rank",
                      num_partitions: int | None = None, total_alias: str | None = None) -> DataFrame:
    """1-based position of every row under a total `order`, computed without one-task sorts.

    Plan: range exchange on the order key -> sort inside each partition ->
    record number inside the partition; per-partition row counts (one row per
    partition, broadcast) give each partition's offset. The numbered rows are
    checkpointed to the shared checkpoint dir, so the count branch and the
    output read the very same rows, and a lost executor costs no recomputation.
    """
    order = _cols(order)
    # Without a fixed count AQE may merge neighbouring range partitions; they stay
    # contiguous and in order, and both branches read the checkpointed result.
    parted = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    numbered = materialize(parted
                           .sortWithinPartitions(*order)
                           .withColumns({"_pid": F.spark_partition_id(),
                                         "_local": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))}))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the only unpartitioned windows here hold n rows.
    offsets = counts.select(
        "_pid",
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    j = numbered.join(F.broadcast(offsets), "_pid")
    rank = (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1).cast("long").alias(alias)
    extra = [F.col("_total").alias(total_alias)] if total_alias else []
    return j.select(*[F.col(f"`{c}`") for c in df.columns], rank, *extra)


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """Global top-k (ORD3). `order` should end with a unique column so ties are fixed (Q14)."""
    return df.orderBy(*_cols(order)).limit(k)


def with_display_rank(df_k: DataFrame, order, alias: str = "position") -> DataFrame:
    """1-based rank over an already-bounded top-k result (WIN3).

    Only call on a result of `top_k`: the unpartitioned window holds k rows.
    """
    return df_k.withColumn(alias, F.row_number().over(Window.orderBy(*_cols(order))))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def check_numeric(df: DataFrame, measure: str) -> None:
    fields = {f.name: f.dataType for f in df.schema.fields}
    if measure not in fields:
        raise UnknownColumnError(f"unknown measure {measure!r}; have {sorted(fields)}")
    if not isinstance(fields[measure], _NUMERIC):
        raise UnknownColumnError(f"measure {measure!r} is not numeric ({fields[measure]})")


def leaders(df: DataFrame, measure: str, key: str, k: int = 10,
            position: str = "position") -> DataFrame:
    """Top k rows by any numeric `measure`, nulls out, ties by `key` (ORD4, FLT9, WIN3)."""
    check_numeric(df, measure)
    order = [F.col(measure).desc(), F.col(key).asc()]
    best = top_k(df.filter(F.col(measure).isNotNull()), order, k)
    return with_display_rank(best, order, position)


# UI aliases for sort keys.
SORT_KEY_ALIASES = {"XGP": "xg_performance"}


def sort_by_choice(df: DataFrame, key: str, direction: str, tiebreak: str, k: int = 6) -> DataFrame:
    """User-chosen sort key and direction, first k rows (ORD5)."""
    key = SORT_KEY_ALIASES.get(key, key)
    if key not in df.columns:
        raise UnknownColumnError(f"unknown sort key {key!r}")
    c = F.col(key)
    primary = c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last()
    return top_k(df, [primary, F.col(tiebreak).asc()], k)


def same_group_first(df: DataFrame, group_col: str, group_value, self_col: str, self_value,
                     file_order: str, name_col: str, k: int = 8,
                     alias: str = "slot") -> DataFrame:
    """Rows of the same group first (in file order), then the rest by name, self
    excluded, first k (SET2, FLT10). One bounded top-k, no union."""
    same = F.col(group_col).eqNullSafe(F.lit(group_value))     # missing equals missing
    bucket = F.when(same, 0).otherwise(1)
    # Same-group rows keep file order; others sort by name, then file order.
    within = F.when(same, F.lit(None).cast("string")).otherwise(F.col(name_col))
    cand = df.filter(~F.col(self_col).eqNullSafe(F.lit(self_value)))
    best = (cand.withColumn("_b", bucket).withColumn("_w", within)
            .orderBy(F.col("_b").asc(), F.col("_w").asc_nulls_first(), F.col(file_order).asc())
            .limit(k))
    return (with_display_rank(best, [F.col("_b").asc(), F.col("_w").asc_nulls_first(),
                                     F.col(file_order).asc()], alias)
            .withColumn("same_group", F.col("_b") == 0).drop("_b", "_w"))


def leaders_of_all(df: DataFrame, measures: Sequence[str], name_col: str, k: int) -> DataFrame:
    """(measure, position, name, value): the top k of every measure, in one scan (ORD4).

    Rows are unpivoted, nulls left out (FLT9); every task keeps k rows per measure
    before the shuffle. Ties go to the first name.
    """
    for m in measures:
        if m not in df.columns:
            raise UnknownColumnError(f"unknown measure {m!r}")
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in measures])
    rows = df.select(F.col(f"`{name_col}`").alias("name"), F.explode(pairs).alias("p")).select("name", "p.*").filter("value is not null")
    order = Window.partitionBy("measure").orderBy(F.desc("value"), F.asc("name"))
    return (rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
            .select("measure", "position", "name", "value"))
