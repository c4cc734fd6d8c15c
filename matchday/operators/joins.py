"""Joins of the marts (JN1, JN2, JN4, JN8) and the uniqueness guard of Q6/Q11.

Join strategy is left to Catalyst and AQE: with adaptive execution on, a side
that turns out small at runtime becomes a broadcast, a big one stays a
sort-merge join, and skewed partitions are split. No side is forced to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKeyError

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (aggregated with a map-side combine)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "join side") -> DataFrame:
    """Raise if `keys` is not unique in `df` (Q6 fan-out guard). Runs one aggregate job."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{what} not unique on {list(keys)}: e.g. {dup[0].asDict()}")
    return df


def left_enrich(base: DataFrame, side: DataFrame, keys: Sequence[str], check_unique: bool = False) -> DataFrame:
    """`base LEFT JOIN side USING (keys)`; one output row per base row when `side` is unique (JN1, JN2, JN3)."""
    if check_unique:
        assert_unique(side, keys, "right side of left join")
    return base.join(side, on=list(keys), how="left")


def lookup(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str, prefix: str,
           columns: Sequence[str]) -> DataFrame:
    """Attach `columns` of `dim` where `df.left_key = dim.dim_key`, renamed `prefix + col` (JN4).

    Call twice with different keys/prefixes for a dimension used in two roles
    (badge of the team and badge of the opponent). The strategy is Spark's choice
    from the planner's estimates and AQE's runtime sizes.
    """
    d = dim.select(F.col(dim_key).alias(f"{prefix}_key"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(d, df[left_key] == d[f"{prefix}_key"], "left").drop(f"{prefix}_key")


def members(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` with a match in `other` (JN8, left semi join)."""
    return df.join(other.select(*keys), on=list(keys), how="left_semi")
