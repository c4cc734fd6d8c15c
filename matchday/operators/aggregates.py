"""Per-key totals (AGG1-AGG5, FLT5).

Plain `groupBy().agg()`: Spark plans a partial aggregate before the shuffle
and a final one after, so a hot key sends one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoring_totals(df: DataFrame, key: str, date_col: str, minutes: str, goals: str, assists: str,
                   xg: str, xa: str, min_total_minutes: int = 0) -> DataFrame:
    """Per key: matches, minutes, goals, assists, rounded xG / xA and goals - xG,
    keeping keys with more than `min_total_minutes` minutes (AGG1-5, FLT5)."""
    return (df.groupBy(key).agg(
        F.count(date_col).alias("matches_played"),
        F.sum(minutes).cast("long").alias("total_minutes"),
        F.sum(goals).cast("long").alias("total_goals"),
        F.sum(assists).cast("long").alias("total_assists"),
        F.round(F.sum(xg), 2).alias("total_xg"),
        F.round(F.sum(xa), 2).alias("total_xa"))
        .withColumn("xg_performance", F.round(F.col("total_goals") - F.col("total_xg"), 2))
        .filter(F.col("total_minutes") > min_total_minutes))


def top_by(df: DataFrame, key: Sequence[str] | str, value: str, measure: Column | str,
           tiebreak: str, alias: str) -> DataFrame:
    """Per key, the `value` of the row with the highest numeric measure; ties go to
    the smallest `tiebreak`, null measures last (AGG7). A partial aggregate: a hot
    key ships one candidate per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    m = F.col(measure) if isinstance(measure, str) else measure
    rank_key = F.struct(F.when(m.isNull(), 1).otherwise(0), -m, F.col(tiebreak))
    return df.groupBy(*keys).agg(F.min_by(F.col(value), rank_key).alias(alias))
